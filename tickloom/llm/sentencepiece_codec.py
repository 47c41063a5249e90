"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is read field by field; from it come the normaliser (character map, white space, dummy prefix), the
metaspace marker, the pieces with their unigram scores or BPE merges, and byte fallback. Texts go to the library in batches,
which it encodes on THREADS threads. Every text is also encoded by the sentencepiece library, and a difference is an error. Ids are decoded piece by piece, and by the library's byte fallback where a text has
bytes beyond ASCII.

The model travels to the executors as one broadcast of the file's bytes, whose size doesn't depend on the corpus. Texts are
worked on in slices of SLICE characters, so memory is bounded by the longest text.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows and null keys give a row each;
an empty table gives an empty result; other columns pass through, and a column with the name of an added one is replaced.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS, SLICE = 2, 500_000
#: Fixed values of the format: model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; values are integers or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at:at + size]
        at += size


def parse_model(data: bytes) -> dict:
    """Pieces as (text, score, type) and the settings that encoding needs."""
    found: dict = {"pieces": [], "type": UNIGRAM, "byte_fallback": 0, "unk": 0, "charsmap": b"", "dummy": 1, "squeeze": 1, "escape": 1}
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            found["pieces"].append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
        elif number == 2:
            own = dict(fields(value))
            found |= {"type": own.get(3, UNIGRAM), "byte_fallback": own.get(35, 0), "unk": own.get(40, 0)}
        elif number == 3:
            own = dict(fields(value))
            found |= {"charsmap": own.get(2, b""), "dummy": own.get(3, 1), "squeeze": own.get(4, 1), "escape": own.get(5, 1)}
    return found


class Codec:
    """One model, in one process."""

    def __init__(self, data: bytes) -> None:
        self.model = m = parse_model(data)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
        if m["squeeze"]:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        self.normaliser = normalizers.Sequence(steps) if steps else None
        self.tokenizer = Tokenizer(self._unigram() if m["type"] == UNIGRAM else self._bpe())
        ends = [decoders.Strip(" ", 1, 0)] if m["dummy"] else []
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
        byte = re.compile("<0x([0-9A-F]{2})>")
        values = [int(byte.fullmatch(p)[1], 16) if kind == BYTE else -1 for p, _, kind in m["pieces"]]
        self.high = np.array([v > 127 for v in values])  # bytes that only mean something beside others
        self.texts = [p.replace(MARK, " ") if v < 0 else chr(v) for (p, _, _), v in zip(m["pieces"], values)]

    def _bpe(self) -> models.BPE:
        """Merges by falling score of what they make."""
        pieces = self.model["pieces"]
        vocabulary = {p: k for k, (p, _, _) in enumerate(pieces)}
        merges = [(-score, p[:k], p[k:]) for p, score, kind in pieces if kind == NORMAL
                  for k in range(1, len(p)) if p[:k] in vocabulary and p[k:] in vocabulary]
        merges.sort(key=lambda m: m[0])
        return models.BPE(vocabulary, [m[1:] for m in merges], unk_token=pieces[self.model["unk"]][0], fuse_unk=True,
                          byte_fallback=bool(self.model["byte_fallback"]))

    def _unigram(self) -> models.Unigram:
        """Pieces with their scores; what isn't text gets a name that no text holds."""
        byte = bool(self.model["byte_fallback"])
        vocabulary = [(p if kind in (NORMAL, USER_DEFINED) or kind == BYTE and byte else f"﷐{k}", score)
                      for k, (p, score, kind) in enumerate(self.model["pieces"])]
        return models.Unigram(vocabulary, unk_id=self.model["unk"], byte_fallback=byte)

    def normalised(self, text: str) -> str:
        """The text as pieces see it: with the marker for spaces and, unless empty, the dummy prefix."""
        s = self.normaliser.normalize_str(text) if self.normaliser else text
        if self.model["escape"]:
            s = s.replace(" ", MARK)
        return MARK + s if s and self.model["dummy"] else s

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([self.normalised(t or "") for t in texts], add_special_tokens=False)
        out = []
        for t, own, want in zip(texts, found, self.reference.encode([t or "" for t in texts], num_threads=1), strict=True):
            ids = own.ids
            if ids != want:
                raise ValueError(f"{(t or '')[:200]!r}: tokenizers and sentencepiece differ")
            out.append(np.array(ids, np.int32))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        out = []
        for row in ids:
            if len(row) and self.high[row].any():
                out.append(self.tokenizer.decode(row.tolist(), skip_special_tokens=False))
                continue
            text = "".join(map(self.texts.__getitem__, row.tolist()))
            out.append(text[1:] if self.model["dummy"] and text[:1] == " " else text)
        return out


_codecs: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    """This process's codec of a model."""
    key = hash(data)
    if key not in _codecs:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        _codecs[key] = Codec(data)
    return _codecs[key]


def model_bytes(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _slices(sizes: list[int]) -> Iterator[slice]:
    start = weight = 0
    for k, size in enumerate(sizes):
        weight += size
        if weight >= SLICE:
            yield slice(start, k + 1)
            start, weight = k + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _appended(df: DataFrame, column: str, added: list[tuple[str, T.DataType]], work) -> DataFrame:
    """df with more columns, made from one, slice by slice."""
    df = df.select(*[c for c in df.columns if c not in dict(added)])
    at, schema = df.columns.index(column), T.StructType([*df.schema.fields, *(T.StructField(*x) for x in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(values) if pa.types.is_list(values.type) else pa.compute.utf8_length(values), 0)
            for part in _slices(sizes.to_pylist()):
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns, *work(rows.column(at))], names=schema.names)

    return df.mapInArrow(run, schema)


IDS = T.ArrayType(T.IntegerType())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def encoded(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids`, the piece ids of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _appended(docs, text, [(ids, IDS)], lambda texts: [_lists(codec(shared.value).encode(texts.to_pylist()))])


def decoded(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of the ids."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(rows: pa.Array) -> list[pa.Array]:
        return [pa.array(codec(shared.value).decode([np.array(r or [], np.int32) for r in rows.to_pylist()]), pa.string())]

    return _appended(df, ids, [(text, T.StringType())], work)


def round_trip(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """docs with ids, decoded, and whether that is the text; both ways in one pass over a slice."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> list[pa.Array]:
        own = codec(shared.value)
        ids = own.encode(texts.to_pylist())
        return [_lists(ids), pa.array(own.decode(ids), pa.string())]

    both = _appended(docs, text, [("ids", IDS), ("decoded", T.StringType())], work)
    return both.withColumn("same", F.col("decoded") == F.coalesce(F.col(text), F.lit("")))
