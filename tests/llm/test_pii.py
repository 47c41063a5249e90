"""Personal data against a plain scan, and its defined cases."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import pii
from tickloom.llm.queries import op9_pii


def plain(t):
    """The base kinds with the patterns as stated."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def base(t):
    return [s[:3] for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-_+ (1490258é", max_size=60))
def test_matches_the_stated_patterns(t):
    assert base(t) == plain(t)


def test_query_matches_plain_scan(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        text = ",".join(":".join(map(str, s)) for s in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and [s for s in r.spans.split(",") if "iban" not in s] == text.split(",")


def test_checksums_and_context():
    iban = "Konto DE89 3704 0044 0532 0130 00 HIER"
    assert pii.find_spans(iban) == [("iban", 6, 33, 0.9)]
    assert pii.find_spans(iban.replace("89", "88")) == []
    card = "visa 4111 1111 1111 1111 or 4111 1111 1111 1112"
    assert [s[:3] for s in pii.find_spans(card)] == [("card", 5, 24)]
    near, far = pii.find_spans("server 10.0.0.1")[0], pii.find_spans("version 10.0.0.1")[0]
    assert near[3] > 0.6 > far[3]
    assert pii.masked("a b@c.de +1 (017) 555-7713.", pii.find_spans("a b@c.de +1 (017) 555-7713.")) == "a <EMAIL> <PHONE>."


def test_long_runs_are_linear():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "+1" + "(" * 300_000, "1." * 150_000, "a@" * 150_000):
        assert isinstance(pii.find_spans(t), list)


def test_defined_cases(spark):
    rows = [(1, None, 0, "x"), (None, "", 0, "y"), (2, "mail é@x.y z@x.y", 99, None), (2, "mail é@x.y z@x.y", 99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    found = pii.find_pii(docs).collect()
    assert [[tuple(s)[:3] for s in r.spans] for r in found] == [[], []] + [[("email", 11, 16)]] * 2
    hidden = pii.mask_pii(docs)
    assert hidden.columns == docs.columns
    assert [(r.text, r.n_chars) for r in hidden.collect()] == [(None, None), ("", 0)] + [("mail é@x.y <EMAIL>", 18)] * 2
    assert pii.mask_pii(docs.limit(0)).count() == 0


def test_accounts_beside_each_other():
    two = "DE89370400440532013000 GB82WEST12345698765432"
    assert [s[:3] for s in pii.find_spans(two) if s[0] == "iban"] == [("iban", 0, 22), ("iban", 23, 45)]
    behind = "XX12 AB34 DE89 3704 0044 0532 0130 00"  # candidates that fail in front of one
    assert [s[:3] for s in pii.find_spans(behind) if s[0] == "iban"] == [("iban", 10, 37)]
    assert isinstance(pii.find_spans("DE89 " * 60_000), list)


def test_accounts_of_all_countries():
    for text in ("TR330006100519786457841326", "SA0380000000608010167519", "AE070331234567890123456", "UA213223130000026007233566001", "BR1800360305000010009795493C1",
                 "IL620108000000099999999", "MT84MALT011000012345MTLCAST001S", "RU0304452522540817810538091310419"):
        assert [s[:3] for s in pii.find_spans(f"konto {text}.") if s[0] == "iban"] == [("iban", 6, 6 + len(text))]
    for country, size in pii.IBAN_LENGTH.items():  # a number of each length with its check digits
        rest = "1" * (size - 4)
        check = 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97
        assert [s for s in pii.find_spans(f"{country}{check:02d}{rest}") if s[0] == "iban"]


def test_confirmed_numbers_stay_masked_beside_contrary_words():
    text = "a test account, sample: DE89370400440532013000, example card 4111 1111 1111 1111, sample version 10.0.0.1"
    scores = {k: s for k, _, _, s in pii.find_spans(text)}
    assert scores["iban"] >= pii.THRESHOLD and scores["card"] >= pii.THRESHOLD and scores["ip"] < pii.THRESHOLD
    assert "DE89" not in pii.masked(text, pii.find_spans(text)) and "4111" not in pii.masked(text, pii.find_spans(text))
