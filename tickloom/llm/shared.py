"""Tables of a data folder and intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, by which the contracts separate words (Java, Python and DuckDB read it alike).
SPACE = r"[\x20\x09-\x0D]+"

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes:
    """64-bit hashes of words, kept while they fit."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    @staticmethod
    def words(text: str | None) -> list[bytes]:
        """Words parted by ASCII white space, A-Z in lower case."""
        return (text or "").encode().translate(LOWER).split()

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed_runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n hashes, another one for each n."""
    last = max(len(hashes) - n + 1, 0)
    x = hashes[:last] + np.uint64(n)
    for k in range(1, n):
        x = (x ^ (x >> np.uint64(29))) * MIX[0] + hashes[k:last + k]
    x = (x ^ (x >> np.uint64(32))) * MIX[1]
    return x ^ (x >> np.uint64(29))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a temporary folder, and only if all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of saved tables that are still in use, by the table's identity.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def saved(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df written once to the shared folder and read back: it cuts lineage and outlives lost executors.

    files: at most so many, for tables known to be small beside the number of shuffle partitions."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those of smallest key hash. A threshold on the hash first leaves about twice as many in all, so
    that the exact cut isn't taken from as many rows of every task."""
    share, place = 2 * most / max(df.count(), 1), F.pmod(F.xxhash64(key), F.lit(1 << 40))
    return (df.where(place < int(share * (1 << 40))) if share < 1 else df).orderBy(place, key).limit(most)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a saved table that no later step reads; no file names are listed for it."""
    delete(df.sparkSession, _FOLDERS.pop(df))
