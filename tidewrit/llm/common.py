"""Shared pieces of the operators in this subpackage: tables, code-point arrays, ragged arrays.

Python stages exchange Arrow record batches (``mapInArrow``); inside a batch, texts are handled as one
code-point array with offsets, or as dictionary-encoded tokens, so that no step loops over rows where
numpy or Arrow can take the whole batch.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Characters with the Unicode property White_Space (fixed values).
WHITE = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``messages`` with one row per ``msg_id``: a second delivery has the same values, so any of them will do."""
    return table(spark, sf_dir, "messages").select("msg_id", *columns).where("msg_id is not null").dropDuplicates(["msg_id"])


def bounded(df: DataFrame, most: int, what: str) -> list:
    """Collect a table that must be small; more than ``most`` rows are an error, never a silent cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; raise its documented bound")
    return rows


def hash_bound(most: int, rows: int, spare: float = 4.0) -> int:
    """A bound on 64-bit hashes below which ``spare`` times ``most`` of ``rows`` uniformly hashed rows lie.

    Taking the smallest hashes of a table would send that many rows of every partition to the driver; below the bound
    there are few rows in all, however large the table is.
    """
    return min(2**63 - 1, -(2**63) + int(min(1.0, spare * most / max(1, rows)) * 2**64))


_folders: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which a cluster has to name.

    Only where driver and executors are one machine (local mode, as in tests) a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewrit-")
        spark.conf.set("spark.checkpoint.dir", base)
    at = os.path.join(base, f"tidewrit-{uuid.uuid4().hex}")
    _folders.append(at)
    return at


def tidy(spark: SparkSession) -> None:
    """Delete the folders that queries of this session have written; their results can't be read after that."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _folders:
        path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder once and read it back."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint32 array of code points, and their n + 1 offsets."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return flat, offsets


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[starts[i] : starts[i] + lengths[i]]`` for all i."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    out = np.ones(total, np.int64)
    nonzero = lengths > 0
    s, n = starts[nonzero], lengths[nonzero]
    first = np.zeros(len(n), np.int64)
    np.cumsum(n[:-1], out=first[1:])
    out[0] = s[0]
    out[first[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return values[np.cumsum(out)]


def list_parts(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Flattened values of a list column and the length of each list (0 for null)."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), lengths


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


class Memo(dict):
    """A bounded memo of a pure function: emptied when full, so it never changes a result."""

    def __init__(self, function, most: int = 200_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value
