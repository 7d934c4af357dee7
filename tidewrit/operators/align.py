"""Alignment of an original with a changed text (A1, A2): segments that both texts cut at a blank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond so many tokens of the original, tokens are paired by place (fixed value).
GUARD = 250
MATCH, MISMATCH, GAP = 2, -1, -2


def _cuts(a: str, b: str) -> list[tuple[int, int]]:
    """Places (i, j) of blanks that a global alignment of the characters lays on each other.

    Of equal scores a diagonal step is preferred, then a step in ``a``, then one in ``b``. Rows are filled along
    anti-diagonals, a whole one at a time.
    """
    if a == b:
        return [(i, i) for i, c in enumerate(a) if c == " "]
    n, m = len(a), len(b)
    x, y = np.array([ord(c) for c in a]), np.array([ord(c) for c in b])
    score = np.zeros((n + 1, m + 1), np.int32)
    score[:, 0], score[0, :] = np.arange(n + 1) * GAP, np.arange(m + 1) * GAP
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        diag = score[i - 1, j - 1] + np.where(x[i - 1] == y[j - 1], MATCH, MISMATCH)
        score[i, j] = np.maximum(diag, np.maximum(score[i - 1, j], score[i, j - 1]) + GAP)
    out, i, j = [], n, m
    while i and j:
        if score[i, j] == score[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
            if a[i] == " " == b[j]:
                out.append((i, j))
        elif score[i, j] == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def by_place(ori: list[str], tgt: list[str]) -> list[tuple[str, str]]:
    """Tokens paired by place, what is left over joined to the last pair."""
    n = min(len(ori), len(tgt))
    if not n:
        return [(" ".join(ori), " ".join(tgt))] if ori or tgt else []
    pairs = list(zip(ori[: n - 1], tgt[: n - 1]))
    return [*pairs, (" ".join(ori[n - 1 :]), " ".join(tgt[n - 1 :]))]


def aligned(ori: str, tgt: str) -> tuple[list[tuple[str, str]], bool]:
    """Segments (original, target), and whether the fallback by place was taken. Case is ignored, and kept in the result."""
    o, t = ori.split(), tgt.split()
    if not o or not t or len(o) >= GUARD:
        return by_place(o, t), len(o) >= GUARD
    a, b = " ".join(o), " ".join(t)
    if len(a.lower()) != len(a) or len(b.lower()) != len(b):
        return by_place(o, t), True
    out, i, j = [], 0, 0
    for x, y in [*_cuts(a.lower(), b.lower()), (len(a), len(b))]:
        out.append((a[i:x], b[j:y]))
        i, j = x + 1, y + 1
    return out, False


def align(df: DataFrame, id_col: str, ori_col: str, tgt_col: str) -> DataFrame:
    """(id, seg, ori, tgt, align_fallback) of each row; nulls count as empty texts. Rows go in Arrow batches."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seg, ori, tgt, fall = [], [], [], [], []
            for k, (o, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                pairs, fallback = aligned(o or "", t or "")
                for s, (p, q) in enumerate(pairs):
                    rows.append(k), seg.append(s), ori.append(p), tgt.append(q), fall.append(fallback)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(seg, pa.int32()), pa.array(ori, pa.string()), pa.array(tgt, pa.string()), pa.array(fall, pa.bool_())], names=[id_col, "seg", "ori", "tgt", "align_fallback"])

    return df.select(id_col, ori_col, tgt_col).mapInArrow(run, f"`{id_col}` {kind}, seg int, ori string, tgt string, align_fallback boolean")


def without_unk(t: Column) -> Column:
    """Marks of unknown words taken away."""
    return F.regexp_replace(t, r"(\|UNK[BQk]?)+", "")


def combine(df: DataFrame, id_col: str, ori_col: str, tgt_col: str) -> DataFrame:
    """A2: T6, then A1."""
    return align(df.withColumn(tgt_col, without_unk(F.col(tgt_col))), id_col, ori_col, tgt_col)


# Replacements on the way to a web service, and back, in order.
ESCAPES = [(" ", "%20"), ("&", "ʚ"), ("\n", "%0A"), ("|", "ʘ"), (";", "Þ"), ("-", "¥"), ("#", "¤")]
UNESCAPES = [("¤", "#"), ("¥", "-"), ("ʚ", "&"), ("ʘ", "|"), ("%0A", "\n"), ("£", " "), ("%20", " "), ("Þ", ";")]


def replaced(t: Column, table: list[tuple[str, str]]) -> Column:
    """The literal replacements of a table, in order."""
    for a, b in table:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t
