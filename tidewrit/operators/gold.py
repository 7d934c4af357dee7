"""Gold annotations (G1 to G18): the edit-operation language, its validation and alignment, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One operation of the language; a deletion, a transposition, a substitution, an insertion, or a letter.
OPERATION = r"<del>(.+?)</del>|<trans>(.+?)</trans>|§(.+?)§|#|[\s\S]"
SERIES = "array<struct<type:string,text:string,alignment:string>>"
CODES = ["Surplus", "Misc", "NoPermMatch", "TooManyPermMatch", "NoCommonSubstring", "NoNextMatch", "UnequalLengthSubstitution", "NoOperations", "DelTag", "TransTag", "TokCorrespondence", "NormCorrespondence"]


def parsed(oper: Column) -> Column:
    """The operations of a cell as ARRAY<STRUCT<type, text>>."""
    def one(x: Column) -> Column:
        kind = F.when(x.rlike("^<del>.+?</del>$"), "deletion").when(x.rlike("^<trans>.+?</trans>$"), "transposition").when(x.rlike("^§.+?§$"), "substitution").when(x == "#", "insertion").otherwise("normal")
        return F.struct(kind.alias("type"), F.regexp_replace(x, "^(?:<del>|<trans>|§)(.+?)(?:</del>|</trans>|§)$", "$1").alias("text"))

    return F.transform(F.regexp_extract_all(oper, F.lit(OPERATION), F.lit(0)), one)


def _count(t: Column, tag: str) -> Column:
    return F.regexp_count(t, F.lit(tag))


def no_operations_error(tok: Column, oper: Column, norm: Column) -> Column:
    """Without operations the norm is empty, the token but for case, or the token without [..]."""
    bare = F.regexp_replace(norm, r"\[.*?\]", "")
    return F.when((oper == "") & (norm != "") & (F.lower(norm) != F.lower(tok)) & (F.lower(bare) != F.lower(tok)), F.lit("NoOperations"))


def del_tag_error(oper: Column) -> Column:
    """G4."""
    return F.when(_count(oper, "<del>") != _count(oper, "</del>"), F.lit("DelTag"))


def trans_tag_error(oper: Column) -> Column:
    """G5."""
    return F.when(_count(oper, "<trans>") != _count(oper, "</trans>"), F.lit("TransTag"))


def tok_error(tok: Column, oper: Column) -> Column:
    """The operations without their marks are the token, but for blanks and case."""
    bare = F.replace(F.regexp_replace(oper, "</?del>|</?trans>|§|#", ""), F.lit(" "), F.lit(""))
    return F.when(F.lower(bare) != F.lower(F.replace(tok, F.lit(" "), F.lit(""))), F.lit("TokCorrespondence"))


def validated(rows: DataFrame) -> DataFrame:
    """G7 with G13: rows (anom, tok, oper, norm) with the token filled in and ``error_code``, the first error, or null."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    r = rows.withColumn("tok", F.when(blank("tok") == "", F.col("anom")).otherwise(F.col("tok"))).withColumn("oper", blank("oper")).withColumn("norm", blank("norm"))
    tok, oper, norm = F.col("tok"), F.col("oper"), F.col("norm")
    some = oper != ""
    return r.withColumn("error_code", F.coalesce(no_operations_error(tok, oper, norm), F.when(some, F.coalesce(del_tag_error(oper), trans_tag_error(oper), tok_error(tok, oper)))))


class AlignError(Exception):
    """An alignment that fails; its text is one of CODES."""


def permutations(text: str) -> set[str]:
    """G10, for short texts: all orders of the letters. Alignment itself compares sorted letters instead."""
    if len(text) < 2:
        return {text}
    return {c + rest for i, c in enumerate(text) for rest in permutations(text[:i] + text[i + 1 :])}


def overlap(left: str, right: str) -> str:
    """The longest suffix of the one that is a prefix of the other."""
    for n in range(min(len(left), len(right)), 0, -1):
        if left[-n:] == right[:n]:
            return left[-n:]
    raise AlignError("NoCommonSubstring")


def _spread(subs: list[list], text: str) -> list[list]:
    """The text spread over adjacent substitutions: one each, ``ij`` read as y, or all for a single one."""
    if len(subs) == 1:
        return [[subs[0][0], subs[0][1], text]]
    letters = list(text)
    if len(letters) != len(subs):
        letters = list(text.replace("ij", "y"))
    if len(letters) != len(subs):
        raise AlignError("UnequalLengthSubstitution")
    return [[k, t, "ij" if c == "y" and c not in text else c] for (k, t, _), c in zip(subs, letters)]


def _plain(series: list[list], text: str, from_end: bool) -> tuple[list[list], str]:
    """One-to-one operations against one end of the text; what is left of the text comes back."""
    out, at = [], len(text) if from_end else 0
    for kind, t, _ in reversed(series) if from_end else series:
        if kind == "deletion":
            out.append([kind, t, ""])
            continue
        if not (at if from_end else at < len(text)):
            raise AlignError("Misc")
        at -= from_end
        c = text[at]
        at += not from_end
        if kind == "normal" and c.lower() != t.lower():
            raise AlignError("NormCorrespondence")
        out.append([kind, t, c])
    return (out[::-1], text[:at]) if from_end else (out, text[at:])


def align_series(series: list[list], text: str) -> tuple[list[list], str]:
    """Operations with their alignments, and the surplus at the end of the text.

    A transposition is the one window of the text with the same letters; a run of substitutions takes what the
    operations before it leave on their right and the ones after it leave on their left.
    """
    kinds = [k for k, _, _ in series]
    if "transposition" in kinds:
        i = kinds.index("transposition")
        want, n = sorted(series[i][1]), len(series[i][1])
        found = {text[a : a + n] for a in range(len(text) - n + 1) if sorted(text[a : a + n]) == want}
        if len(found) != 1:
            raise AlignError("TooManyPermMatch" if found else "NoPermMatch")
        match = found.pop()
        head, tail = text.split(match, 1)
        before, rest = align_series(series[:i], head)
        after, more = align_series(series[i + 1 :], tail)
        if rest or more:
            raise AlignError("Surplus")
        return [*before, ["transposition", series[i][1], match], *after], ""
    if "substitution" in kinds:
        i = kinds.index("substitution")
        j = i
        while j < len(kinds) and kinds[j] == "substitution":
            j += 1
        before, rest = _plain(series[:i], text, False)
        following = series[j:]
        if "substitution" in kinds[j:]:
            # Where the next plain operation first fits, the rest of the series begins.
            for at in range(1, len(rest) + 1):
                try:
                    after, surplus = align_series(following, rest[at:])
                    return [*before, *_spread(series[i:j], rest[:at]), *after], surplus
                except AlignError:
                    continue
            raise AlignError("NoNextMatch")
        after, _ = _plain(following, rest, True)
        used = sum(k != "deletion" for k, _, _ in following)
        middle = rest[: len(rest) - used] if used else rest
        if following and used and not middle:
            raise AlignError("NoNextMatch")
        return [*before, *_spread(series[i:j], middle), *after], ""
    return _plain(series, text, False)


def align_entire(series: list[list], text: str) -> tuple[list[list], str | None]:
    """The aligned series and the error, if any."""
    try:
        out, surplus = align_series([list(x) for x in series], text)
        return out, "Surplus" if surplus else None
    except AlignError as e:
        return [], str(e)


def aligned(rows: DataFrame) -> DataFrame:
    """Validated rows (with ``row_no``) with ``series``, aligned to the norm, and ``align_error``. Rows without
    operations align letter by letter; rows that fail validation keep an empty series."""
    v = validated(rows).withColumn("target", F.when(F.col("norm") == "", F.col("tok")).otherwise(F.col("norm")))
    v = v.withColumn("ops", F.when(F.col("oper") != "", parsed(F.col("oper"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("alignment", pa.string())]))
        for batch in batches:
            series, errors = [], []
            for ops, tok, target, code in zip(*(batch.column(c).to_pylist() for c in ("ops", "tok", "target", "error_code"))):
                if code or tok is None:
                    series.append([]), errors.append(code)
                    continue
                given = [[o["type"], o["text"], None] for o in ops] if ops is not None else [["normal", c, None] for c in tok]
                out, error = align_entire(given, target or "")
                series.append([{"type": k, "text": t, "alignment": a} for k, t, a in out]), errors.append(error)
            keep = [batch.column(c) for c in ("row_no", "tok", "oper", "norm", "error_code")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(series, kind), pa.array(errors, pa.string())], names=["row_no", "tok", "oper", "norm", "error_code", "series", "align_error"])

    return v.select("row_no", "tok", "oper", "norm", "error_code", "target", "ops").mapInArrow(run, f"row_no bigint, tok string, oper string, norm string, error_code string, series {SERIES}, align_error string")


def flag_warnings(rows: DataFrame) -> DataFrame:
    """(row_no, flag, warning) of flag cells (row_no, anom, tok, norm, flag): a cell is ``x``, parts of the norm around
    a placeholder, or a list of 1-based word numbers within the norm."""
    r = rows.where("flag <> ''").withColumn("n", F.coalesce(F.nullif("norm", F.lit("")), F.nullif("tok", F.lit("")), F.col("anom")))
    symbol = F.col("flag").rlike("[•±∞™]")
    parts_ok = F.forall(F.split("flag", "[•±∞™]"), lambda p: F.contains(F.col("n"), p))
    numbers = F.transform(F.split("flag", ","), lambda p: F.trim(p).try_cast("int"))
    size = F.size(F.split("n", " "))
    warning = (
        F.when(symbol, F.when(~parts_ok, "special character column"))
        .when(F.col("flag") == "x", None)
        .when(F.exists(numbers, lambda i: i.isNull()), "unexpected flag")
        .when(F.exists(numbers, lambda i: (i < 1) | (i > size)), "flag index out of range")
    )
    return r.select("row_no", "flag", warning.alias("warning")).where("warning is not null")


def length_histograms(rows: DataFrame) -> DataFrame:
    """(measure, length, n): lengths of token and norm and their difference."""
    measures = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), length.alias("length")) for name, length in (("tok", F.length("tok")), ("norm", F.length("norm")), ("difference", F.length("norm") - F.length("tok")))]))
    return rows.select(measures.alias("m")).groupBy("m.measure", "m.length").agg(F.count(F.lit(1)).alias("n"))


def average_lengths(histograms: DataFrame) -> DataFrame:
    """(measure, mean)."""
    return histograms.groupBy("measure").agg(F.round(F.sum(F.col("length") * F.col("n")) / F.sum("n"), 6).alias("mean"))


def operation_counts(rows: DataFrame) -> DataFrame:
    """(type, n) of the operations of rows with ``oper``."""
    return rows.select(F.explode(parsed(F.col("oper"))).alias("o")).groupBy("o.type").agg(F.count(F.lit(1)).alias("n"))
