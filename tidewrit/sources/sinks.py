"""Sinks (K1 to K8): normalized text, preprocessed text, parallel corpora, operations, annotation sheets, evaluation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def text_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """K1: (id, line): one line a message, a line feed for blank ones."""
    return df.select(id_col, F.when(F.coalesce(F.trim(text_col), F.lit("")) == "", F.lit("\n")).otherwise(F.col(text_col)).alias("line"))


def write_text(df: DataFrame, path: str, id_col: str = "msg_id", text_col: str = "text_norm", mode: str = "errorifexists") -> None:
    """K1: the lines in message order. Order holds over the part files by name, so no single task writes them all."""
    text_lines(df, id_col, text_col).orderBy(id_col).select(F.col("line").alias("value")).write.mode(mode).text(path)


def kept_lines(df: DataFrame, text_col: str) -> DataFrame:
    """K2: the preprocessed lines that aren't blank."""
    return df.where(F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), "\n", "")) != "")


def deleted_lines(df: DataFrame, text_col: str) -> DataFrame:
    """K2: (kept, deleted) counts."""
    blank = F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), "\n", "")) == ""
    return df.agg(F.count_if(~blank).alias("kept"), F.count_if(blank).alias("deleted"))


def parallel_corpus(gold: DataFrame) -> DataFrame:
    """K4: (post, ori, tok, tgt) lines; written in the order of the posts' texts."""
    join = lambda c: F.array_join(c, " ").alias(c)
    return gold.where("tgt is not null").select("post", join("ori"), join("tok"), join("tgt"))


def write_parallel(gold: DataFrame, path: str) -> None:
    lines = parallel_corpus(gold).orderBy("post")
    for c, end in (("ori", "ori"), ("tok", "tok"), ("tgt", "tgt")):
        lines.select(F.col(c).alias("value")).write.mode("errorifexists").text(f"{path}.{end}")


def operation_rows(aligned: DataFrame) -> DataFrame:
    """K5: (type, text, alignment, oper, norm, row_no) of operations that change something; an empty alignment is ``???``."""
    o = aligned.select("oper", "norm", "row_no", F.explode("series").alias("o")).where("o.type <> 'normal'")
    return o.select("o.type", "o.text", F.coalesce(F.nullif("o.alignment", F.lit("")), F.lit("???")).alias("alignment"), "oper", "norm", "row_no")


def write_operations(aligned: DataFrame, path: str) -> None:
    operation_rows(aligned).write.mode("errorifexists").csv(path, sep=";")


def annotation_sheet(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """K6: (id, row_no, c0, c1, c2): a row a token, id and text on the first one only, and an empty row after each text."""
    t = df.select(F.col(id_col).alias("id"), F.translate(F.col(text_col), " ", " ").alias("text"))
    w = words(F.col("text"))
    rows = t.select("id", "text", F.posexplode(F.concat(w, F.array(F.lit("")))).alias("row_no", "c2"), F.size(w).alias("n"))
    first = (F.col("row_no") == 0) & (F.col("n") > 0)
    return rows.select("id", F.col("row_no").cast("int").alias("row_no"), F.when(first, F.col("id").cast("string")).otherwise("").alias("c0"), F.when(first, F.col("text")).otherwise("").alias("c1"), "c2")


def numbered_sheet(df: DataFrame, prefix: str, order_col: str, text_col: str) -> DataFrame:
    """K7: as K6 with ids ``prefix00001`` and on in the order of ``order_col``. Numbers follow a range partitioning: each
    part is counted, and only the parts' counts are summed up."""
    r = df.select(F.col(order_col).alias("o"), F.col(text_col).alias("text")).where("text is not null")
    from ..plans.pipeline import ranked

    numbered = ranked(r, ["o", "text"], "n")
    return annotation_sheet(numbered.select(F.format_string(f"{prefix}%05d", F.col("n")).alias("id"), "text"), "id", "text")


def write_logs(tables: dict[str, DataFrame], path: str) -> None:
    """K8: evaluation results, one folder a table."""
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")


