"""Sources (S1 to S12): messages, gold CSV sheets, JSON word lists, the run configuration."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = [f"c{i}" for i in range(22)]


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(msg_id, text) of a text file of one message a line. Ids follow the order of lines within a file's parts."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("msg_id"), F.col("value").alias("text"))


def read_new(spark: SparkSession, path: str, out: str) -> DataFrame:
    """As S1, refusing a missing input and an existing output."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    exists = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))
    if not exists(path):
        raise FileNotFoundError(path)
    if exists(out):
        raise FileExistsError(out)
    return read_messages(spark, path)


@dataclass(frozen=True)
class Config:
    """S3: what a run needs of its configuration file."""

    language: str = "en"
    setting: str = ""
    filter: str = "none"
    modules: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict, hash=False)


def read_config(path: str) -> Config:
    """S3: sections Language, SETTING, Filter and Modules; all options, with their section, are kept. A missing one raises."""
    ini = configparser.ConfigParser(strict=False)
    with open(path, encoding="utf-8") as f:
        ini.read_file(f)
    first = lambda s: next(iter(dict(ini.items(s)).values()))
    for section in ("Language", "Modules", "Filter"):
        if not ini.has_section(section) or not ini.items(section):
            raise KeyError(section)
    modules = tuple(m.strip() for v in dict(ini.items("Modules")).values() for m in v.split(",") if m.strip())
    setting = first("SETTING") if ini.has_section("SETTING") and ini.items("SETTING") else ""
    return Config(first("Language"), setting, first("Filter"), modules, {f"{s}.{k}": v for s in ini.sections() for k, v in ini.items(s)})


def cleaned(c: Column) -> Column:
    """S4 for a cell: no left-to-right marks, plain blanks, trimmed, one pass over double blanks."""
    return F.replace(F.trim(F.translate(F.coalesce(c, F.lit("")), " ‎", " ")), F.lit("  "), F.lit(" "))


def google_docs(c: Column) -> Column:
    """Apostrophes that a spreadsheet put before a sign; zero first, then apostrophe, equals sign, plus."""
    for sign in ("0", "'", "=", "\\+"):
        c = F.regexp_replace(c, f"^'{sign}", sign.replace("\\", "") if sign != "'" else "'")
    return c


def read_sheet(spark: SparkSession, path: str, delimiter: str = ",", header: bool = False, google_doc: bool = False, encoding: str = "utf-8") -> DataFrame:
    """(file, row_no, c0..c21) of gold CSV sheets in the spreadsheet dialect; quoted cells may hold line breaks.

    A sheet is read whole by one task, since its cells may span lines; many sheets are read by many tasks.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
    raw = spark.read.csv(path, schema=schema, sep=delimiter, header=header, multiLine=True, quote='"', escape='"', encoding=encoding, mode="PERMISSIVE")
    fix = (lambda c: google_docs(cleaned(c))) if google_doc else cleaned
    return raw.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row_no"), *[fix(F.col(c)).alias(c) for c in COLUMNS])


def without_skipped(sheet: DataFrame) -> DataFrame:
    """Rows of posts whose first row has a skip flag are dropped. Sheets are ordered by ``row_no`` within ``file``."""
    w = Window.partitionBy("file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    s = sheet.withColumn("post_no", F.sum(F.when(F.col("c2") != "", 1).otherwise(0)).over(w))
    first = F.first("c0").over(Window.partitionBy("file", "post_no").orderBy("row_no"))
    return s.withColumn("_skip", (F.col("post_no") > 0) & (first != "")).where("not _skip").drop("_skip", "post_no")


def gold_rows(sheet: DataFrame, wide: bool = False) -> DataFrame:
    """(file, row_no, post, pos, ori, tok, tgt, is_ne): the post's text is carried forward, empty rows are dropped,
    missing forms are the original, a flag in c7 to c9 makes token and target the placeholder. ``wide``: the entity label
    is in c21, else any mark in c10."""
    w = Window.partitionBy("file").orderBy("row_no")
    s = sheet.withColumn("post", F.last(F.nullif("c2", F.lit("")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.where("c3 <> '' and post is not null")
    flag = (F.col("c7") != "") | (F.col("c8") != "") | (F.col("c9") != "")
    default = lambda c: F.when(flag, F.lit("•")).when(F.col(c) == "", F.col("c3")).otherwise(F.col(c))
    ne = ~F.col("c21").isin("O", "") if wide else F.col("c10") != ""
    pos = (F.row_number().over(Window.partitionBy("file", "post").orderBy("row_no")) - 1).cast("int")
    return s.select("file", "row_no", "post", pos.alias("pos"), F.col("c3").alias("ori"), default("c4").alias("tok"), default("c6").alias("tgt"), ne.alias("is_ne"))


def gold_records(rows: DataFrame) -> DataFrame:
    """(post, ori, tok, tgt, ne) of gold rows; of posts with the same text the last sheet row's record wins."""
    part = F.array_sort(F.collect_list(F.struct("pos", "ori", "tok", "tgt", "is_ne")))
    g = rows.groupBy("file", "post").agg(part.alias("t"), F.max("row_no").alias("last"))
    g = g.groupBy("post").agg(F.max_by("t", F.struct("file", "last")).alias("t"))
    ne = F.transform(F.filter("t", lambda x: x["is_ne"]), lambda x: x["pos"])
    return g.select("post", F.col("t.ori").alias("ori"), F.col("t.tok").alias("tok"), F.col("t.tgt").alias("tgt"), ne.alias("ne"))


def completed(rows: DataFrame) -> DataFrame:
    """An empty token cell is the original."""
    return rows.withColumn("tok", F.when(F.coalesce("tok", F.lit("")) == "", F.col("anom")).otherwise(F.col("tok")))


def checked_width(rows: DataFrame, cells: str, offset: int) -> DataFrame:
    """Rows of ``cells`` ARRAY<STRING> must have four cells from ``offset`` on; a shorter row fails the query."""
    message = F.concat(F.lit("row has too few cells: "), F.size(cells).cast("string"))
    return rows.withColumn(cells, F.when(F.size(cells) >= offset + 4, F.col(cells)).otherwise(F.raise_error(message)))


def read_json_words(spark: SparkSession, path: str, key: str = "key", value: str = "expansion") -> DataFrame:
    """(key, value) of a JSON file that is one object of strings."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def load_model(path: str):
    """A stored pipeline model, loaded once per session."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
