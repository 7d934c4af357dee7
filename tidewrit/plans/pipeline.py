"""Whole runs: preprocess, normalize, evaluate; each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import decide, evaluate, filtering, flooding, prepro, suggest
from .shared import written


def ranked(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Numbers from 1 in the order of ``order`` without gathering rows in one task: rows are range partitioned, numbered
    within their part, and shifted by the sizes of the parts before. One row a part reaches a single task."""
    # The number of parts is fixed and the parts are written once, so that rows and sizes agree whatever AQE does.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    inner = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(before.select("_p", "_b"), "_p").withColumn(out, F.col("_n") + F.col("_b")).drop("_p", "_n", "_b")


def tokens_of(df: DataFrame, id_col: str = "msg_id", text_col: str = "text_flood") -> DataFrame:
    """D3: (msg_id, pos, tok), partitioned by message for the windows that follow."""
    return df.select(F.col(id_col).alias("msg_id"), F.posexplode(words(F.col(text_col))).alias("pos", "tok"))


def preprocess_run(messages: DataFrame, known: DataFrame, language: str = "en") -> DataFrame:
    """(msg_id, text_prepro, text_flood): P0, then L5."""
    p = prepro.preprocess(messages.select("msg_id", "text_orig")).select("msg_id", "text_prepro")
    return flooding.correct(p, known, language=language, keep=("text_prepro",))


def normalize(messages: DataFrame, res: dict[str, DataFrame], names: list[str] | None = None, mode: str = "none", language: str = "en", decoder: str = "place") -> DataFrame:
    """(msg_id, text_norm): the whole run. ``mode``: none, hard or soft filtering; ``decoder``: place or viterbi.

    ``names``: the modules, all of the language's by default. ``res``: lexicon, abbreviation, flooding_abbrev, gazetteer,
    gold, and bigram for filtering and viterbi. Modules that go by the token alone run once per distinct token.
    """
    known = flooding.known_words(res["lexicon"], res["flooding_abbrev"])
    names = list(names or suggest.FULL[language])
    # The tokens are read by several branches and dear to make.
    tokens = written(tokens_of(preprocess_run(messages, known, language).select("msg_id", "text_flood")))
    if mode == "hard":
        flags = filtering.preclassify(tokens, res["bigram"])
        keep = filtering.hard_filter(flags, suggest.entity_flags(tokens, res["gazetteer"])).withColumn("to_correct", F.lit(True))
        tokens = tokens.join(keep, ["msg_id", "pos"], "left").withColumn("to_correct", F.coalesce("to_correct", F.lit(False)))
    if mode != "soft" and decoder == "place" and "original" in names and "named_entities" not in names:
        at = names.index("compound") if "compound" in names else None
        rows = suggest.compound_rows(tokens, res["lexicon"]) if at is not None else suggest.unchanged_rows(tokens)
        best = decide.best_by_token(rows, suggest.token_options(tokens, names, res), res["lexicon"], at)
        return _lines(messages, best)
    all_modules = suggest.modules(res)
    s = decide.union({n: all_modules[n](tokens) for n in names})
    if mode == "soft":
        flags = filtering.preclassify(tokens, res["bigram"])
        soft = filtering.soft_filter(s.select("msg_id", "seg", "module", "ori", "alt"), flags)
        s = s.join(soft.select("msg_id", "seg", "module", "pre", "ne"), ["msg_id", "seg", "module"]).where("pre = 1 or mod_ord = 0").drop("pre", "ne")
    best = decide.viterbi(s, res["bigram"]) if decoder == "viterbi" else decide.best_by_place(s, res["lexicon"])
    return _lines(messages, best)


def _lines(messages: DataFrame, best: DataFrame) -> DataFrame:
    """(msg_id, text_norm) of each message, a line feed where nothing is left."""
    out = decide.assemble(best)
    return messages.select("msg_id").distinct().join(out, "msg_id", "left").select("msg_id", F.coalesce("text_norm", F.lit("\n")).alias("text_norm"))


def module_pairs(gold: DataFrame, res: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(post_id, seg, module, ori, alt, tgt, is_ne) of the modules' outputs on gold tokens."""
    g = evaluate.gold_tokens(gold)
    tokens = g.select(F.col("post_id").alias("msg_id"), "pos", "tok")
    all_modules = suggest.modules(res)
    outputs = decide.union({n: all_modules[n](tokens) for n in names}).withColumnRenamed("msg_id", "post_id")
    return evaluate.ne_target(evaluate.by_occurrence(outputs.select("post_id", "seg", "module", "ori", "alt"), g))
