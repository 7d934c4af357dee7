"""Preclassification (F0 to F4): which tokens may be corrected, by a bigram list of correct text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sentence_bigrams(tokens: DataFrame) -> DataFrame:
    """T5: (msg_id, pos, w1, w2) for pos 0..n: each token with its left neighbour, and the last one with the end."""
    w = Window.partitionBy("msg_id").orderBy("pos")
    t = tokens.select("msg_id", F.col("pos").cast("int").alias("pos"), "tok").withColumn("prev", F.coalesce(F.lag("tok").over(w), F.lit("<s>"))).withColumn("last", F.lead("tok").over(w).isNull())
    pair = F.when(F.col("last"), F.array(F.struct(F.col("pos"), F.col("prev").alias("w1"), F.col("tok").alias("w2")), F.struct((F.col("pos") + 1).alias("pos"), F.col("tok").alias("w1"), F.lit("</s>").alias("w2")))).otherwise(
        F.array(F.struct(F.col("pos"), F.col("prev").alias("w1"), F.col("tok").alias("w2")))
    )
    return t.select("msg_id", F.explode(pair).alias("p")).select("msg_id", "p.pos", "p.w1", "p.w2")


def bigram_model(sentences: DataFrame) -> DataFrame:
    """(w1, w2, cnt) of token sequences (msg_id, pos, tok)."""
    return sentence_bigrams(sentences).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("cnt"))


def preclassify(tokens: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(msg_id, pos, tok, to_correct): both the left and the right bigram of a token are missing.

    One window gives both neighbours; the model is met by two left joins on distinct keys.
    """
    w = Window.partitionBy("msg_id").orderBy("pos")
    t = tokens.select("msg_id", F.col("pos").cast("int").alias("pos"), "tok")
    t = t.withColumn("l", F.coalesce(F.lag("tok").over(w), F.lit("<s>"))).withColumn("r", F.coalesce(F.lead("tok").over(w), F.lit("</s>")))
    b = bigrams.select("w1", "w2").distinct()
    left = b.select(F.col("w1").alias("l"), F.col("w2").alias("tok"), F.lit(True).alias("hl"))
    right = b.select(F.col("w1").alias("tok"), F.col("w2").alias("r"), F.lit(True).alias("hr"))
    t = t.join(left, ["l", "tok"], "left").join(right, ["tok", "r"], "left")
    return t.select("msg_id", "pos", "tok", (F.col("hl").isNull() & F.col("hr").isNull()).alias("to_correct"))


def word_flags(flags: DataFrame) -> DataFrame:
    """(msg_id, tok, flag): by word, the last occurrence decides."""
    return flags.groupBy("msg_id", "tok").agg(F.max_by("to_correct", "pos").alias("flag"))


def hard_filter(flags: DataFrame, entities: DataFrame) -> DataFrame:
    """(msg_id, pos) to correct, entities left out."""
    ne = entities.where("is_ne").select("msg_id", F.col("seg").alias("pos"))
    return flags.where("to_correct").select("msg_id", "pos").join(ne, ["msg_id", "pos"], "left_anti")


def soft_filter(suggestions: DataFrame, flags: DataFrame) -> DataFrame:
    """suggestions (msg_id, seg, module, ori, alt) with two more features: ``pre``, a word of the original is flagged,
    and ``ne``, the original stands behind an entity symbol in some suggestion."""
    by_word = word_flags(flags).where("flag").select("msg_id", F.col("tok").alias("part"))
    parts = suggestions.select("msg_id", "ori").distinct().withColumn("part", F.explode(F.split("ori", " ")))
    pre = parts.join(by_word, ["msg_id", "part"], "left_semi").select("msg_id", "ori").distinct().withColumn("pre", F.lit(1))
    ne = suggestions.where(F.col("alt") == "ਊ").select("msg_id", "ori").distinct().withColumn("ne", F.lit(1))
    out = suggestions.join(pre, ["msg_id", "ori"], "left").join(ne, ["msg_id", "ori"], "left")
    return out.select("msg_id", "seg", "module", "ori", "alt", F.coalesce("pre", F.lit(0)).alias("pre"), F.coalesce("ne", F.lit(0)).alias("ne"))
