"""Evaluation (V1 to V11): suggestions against gold tokens, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cer, wer, words

JOIN_TAG, SPLIT_TAG, LINE_TAG = "<com>", "<split>", "<LINEBREAK>"


def gold_tokens(gold: DataFrame) -> DataFrame:
    """(post_id, pos, ori, tok, tgt, is_ne) of gold records; records without target are left out, copies count once."""
    g = gold.where("tgt is not null").select("post_id", "ori", "tok", "tgt", "ne").distinct()
    z = g.select("post_id", "ne", F.posexplode(F.arrays_zip("ori", "tok", "tgt")).alias("pos", "z"))
    return z.select("post_id", F.col("pos").cast("int").alias("pos"), F.col("z.ori").alias("ori"), F.col("z.tok").alias("tok"), F.col("z.tgt").alias("tgt"), F.coalesce(F.array_contains("ne", F.col("pos").cast("int")), F.lit(False)).alias("is_ne"))


def realigned(tokens: DataFrame) -> DataFrame:
    """V1: (post_id, pair, ori, tgt): line breaks dropped; a joined token goes into its predecessor's original, a split one
    into its predecessor's target."""
    w = Window.partitionBy("post_id").orderBy("pos")
    t = tokens.where(F.col("ori") != LINE_TAG)
    com, split = F.lower("tgt") == JOIN_TAG, F.lower("ori") == SPLIT_TAG
    t = t.withColumn("com", com).withColumn("split", split).withColumn("pair", F.sum((~(com | split)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sort = lambda c, keep: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("x"), F.col(keep).alias("drop")))), lambda s: ~s["drop"]), lambda s: s["x"]), " ")
    return t.groupBy("post_id", "pair").agg(sort("ori", "split").alias("ori"), sort("tgt", "com").alias("tgt")).where("pair > 0").select("post_id", F.col("pair").cast("int").alias("pair"), "ori", "tgt")


def by_occurrence(output: DataFrame, gold: DataFrame) -> DataFrame:
    """V2: output (post_id, seg, module, ori, alt) with the target of the equal gold token, the k-th for the k-th."""
    o = output.withColumn("k", F.row_number().over(Window.partitionBy("post_id", "module", "ori").orderBy("seg")))
    g = gold.select("post_id", F.col("tok").alias("ori"), "tgt", "is_ne", F.row_number().over(Window.partitionBy("post_id", "tok").orderBy("pos")).alias("k"))
    return o.join(g, ["post_id", "ori", "k"]).select("post_id", "seg", "module", "ori", "alt", "tgt", "is_ne")


def ne_target(df: DataFrame) -> DataFrame:
    """V9: entities have the entity symbol as target for the module that finds them."""
    return df.withColumn("tgt", F.when((F.col("module") == "named_entities") & F.col("is_ne"), F.lit("ਊ")).otherwise(F.col("tgt")))


def classified(pairs: DataFrame) -> DataFrame:
    """V3: (module, ori, alt, tgt) with the counters of the pair: words, edits, and the case it is."""
    a, b, o = F.size(words(F.col("alt"))), F.size(words(F.col("tgt"))), F.size(words(F.col("ori")))
    c = F.size(F.array_intersect(F.array_distinct(words(F.col("alt"))), F.array_distinct(words(F.col("tgt")))))
    t = pairs.withColumn("a", a).withColumn("b", b).withColumn("o", o).withColumn("c", c)
    same, hit = F.col("ori") == F.col("tgt"), F.col("tgt") == F.col("alt")
    case = F.when(same & hit, "nothing").when(same, "over").when(hit, "corrected").otherwise("missed")
    edits = ~hit
    zero = F.lit(0)
    return (
        t.withColumn("case", case)
        .withColumn("D", F.when(edits & (F.col("a") < F.col("b")), F.col("b") - F.col("a")).otherwise(zero))
        .withColumn("I", F.when(edits & (F.col("a") > F.col("b")), F.col("a") - F.col("b")).otherwise(zero))
        .withColumn("S", F.when(edits & (F.col("a") <= F.col("b")), F.col("a") - F.col("c")).when(edits, F.col("b") - F.col("c")).otherwise(zero))
    )


def counters(pairs: DataFrame) -> DataFrame:
    """One row per module: the sums of V3."""
    t = classified(pairs)
    total = lambda column, case: F.sum(F.when(F.col("case") == case, F.col(column)).otherwise(0)).alias(f"n_{case}")
    return t.groupBy("module").agg(
        F.sum("b").alias("N"), F.sum("o").alias("tokens_overall"), F.sum("a").alias("num_sugg"), total("a", "nothing"), total("a", "over"), total("a", "corrected"), total("o", "missed"), F.sum("D").alias("D"), F.sum("I").alias("I"), F.sum("S").alias("S")
    )


def alignment_wer(counts: DataFrame, base: str = "original") -> DataFrame:
    """V6: (module, wer): (D + S + I) / N with the base module's N; a gap to it counts as insertions."""
    n0 = counts.where(F.col("module") == base).select(F.col("N").alias("N0"))
    t = counts.crossJoin(F.broadcast(n0))  # one row
    return t.select("module", F.round((F.col("D") + F.col("S") + F.col("I") + F.abs(F.col("N0") - F.col("N"))) / F.col("N0"), 6).alias("wer"))


def precision_recall(counts: DataFrame, base: str = "original") -> DataFrame:
    """V7: (module, precision, recall); what needs no correction is the base module's count for all."""
    n0 = counts.where(F.col("module") == base).select(F.col("n_nothing").alias("nothing"))
    good = F.col("n_corrected") + F.col("nothing") - F.col("n_over")
    t = counts.crossJoin(F.broadcast(n0))  # one row
    return t.select("module", F.round(good / F.nullif("num_sugg", F.lit(0)), 6).alias("precision"), F.round(good / F.nullif("N", F.lit(0)), 6).alias("recall"))


def coverage(pairs: DataFrame, suggestions: DataFrame) -> DataFrame:
    """V8: (found, not_found, precision, recall) of gold pairs whose target is among the suggestions for their original."""
    n = F.size(words(F.col("tgt")))
    options = suggestions.select("post_id", "ori", F.col("alt").alias("tgt"), F.lit(True).alias("hit")).distinct()
    p = pairs.join(options, ["post_id", "ori", "tgt"], "left").agg(F.sum(F.when(F.col("hit"), n).otherwise(0)).alias("found"), F.sum(F.when(F.col("hit").isNull(), n).otherwise(0)).alias("not_found"))
    s = suggestions.agg(F.sum(F.size(words(F.col("alt")))).alias("words"))
    return p.crossJoin(s).select("found", "not_found", F.round(F.col("found") / F.nullif("words", F.lit(0)), 6).alias("precision"), F.round(F.col("found") / F.nullif(F.col("found") + F.col("not_found"), F.lit(0)), 6).alias("recall"))


def clean_reference(t: Column) -> Column:
    return F.lower(F.trim(F.replace(F.replace(t, F.lit(JOIN_TAG), F.lit("")), F.lit(LINE_TAG), F.lit(""))))


def sentence_rates(texts: DataFrame) -> DataFrame:
    """V4: (post_id, module, cer, wer) of (post_id, module, ref, hyp)."""
    ref, hyp = clean_reference(F.col("ref")), F.lower(F.replace(F.col("hyp"), F.lit(JOIN_TAG), F.lit("")))
    t = texts.withColumn("r", ref).withColumn("h", hyp)
    return t.select("post_id", "module", cer(F.col("r"), F.col("h")).alias("cer"), F.round(wer(F.col("r"), F.col("h")), 3).alias("wer"))


def worst_combination(options: DataFrame, most: int = 100) -> DataFrame:
    """V4 for several alternatives a place: (post_id, module, cer, wer), the worst of the first ``most`` combinations in
    order, as the measure is defined. ``options``: (post_id, module, ref, lists ARRAY<ARRAY<STRING>>)."""
    start = F.array(F.lit("")).cast("array<string>")
    grow = lambda acc, alts: F.slice(F.flatten(F.transform(acc, lambda p: F.transform(alts, lambda a: F.trim(F.concat_ws(" ", p, a))))), 1, most)
    t = options.select("post_id", "module", "ref", F.explode(F.aggregate("lists", start, grow)).alias("hyp"))
    return sentence_rates(t).groupBy("post_id", "module").agg(F.max("cer").alias("cer"), F.max("wer").alias("wer"))


def average_rates(rates: DataFrame) -> DataFrame:
    """V5: (module, cer, wer)."""
    return rates.groupBy("module").agg(F.round(F.avg("cer"), 6).alias("cer"), F.round(F.avg("wer"), 6).alias("wer"))


def preclass_counters(flags: DataFrame) -> DataFrame:
    """(corrected, over_corrected, not_found) of (ori, tgt, to_correct)."""
    change = F.col("ori") != F.col("tgt")
    n = lambda c: F.count_if(c)
    return flags.agg(n(change & F.col("to_correct")).alias("corrected"), n(~change & F.col("to_correct")).alias("over_corrected"), n(change & ~F.col("to_correct")).alias("not_found"))


def token_lists(pairs: DataFrame) -> DataFrame:
    """(module, case, ori, n): the tokens of each case with their number, instead of unbounded lists."""
    return classified(pairs).where("case <> 'nothing'").groupBy("module", "case", "ori").agg(F.count(F.lit(1)).alias("n"))
