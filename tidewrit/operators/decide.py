"""Combination of suggestions and decision."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(outputs: dict[str, DataFrame]) -> DataFrame:
    """(msg_id, seg, mod_ord, module, ori, alt) of all modules' outputs, in their order."""
    parts = [df.select("msg_id", "seg", F.lit(i).alias("mod_ord"), F.lit(name).alias("module"), "ori", "alt") for i, (name, df) in enumerate(outputs.items())]
    return reduce(DataFrame.unionByName, parts)


def phrases(suggestions: DataFrame, keep_all_origins: bool = False) -> DataFrame:
    """(msg_id, alt, ori, modules) of each trimmed alternative of a message.

    An alternative keeps the first original that led to it, by module order and place; ``keep_all_origins`` keeps each.
    """
    s = suggestions.withColumn("alt", F.trim("alt"))
    keys = ["msg_id", "alt"] + (["ori"] if keep_all_origins else [])
    modules = F.array_sort(F.collect_set("module")).alias("modules")
    if keep_all_origins:
        return s.groupBy(*keys).agg(modules)
    first = F.min(F.struct("mod_ord", "seg", "ori")).alias("first")
    return s.groupBy(*keys).agg(first, modules).select("msg_id", "alt", F.col("first.ori").alias("ori"), "modules")


def known_phrases(df: DataFrame, column: str, lexicon: DataFrame, out: str = "known") -> DataFrame:
    """Whether all parts of a phrase, set apart by white space, are dictionary words as written; empty is not."""
    from ..functions.text import words

    d = df.select(column).distinct().withColumn("p", F.explode(words(F.col(column))))
    k = lexicon.select(F.col("word").alias("p"), F.lit(True).alias("k")).distinct()
    ok = d.join(k, "p", "left").groupBy(column).agg(F.bool_and(F.coalesce("k", F.lit(False))).alias("_ok"))
    return df.join(ok, column, "left").withColumn(out, F.coalesce("_ok", F.lit(False))).drop("_ok")


def phrase_table(phrase: DataFrame, modules: list[str], lexicon: DataFrame) -> DataFrame:
    """(msg_id, ori, alt, features ARRAY<INT>): a flag for each module in order, and the dictionary flag last."""
    k = known_phrases(phrase, "alt", lexicon)
    flags = [F.array_contains("modules", m).cast("int") for m in modules]
    return k.select("msg_id", "ori", "alt", F.array(*flags, F.col("known").cast("int")).alias("features"))


def table_lines(table: DataFrame) -> DataFrame:
    """K3: (msg_id, line): original, alternative and features set apart by three pipes."""
    return table.select("msg_id", F.concat_ws(" ||| ", "ori", "alt", F.array_join(F.col("features").cast("array<string>"), " ")).alias("line"))


def best_by_place(suggestions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """C3, first version: for each segment the alternative of the highest score, the number of modules that give it plus
    one if it is known; ties by first module and text. (msg_id, seg, ori, tgt)."""
    s = suggestions.groupBy("msg_id", "seg", "ori", "alt").agg(F.count(F.lit(1)).alias("votes"), F.min("mod_ord").alias("first"))
    s = known_phrases(s, "alt", lexicon)
    best = F.min(F.struct((-(F.col("votes") + F.col("known").cast("int"))).alias("score"), "first", "alt", "ori"))
    return s.groupBy("msg_id", "seg").agg(best.alias("b")).select("msg_id", "seg", F.col("b.ori").alias("ori"), F.col("b.alt").alias("tgt"))


def best_by_token(rows: DataFrame, options: DataFrame, lexicon: DataFrame, compound_ord: int | None) -> DataFrame:
    """C3, first version, as ``best_by_place``, where all modules but M4 go by the token: (msg_id, seg, ori, tgt).

    ``rows``: (msg_id, seg, tok, m, ori, alt), with M4's pair if ``compound_ord`` is its place in the order; ``options``:
    (tok, alt, votes, first). Votes are counted once per distinct token, so a place costs one lookup and no grouping.
    """
    o = known_phrases(options, "alt", lexicon).groupBy("tok").agg(F.collect_list(F.struct("alt", "votes", "first", F.col("known").cast("int").alias("known"))).alias("o"))
    t = rows.join(o, "tok", "left")
    joins = compound_ord is not None
    changed = ((F.col("ori") != F.col("tok")) | (F.col("alt") != F.col("tok"))) & F.lit(joins)
    extra = lambda x: F.when(~changed & (x["alt"] == F.col("tok")) & F.lit(joins), 1).otherwise(0)
    ord_ = F.lit(compound_ord if joins else 0)
    place = lambda x: F.struct((-(x["votes"] + x["known"] + extra(x))).alias("score"), F.when(extra(x) > 0, F.least(x["first"], ord_)).otherwise(x["first"]).alias("first"), x["alt"].alias("alt"), F.col("tok").alias("ori"))
    candidates = F.transform("o", place)
    joined = F.struct((F.when(F.col("alt") != "", -2).otherwise(-1)).cast("bigint").alias("score"), ord_.alias("first"), F.col("alt"), F.col("ori"))
    best = F.array_min(F.when(changed, F.concat(candidates, F.array(joined))).otherwise(candidates))
    t = t.select("msg_id", "seg", "tok", "m", best.alias("b"))
    return t.select("msg_id", "seg", F.when(F.col("m"), F.col("b.ori")).otherwise(F.col("tok")).alias("ori"), F.when(F.col("m"), F.col("b.alt")).otherwise(F.col("tok")).alias("tgt"))


def assemble(decision: DataFrame) -> DataFrame:
    """(msg_id, text_norm) from (msg_id, seg, tgt); empty targets leave no blank."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seg", "tgt"))), lambda x: x["tgt"])
    return decision.groupBy("msg_id").agg(F.array_join(F.filter(parts, lambda t: t != ""), " ").alias("text_norm"))


def viterbi(suggestions: DataFrame, bigrams: DataFrame, most_bigrams: int = 5_000_000) -> DataFrame:
    """C3, second version: (msg_id, seg, tgt) of the best sequence of alternatives under the bigram model and the votes.

    One row per message carries its lattice, so a message is decoded in one batch step. The model is sent to the tasks;
    its size is checked against ``most_bigrams``. Ties go to the first module and text.
    """
    rows = bigrams.limit(most_bigrams + 1).collect()
    if len(rows) > most_bigrams:
        raise ValueError(f"the bigram model has more than {most_bigrams} entries")
    import math

    total = {}
    for r in rows:
        total[r["w1"]] = total.get(r["w1"], 0) + r["cnt"]
    sent = suggestions.sparkSession.sparkContext.broadcast(({(r["w1"], r["w2"]): math.log((r["cnt"] + 0.1) / (total[r["w1"]] + 100.0)) for r in rows}, math.log(0.001)))
    options = suggestions.groupBy("msg_id", "seg", "alt").agg(F.count(F.lit(1)).alias("votes"), F.min("mod_ord").alias("first"))
    per_seg = options.groupBy("msg_id", "seg").agg(F.array_sort(F.collect_list(F.struct("first", "alt", "votes"))).alias("o"))
    lattice = per_seg.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("seg", "o"))).alias("l"))
    kind = suggestions.schema["msg_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, floor = sent.value
        for batch in batches:
            rows, segs, tgts = [], [], []
            for k, segments in enumerate(batch.column("l").to_pylist()):
                layers = [[(x["alt"], math.log(1 + x["votes"])) for x in s["o"]] for s in segments]
                best = {"<s>": (0.0, ())}
                for layer in layers:
                    new: dict[str, tuple[float, tuple]] = {}
                    for alt, vote in layer:
                        for last, (score, path) in best.items():
                            s, w = score + vote, last
                            for part in alt.split() or []:
                                s += model.get((w, part), floor)
                                w = part
                            if w not in new or s > new[w][0]:
                                new[w] = (s, (path, alt))
                    best = new
                _, path = max(((s + model.get((w, "</s>"), floor), p) for w, (s, p) in best.items()), key=lambda x: x[0])
                out = []
                while path:
                    path, alt = path
                    out.append(alt)
                for seg, alt in zip(segments, out[::-1]):
                    rows.append(k), segs.append(seg["seg"]), tgts.append(alt)
            yield pa.RecordBatch.from_arrays([batch.column("msg_id").take(pa.array(rows, pa.int64())), pa.array(segs, pa.int32()), pa.array(tgts, pa.string())], names=["msg_id", "seg", "tgt"])

    return lattice.mapInArrow(run, f"msg_id {kind}, seg int, tgt string")
