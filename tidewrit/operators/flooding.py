"""Flooding correction (L1 to L5): repeated characters and syllables of a token are reduced to two or to one.

A correction depends on the token alone, so it is made once per distinct token and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

# Classes of characters that may flood, and rounds of the repeated-syllable rules.
PUNCTUATION = r"([.?!:;,])(\1{2,})"
TWO_CHAR = r"([^0-9±ਊ•\.])(?i)(\1{2,})"
TWO_CHAR_NO_E = r"(?i)([^e0-9±ਊ•\.])(\1{2,})"
TWO_PAIR = r"([^0-9±ਊ•\.]{2})(?i)(\1{2,})"
ONE_CHAR = r"([^0-9±™•\.!\?,])(?i)(\1{2,})"
ONE_PAIR = r"([^0-9±ਊ•\.!\?!,]{2})(?i)(\1{2,})"
ONE_TRIPLE = r"([^0-9±ਊ•\.!\?!,]{3})(?i)(\1{2,})"
ROUNDS = 9


def punctuation(t: Column) -> Column:
    """L1: a run of three or more of one mark to two, then two dots to three."""
    return F.replace(F.regexp_replace(t, PUNCTUATION, "$1$1"), F.lit(".."), F.lit("..."))


def _rounds(t: Column, pattern: str, to: str) -> Column:
    """A rule applied up to ROUNDS times; the lambda keeps a round's value from being written out twice."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), t, lambda x, _: F.when(x.rlike(pattern), F.regexp_replace(x, pattern, to)).otherwise(x))


def chars_to_two(t: Column) -> Column:
    return F.regexp_replace(t, TWO_CHAR, "$1$1")


def chars_to_one(t: Column) -> Column:
    return F.regexp_replace(t, ONE_CHAR, "$1")


def to_two(t: Column) -> Column:
    """L2 but for Dutch e: character runs, then repeated pairs, to two. All runs are reduced, however many."""
    return _rounds(chars_to_two(t), TWO_PAIR, "$1$1")


def to_two_dutch(t: Column) -> tuple[Column, Column]:
    """L2 for Dutch tokens with a run of e: the forms with ``ee`` and with ``eee``; the first is taken if it is a word."""
    other = F.regexp_replace(t, TWO_CHAR_NO_E, "$1$1")
    return F.regexp_replace(other, "e{3,}", "ee"), F.regexp_replace(other, "e{3,}", "eee")


def to_one(t: Column) -> Column:
    """L3: character runs, repeated pairs and triples to one."""
    return _rounds(_rounds(chars_to_one(t), ONE_PAIR, "$1"), ONE_TRIPLE, "$1")


def known_words(lexicon: DataFrame, flooding_abbrev: DataFrame) -> DataFrame:
    """(w): words that count as correct for L4."""
    return lexicon.select(F.col("word").alias("w")).unionByName(flooding_abbrev.select(F.col("key").alias("w"))).where("w is not null").distinct()


def _flag(df: DataFrame, column: str, known: DataFrame, out: str) -> DataFrame:
    """Left join on lower-case membership. No hint: the optimizer broadcasts the word list only below its size limit."""
    k = known.select(F.col("w").alias("_w"), F.lit(True).alias("_k"))
    return df.join(k, F.lower(F.col(column)) == F.col("_w"), "left").withColumn(out, F.col("_k").isNotNull()).drop("_w", "_k")


def check(df: DataFrame, column: str, known: DataFrame, out: str = "known") -> DataFrame:
    """L4: whether the lower-case word is in the dictionary or the abbreviation set."""
    return _flag(df, column, known, out)


#: What any of the rules could change; a token without it stays as it is.
FLOODED = r"(?i)(.)\1\1|(..)\2\2|(...)\3\3|\.\."


def _corrected(t: DataFrame, known: DataFrame, language: str) -> DataFrame:
    """Rows with a column ``tok``, with (one, one_ok, two, two_ok, corrected) added. Both words: two; only the shorter one a
    word: one; else two."""
    # The rules are dear, and most tokens have nothing for them.
    flooded = F.col("flooded")
    t = t.withColumn("flooded", F.col("tok").rlike(FLOODED)).withColumn("p", F.when(flooded, punctuation(F.col("tok"))).otherwise(F.col("tok")))
    if language == "nl":
        ee, eee = to_two_dutch(F.col("p"))
        t = t.withColumn("ee", F.when(flooded, ee).otherwise(F.col("p"))).withColumn("eee", F.when(flooded, eee))
        t = _flag(t, "ee", known, "ee_ok")
        two = F.when(F.col("p").rlike("e{3,}"), F.when(F.col("ee_ok"), F.col("ee")).otherwise(F.col("eee"))).otherwise(chars_to_two(F.col("p")))
        t = t.withColumn("c", F.when(flooded, two)).withColumn("two", F.when(flooded, _rounds(F.col("c"), TWO_PAIR, "$1$1")).otherwise(F.col("p"))).drop("ee", "eee", "ee_ok", "c")
    else:
        t = t.withColumn("two", F.when(flooded, to_two(F.col("p"))).otherwise(F.col("p")))
    t = t.withColumn("one0", F.when(flooded, to_one(F.col("p"))).otherwise(F.col("p"))).withColumn("two_e", F.regexp_replace("two", "e{3,}", "eeë"))
    t = _flag(_flag(_flag(t, "two", known, "a"), "two_e", known, "b"), "one0", known, "one_ok")
    t = t.withColumn("two_ok", F.col("a") | F.col("b")).withColumn("one", F.when(F.col("one_ok"), F.col("one0")).otherwise(F.col("p")))
    return t.withColumn("corrected", F.when(F.col("one_ok") & ~F.col("two_ok"), F.col("one")).otherwise(F.col("two"))).drop("p", "one0", "two_e", "a", "b", "flooded")


def correct_tokens(tokens: DataFrame, known: DataFrame, language: str = "en") -> DataFrame:
    """(tok, one, one_ok, two, two_ok, corrected) of each distinct token. Null tokens are dropped."""
    t = tokens.select("tok").where("tok is not null").distinct()
    return _corrected(t, known, language).select("tok", "one", "one_ok", "two", "two_ok", "corrected")


def correct(messages: DataFrame, known: DataFrame, id_col: str = "msg_id", text_col: str = "text_prepro", language: str = "en", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, text_flood) with every token corrected; as many tokens as before. Null and blank texts give the empty
    text.

    The text is read once: tokens are corrected where they stand, not made distinct and joined back.
    """
    w = words(F.coalesce(F.col(text_col), F.lit("")))
    base = messages.select(id_col, *keep, w.alias("w"))
    rows = base.select(id_col, *keep, F.posexplode_outer("w").alias("pos", "tok"))
    fixed = _corrected(rows, known, language)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tok").isNotNull(), F.struct("pos", F.col("corrected").alias("c"))))), lambda x: x["c"]), " ")
    return fixed.groupBy(id_col, *keep).agg(text.alias("text_flood"))
