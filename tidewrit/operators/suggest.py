"""Suggestion modules (M1 to M13): each takes tokens and gives (msg_id, seg, ori, alt).

Tokens are (msg_id, pos, tok) with an optional ``to_correct`` BOOLEAN (D4); without it every token may be changed.
Lookups are left joins on distinct tokens where the suggestion depends on the token alone. Word lists are ordinary
tables; whether one is broadcast is left to the optimizer's size limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_alpha

SYMBOLS = ("•", "±", "∞", "™")
NE_SYMBOL = "ਊ"


def _mask(tokens: DataFrame) -> Column:
    return F.col("to_correct") if "to_correct" in tokens.columns else F.lit(True)


def _with_mask(tokens: DataFrame) -> DataFrame:
    return tokens.select("msg_id", F.col("pos").cast("int").alias("seg"), "tok", _mask(tokens).alias("m"))


def original(tokens: DataFrame) -> DataFrame:
    """M1: identity."""
    return tokens.select("msg_id", F.col("pos").cast("int").alias("seg"), F.col("tok").alias("ori"), F.col("tok").alias("alt"))


def empty(tokens: DataFrame) -> DataFrame:
    """The empty alternative where correction is allowed."""
    return tokens.select("msg_id", F.col("pos").cast("int").alias("seg"), F.col("tok").alias("ori"), F.when(_mask(tokens), F.lit("")).otherwise(F.col("tok")).alias("alt"))


def _by_token(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """Apply a table (tok, alt) of distinct tokens; tokens without entry, or not to be changed, stay."""
    t = _with_mask(tokens).join(table, "tok", "left")
    return t.select("msg_id", "seg", F.col("tok").alias("ori"), F.when(F.col("m"), F.coalesce("alt", "tok")).otherwise(F.col("tok")).alias("alt"))


def _unknown(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct tokens that aren't in the dictionary as they are written."""
    return tokens.select("tok").where("tok is not null").distinct().join(lexicon.select(F.col("word").alias("tok")).distinct(), "tok", "left_anti")


def abbreviation(tokens: DataFrame, abbreviations: DataFrame, lexicon: DataFrame) -> DataFrame:
    """M2: the expansion of an unknown token whose lower-case form is a key; of two expansions the first in order."""
    table = abbreviations.where("expansion is not null and expansion <> ''").groupBy("key").agg(F.min("expansion").alias("alt"))
    found = _unknown(tokens, lexicon).withColumn("key", F.lower("tok")).join(table, "key").select("tok", "alt")
    return _by_token(tokens, found)


def _deletions(w: Column) -> Column:
    """A word and all it becomes with one or two characters dropped, as hashes."""
    less = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1_000_000))))
    one = less(w)
    return F.transform(F.array_distinct(F.concat(F.array(w), one, F.flatten(F.transform(F.array_distinct(one), less)))), lambda x: F.xxhash64(x))


def spelling(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """M3: for an unknown token of letters the nearest dictionary word within two edits, by (distance, -freq, word).

    Candidates share a form with up to two characters dropped, so every word within two edits is met, by an equi-join
    on distinct unknown tokens. A token's number of forms grows as the square of its length; tokens are short words.
    """
    wrong = _unknown(tokens, lexicon).where(is_alpha(F.col("tok")) & ~F.col("tok").isin(*SYMBOLS, NE_SYMBOL))
    left = wrong.select("tok", F.explode(_deletions(F.col("tok"))).alias("h"))
    dictionary = lexicon.where("word is not null").groupBy("word").agg(F.max("freq").alias("freq"))
    right = dictionary.select("word", "freq", F.explode(_deletions(F.col("word"))).alias("h"))
    pairs = left.join(right, "h").select("tok", "word", "freq").distinct().withColumn("d", F.levenshtein("tok", "word")).where("d <= 2")
    best = pairs.groupBy("tok").agg(F.min(F.struct("d", (-F.col("freq")).alias("f"), "word")).alias("b")).select("tok", F.col("b.word").alias("alt"))
    return _by_token(tokens, best)


def unchanged_rows(tokens: DataFrame) -> DataFrame:
    """(msg_id, seg, tok, m, ori, alt) without M4: each token is its own pair."""
    return _with_mask(tokens).select("msg_id", "seg", "tok", "m", F.col("tok").alias("ori"), F.col("tok").alias("alt"))


def compound(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """M4: two tokens that make a known word become one, from left to right; the second token's slot is empty."""
    return compound_rows(tokens, lexicon).select("msg_id", "seg", "ori", "alt")


def compound_rows(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """M4 with the token and its mask: (msg_id, seg, tok, m, ori, alt).

    The greedy choice is that of every other candidate within each run of adjacent candidates.
    """
    w = Window.partitionBy("msg_id").orderBy("seg")
    t = _with_mask(tokens).withColumn("nxt", F.lead("tok").over(w))
    head = F.substring("nxt", 1, 1)
    able = F.col("nxt").isNotNull() & ~F.col("tok").isin("•", "±", "∞", NE_SYMBOL) & ~head.isin("•", "±", "∞", NE_SYMBOL, "?", ".", "!") & F.col("m")
    t = t.withColumn("joined", F.when(able, F.concat("tok", "nxt")))
    known = lexicon.select(F.col("word").alias("joined"), F.lit(True).alias("k")).distinct()
    t = t.join(known, "joined", "left").withColumn("cand", F.coalesce("k", F.lit(False)))
    t = t.withColumn("run", F.sum(F.when(F.col("cand"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("msg_id", "run").orderBy("seg")
    # A run starts at the row that is no candidate, so candidates are its rows from the second on; at a text's start it is the first.
    t = t.withColumn("n", F.sum(F.col("cand").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("take", F.col("cand") & (F.col("n") % 2 == 1))
    t = t.withColumn("used", F.coalesce(F.lag("take").over(w), F.lit(False)))
    ori = F.when(F.col("used"), F.lit("")).when(F.col("take"), F.concat_ws(" ", "tok", "nxt")).otherwise(F.col("tok"))
    alt = F.when(F.col("used"), F.lit("")).when(F.col("take"), F.col("joined")).otherwise(F.col("tok"))
    return t.select("msg_id", "seg", "tok", "m", ori.alias("ori"), alt.alias("alt"))


def word_split(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """M5: the split in two known parts of two or more characters with the highest geometric mean of frequencies, if it
    is higher than the whole word's frequency; of equal splits the first."""
    freq = lexicon.where("word is not null").groupBy("word").agg(F.max("freq").alias("f"))
    t = tokens.select("tok").where("length(tok) >= 4").distinct().withColumn("at", F.explode(F.sequence(F.lit(2), F.length("tok") - 2)))
    t = t.select("tok", "at", F.expr("substring(tok, 1, at)").alias("a"), F.expr("substring(tok, at + 1)").alias("b"))
    t = t.join(freq.select(F.col("word").alias("a"), F.col("f").alias("fa")), "a").join(freq.select(F.col("word").alias("b"), F.col("f").alias("fb")), "b")
    t = t.join(freq.select(F.col("word").alias("tok"), F.col("f").alias("whole")), "tok", "left").withColumn("score", F.sqrt(F.col("fa").cast("double") * F.col("fb").cast("double")))
    t = t.where(F.col("score") > F.coalesce("whole", F.lit(0)))
    best = t.groupBy("tok").agg(F.min(F.struct((-F.col("score")).alias("s"), "at", "a", "b")).alias("x"))
    return _by_token(tokens, best.select("tok", F.concat_ws(" ", "x.a", "x.b").alias("alt")))


# Spelling variants of one sound, in order of application.
SOUNDS = [("ph", "f"), ("ck|c|q", "k"), ("z", "s"), ("v|w", "f"), ("x", "ks"), ("d$|dt$", "t"), ("[aeiouyh]+", "")]


def sound_key(t: Column) -> Column:
    """A phonetic key: the first letter, and the rest with sounds unified and vowels dropped."""
    s = F.lower(t)
    for p, r in SOUNDS:
        s = F.regexp_replace(s, p, r)
    return F.concat(F.substring(F.lower(t), 1, 1), s)


def sound_key_sql(t: str) -> str:
    s = f"lower({t})"
    for p, r in SOUNDS:
        s = f"regexp_replace({s}, '{p}', '{r}', 'g')"
    return f"(substring(lower({t}), 1, 1) || {s})"


def phonemic(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """M6: for an unknown token of letters the most frequent word that sounds alike (offline stand-in of a service)."""
    table = lexicon.where("word is not null").select(sound_key(F.col("word")).alias("key"), "word", "freq").groupBy("key").agg(F.min(F.struct((-F.col("freq")).alias("f"), "word")).alias("b"))
    found = _unknown(tokens, lexicon).where(is_alpha(F.col("tok")) & (F.length("tok") >= 3)).withColumn("key", sound_key(F.col("tok"))).join(table, "key").select("tok", F.col("b.word").alias("alt"))
    return _by_token(tokens, found)


def phrase_counts(gold: DataFrame) -> DataFrame:
    """(src, tgt, n): how often a token was normalised to a target, of gold records with both; joined tags left out."""
    z = gold.where("tok is not null and tgt is not null").select(F.explode(F.arrays_zip("tok", "tgt")).alias("z")).select(F.col("z.tok").alias("src"), F.col("z.tgt").alias("tgt"))
    return z.where("src is not null and tgt is not null and tgt not in ('<com>', '<split>', '<LINEBREAK>')").groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n"))


def best_phrases(counts: DataFrame) -> DataFrame:
    """(tok, alt): the most frequent target of each source, the first of equals."""
    return counts.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "tgt")).alias("b")).select(F.col("src").alias("tok"), F.col("b.tgt").alias("alt"))


def smt_token(tokens: DataFrame, gold: DataFrame) -> DataFrame:
    """M7: token translation by a phrase table estimated from gold pairs; unknown tokens stay."""
    return _by_token(tokens, best_phrases(phrase_counts(gold)))


def char_table(gold: DataFrame, n: int) -> DataFrame:
    """(g, o): the most frequent output character of each character n-gram, of gold pairs of equal length."""
    p = phrase_counts(gold).where("length(src) = length(tgt) and length(src) > 0")
    s = F.concat(F.lit("#"), F.col("src"))
    rows = p.select("n", s.alias("s"), "tgt", F.explode(F.sequence(F.lit(1), F.length("tgt"))).alias("i"))
    g = F.expr("substring(s, i + 1, 1)") if n == 1 else F.expr("substring(s, i, 2)")
    rows = rows.select(g.alias("g"), F.expr("substring(tgt, i, 1)").alias("o"), "n").groupBy("g", "o").agg(F.sum("n").alias("n"))
    return rows.groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("n"), "o")).alias("b")).select("g", F.col("b.o").alias("o"))


def smt_chars(tokens: DataFrame, gold: DataFrame, n: int) -> DataFrame:
    """M8 (n = 1) and M9 (n = 2): translation of character n-grams; unknown ones keep their character."""
    t = tokens.select("tok").where("length(tok) > 0").distinct()
    rows = t.select("tok", F.explode(F.sequence(F.lit(1), F.length("tok"))).alias("i"))
    g = F.expr("substring(tok, i, 1)") if n == 1 else F.expr("substring(concat('#', tok), i, 2)")
    rows = rows.withColumn("g", g).join(char_table(gold, n), "g", "left").withColumn("o", F.coalesce("o", F.expr("substring(tok, i, 1)")))
    back = rows.groupBy("tok").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "o"))), lambda x: x["o"]), "").alias("alt"))
    return _by_token(tokens, back)


def smt_cascaded(tokens: DataFrame, gold: DataFrame) -> DataFrame:
    """M7, and its output through M8, against the original token."""
    first = best_phrases(phrase_counts(gold))
    t = tokens.select("tok").where("tok is not null").distinct().join(first, "tok", "left").select("tok", F.coalesce("alt", "tok").alias("mid"))
    mids = t.select(F.lit(0).cast("bigint").alias("msg_id"), F.lit(0).alias("pos"), F.col("mid").alias("tok")).distinct()
    second = smt_chars(mids, gold, 1).select(F.col("ori").alias("mid"), "alt")
    return _by_token(tokens, t.join(second, "mid").select("tok", "alt"))


def transliterate(tokens: DataFrame, gold: DataFrame) -> DataFrame:
    """Every character by the most frequent output of its window of one character to both sides, backing off to
    the character itself; trained on gold pairs of equal length."""
    p = phrase_counts(gold).where("length(src) = length(tgt) and length(src) > 0")
    rows = p.select("n", "tgt", F.concat(F.lit("@"), "src", F.lit("@")).alias("s"), F.explode(F.sequence(F.lit(1), F.length("tgt"))).alias("i"))
    rows = rows.select(F.expr("substring(s, i, 3)").alias("g"), F.expr("substring(tgt, i, 1)").alias("o"), "n").groupBy("g", "o").agg(F.sum("n").alias("n"))
    table = rows.groupBy("g").agg(F.min(F.struct((-F.col("n")).alias("n"), "o")).alias("b")).select("g", F.col("b.o").alias("o"))
    t = tokens.select("tok").where("length(tok) > 0").distinct().select("tok", F.explode(F.sequence(F.lit(1), F.length("tok"))).alias("i"))
    t = t.withColumn("g", F.expr("substring(concat('@', tok, '@'), i, 3)")).join(table, "g", "left").withColumn("o", F.coalesce("o", F.expr("substring(tok, i, 1)")))
    return _by_token(tokens, t.groupBy("tok").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "o"))), lambda x: x["o"]), "").alias("alt")))


NE_BLOCKERS = ("!", ".", "?", "-", ":", "...")


def entity_flags(tokens: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(msg_id, seg, tok, is_ne): M13r and M13a: in the gazetteer, a reply handle, or capitalised after an ordinary token.

    An optional BOOLEAN column ``crf_label`` of the tokens, from a tagger, counts as well.
    """
    w = Window.partitionBy("msg_id").orderBy("seg")
    crf = F.col("crf_label") if "crf_label" in tokens.columns else F.lit(False)
    t = tokens.select("msg_id", F.col("pos").cast("int").alias("seg"), "tok", F.coalesce(crf, F.lit(False)).alias("crf")).withColumn("prev", F.lag("tok").over(w))
    keys = gazetteer.select(F.col("key").alias("g"), F.lit(True).alias("k")).distinct()
    t = t.join(keys, F.lower("tok") == F.col("g"), "left")
    capital = F.col("tok").rlike("^\\p{Lu}\\p{Ll}+$") & F.col("prev").isNotNull() & ~F.col("prev").isin(*NE_BLOCKERS)
    return t.select("msg_id", "seg", "tok", (F.col("k").isNotNull() | F.col("crf") | capital | F.col("tok").rlike("^@[\\w\\d]+$")).alias("is_ne"))


def named_entities(tokens: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The entity symbol for entities, identity else."""
    t = entity_flags(tokens, gazetteer)
    return t.select("msg_id", "seg", F.col("tok").alias("ori"), F.when(F.col("is_ne"), F.lit(NE_SYMBOL)).otherwise(F.col("tok")).alias("alt"))


def modules(res: dict[str, DataFrame]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The registry in order; the order is that of the feature vector. ``res``: lexicon, abbreviation, gazetteer, gold."""
    return {
        "original": original,
        "abbreviation": lambda t: abbreviation(t, res["abbreviation"], res["lexicon"]),
        "spelling": lambda t: spelling(t, res["lexicon"]),
        "compound": lambda t: compound(t, res["lexicon"]),
        "word_split": lambda t: word_split(t, res["lexicon"]),
        "phonemic": lambda t: phonemic(t, res["lexicon"]),
        "smt_token": lambda t: smt_token(t, res["gold"]),
        "smt_unigram": lambda t: smt_chars(t, res["gold"], 1),
        "smt_bigram": lambda t: smt_chars(t, res["gold"], 2),
        "smt_cascaded": lambda t: smt_cascaded(t, res["gold"]),
        "transliterate": lambda t: transliterate(t, res["gold"]),
        "named_entities": lambda t: named_entities(t, res["gazetteer"]),
        "empty": empty,
    }


#: Modules whose alternatives depend on more than the token itself.
IN_CONTEXT = ("compound", "named_entities")
#: Modules of a full run in their order, which is that of the feature vector (fixed values).
_EN = ("word_split", "compound", "original", "abbreviation", "smt_token", "smt_unigram", "smt_bigram", "smt_cascaded", "transliterate", "spelling")
FULL = {"en": _EN, "nl": (*_EN[:2], "phonemic", *_EN[2:])}


def token_options(tokens: DataFrame, names: list[str], res: dict[str, DataFrame]) -> DataFrame:
    """(tok, alt, votes, first) over the modules of ``names`` that go by the token alone, once per distinct token."""
    d = tokens.select("tok").where("tok is not null").distinct()
    fake = d.select(F.lit(0).cast("bigint").alias("msg_id"), F.lit(0).alias("pos"), "tok")
    registry, out = modules(res), None
    for i, name in enumerate(names):
        if name not in IN_CONTEXT:
            part = registry[name](fake).select(F.col("ori").alias("tok"), "alt", F.lit(i).alias("mod_ord"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("tok", "alt").agg(F.count(F.lit(1)).alias("votes"), F.min("mod_ord").alias("first"))
