"""Column functions on text: white space, words, characters, n-grams, case, error rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a character class that Java and RE2 both read (fixed values).
WS = "[\\t-\\r\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def strip(t: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(t, f"^{WS}+|{WS}+$", "")


def words(t: Column) -> Column:
    """Words set apart by Unicode white space; null for null."""
    return F.filter(F.split(t, f"{WS}+"), lambda x: x != "")


def chars(t: Column) -> Column:
    """Code points of a text."""
    return F.filter(F.split(t, ""), lambda x: x != "")


def is_alpha(t: Column) -> Column:
    return t.rlike("^\\p{L}+$")


def ngrams(t: Column, n: int) -> Column:
    """Blanks and both ends become #, all character n-grams joined by blanks; shorter text is one piece."""
    s = F.concat(F.lit("#"), F.replace(t, F.lit(" "), F.lit("#")), F.lit("#"))
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n))), " ")
    return F.when(F.length(s) >= n, many).otherwise(F.lit(""))


def from_ngrams(t: Column, n: int) -> Column:
    """The inverse. Shorter pieces are dropped; the first character of each and the rest of the last make the text."""
    pieces = F.filter(F.split(t, " "), lambda p: F.length(p) >= n)
    heads = F.array_join(F.transform(pieces, lambda p: F.substring(p, 1, 1)), "")
    tail = F.coalesce(F.substring(F.try_element_at(pieces, F.lit(-1)), F.lit(2), F.lit(1_000_000)), F.lit(""))
    return F.translate(F.regexp_replace(F.concat(heads, tail), "^#|#$", ""), "#", " ")


def windows(t: Column, width: int = 5) -> Column:
    """T4: for each character its keys ``offset-char`` over a window of ``width`` to both sides, padded by @; the last
    place of the window has no key, as in the interface that this follows."""
    pad = F.lit("@" * width)
    s = F.concat(pad, t, pad)
    keys = lambda i: F.transform(F.sequence(F.lit(0), F.lit(2 * width - 1)), lambda k: F.concat(k.cast("string"), F.lit("-"), F.substring(s, i + k, F.lit(1))))
    return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), keys)).otherwise(F.array().cast("array<array<string>>"))


#: As many distinct words as there are characters here are written as one character each.
_ALPHABET = "".join(map(chr, range(0x4E00, 0x9FA6)))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of words.

    Each distinct word of the two becomes one character, so that the built-in distance of strings does the work; pairs
    with more distinct words than that allows go through the table itself.
    """
    both = F.struct(F.array_distinct(F.concat(a, b)).alias("v"), a.alias("a"), b.alias("b"))

    def near(x: Column) -> Column:
        code = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(F.lit(_ALPHABET), F.array_position(x["v"], w).cast("int"), F.lit(1))), "")
        return F.when(F.size(x["v"]) <= len(_ALPHABET), F.levenshtein(code(x["a"]), code(x["b"]))).otherwise(table_distance(x["a"], x["b"]))

    return F.transform(F.array(both), near)[0]


def table_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of words: one row of the table folded over the hypothesis."""
    start = F.transform(F.sequence(F.lit(0), F.size(a)), lambda i: i.cast("int"))

    def step(row: Column, w: Column) -> Column:
        # new[0] = row[0] + 1; new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[j] != w))
        first = F.array(F.element_at(row, 1) + 1)

        def cell(new: Column, j: Column) -> Column:
            sub = F.element_at(row, j) + F.when(F.element_at(a, j) == w, 0).otherwise(1)
            return F.concat(new, F.array(F.least(F.element_at(row, j + 1) + 1, F.element_at(new, -1) + 1, sub)))

        return F.when(F.size(a) > 0, F.aggregate(F.sequence(F.lit(1), F.size(a)), first, cell)).otherwise(first)

    return F.element_at(F.aggregate(b, start, step), -1)


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate to three places; null for an empty reference."""
    return F.round(F.levenshtein(ref, hyp) / F.nullif(F.length(ref), F.lit(0)), 3)


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate; null for an empty reference."""
    r, h = words(ref), words(hyp)
    return edit_distance(r, h) / F.nullif(F.size(r), F.lit(0))
