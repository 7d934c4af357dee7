"""Preprocessing (P0 to P12): placeholders for links, tags, smileys and hashtags, tokenization.

Each operator is a list of steps, and a step is data: the same list gives the Spark column and the ANSI SQL of the
query's check. Patterns must equal those of the message format that is processed, so they are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, strip

# Patterns in order of application, with their replacements.
PLACEHOLDER = "•"
HASHTAGS = [(r"#([\w\d]+)", PLACEHOLDER)]
HYPERLINKS = [(r"http:/\S+", PLACEHOLDER), (r"www\.\S+", PLACEHOLDER), (r"[^ ]+\@[^ ]+\.[^ \n]+", PLACEHOLDER)]
TAGS = [(r"\[[^\[ \]]*\]", PLACEHOLDER), (r"#ERROR!:parse", PLACEHOLDER)]
SMILEYS = [
    (p, PLACEHOLDER)
    for p in (
        r"B-?(\)\)?)",
        r"<+/*3+",
        r"\^[_]?\^",
        r"\([a-zA-Z]{0,2}\)",
        r"[O>C}\]\[)(]+[-~]?[;:x8=][)(]?",
        r"[;:=][',]?[-~]?(['3s/xSdDpPcCoO#@*$|\[\]\)]+|\)|\(\(?)=?",
        r"[;:8=][',]?[-~]?([sxSdDpPcCoO#@*$|\[\]\)]+|\)|\(\(?)=?",
        r"x[',]?[-~]?([3sSdDPcCO#@*$|\[\]\)]+|\)|\(\(?)=?",
        r"[-~]+'",
        r"[oO0n][.,][n0oO]",
        r" xp ",
    )
]
PRETOKENS = [
    (r"([^ !\?\.,;:A-Z]+)([.!;,?:]+)([^ !\?,\.;:]+)", r"$1 $2 $3"),
    (r"([^ !\?\.,;:]+)([.!;,?:]+)([^ !\?,\.;:A-Z]+)", r"$1 $2 $3"),
    (r"([^ !\?\.,;:A-Z]+)([.!;,?:]+)", r"$1 $2"),
]
PLACEHOLDER_SPACES = [(r"([^ ])([•±∞™])", r"$1 $2"), (r"([•±∞™])([^ ])", r"$1 $2")]
SPACES = [(r" +", " ")]

Step = tuple[str, str, str]
_rx = lambda pairs: [("regex", p, r) for p, r in pairs]
STRIP: Step = ("strip", "", "")
STEPS: dict[str, list[Step]] = {
    "P1_replace_linebreaks": [("literal", "<LINEBREAK>", "")],
    "P2_replace_hashtags": _rx(HASHTAGS),
    "P3_replace_hyperlinks": _rx(HYPERLINKS),
    "P4_replace_tags": _rx(TAGS),
    "P5_replace_smileys": _rx(SMILEYS),
    "P6_replace_pipe": [("literal", "|", " ")],
    "P7a_pretokenize": [*_rx(PRETOKENS), STRIP],
    "P7c_rejoin_punctuation": [("rejoin", "", "")],
    "P8_correct_at_tok": [("literal", "@ ", "@")],
    "P9_tokenize_placeholders": _rx(PLACEHOLDER_SPACES),
    "P10_replace_spaces": _rx(SPACES),
}
CHAIN: list[Step] = [STRIP, ("prefix", " ", ""), *(s for name in STEPS for s in STEPS[name]), STRIP]


def apply(t: Column, steps: list[Step]) -> Column:
    for kind, a, b in steps:
        if kind == "regex":
            t = F.regexp_replace(t, a, b)
        elif kind == "literal":
            t = F.replace(t, F.lit(a), F.lit(b))
        elif kind == "rejoin":
            t = F.regexp_replace(t, r"([!,;.'?]) (?=[!.,;?])", "$1")
        elif kind == "prefix":
            t = F.concat(F.lit(a), t)
        else:
            t = strip(t)
    return t


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def apply_sql(t: str, steps: list[Step]) -> str:
    """The same steps as SQL over RE2, which has no look-ahead: the rejoin consumes, and so is applied twice."""
    for kind, a, b in steps:
        if kind == "regex":
            t = f"regexp_replace({t}, {quoted(a)}, {quoted(b.replace('$', chr(92)))}, 'g')"
        elif kind == "literal":
            t = f"replace({t}, {quoted(a)}, {quoted(b)})"
        elif kind == "rejoin":
            for _ in range(2):
                t = f"regexp_replace({t}, {quoted(r'([!,;.' + chr(39) + r'?]) ([!.,;?])')}, '\\1\\2', 'g')"
        elif kind == "prefix":
            t = f"({quoted(a)} || {t})"
        else:
            t = f"regexp_replace({t}, {quoted(f'^{WS}+|{WS}+$')}, '', 'g')"
    return t


def rewrite_text(t: Column) -> Column:
    """The whole chain; a blank text becomes a single line feed; null stays null."""
    return F.when(t.rlike(f"[^{WS[1:-1]}]"), apply(t, CHAIN)).otherwise(F.when(t.isNotNull(), F.lit("\n")))


def rewrite_text_sql(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, {quoted(f'[^{WS[1:-1]}]')}) THEN {apply_sql(t, CHAIN)} WHEN {t} IS NOT NULL THEN chr(10) END"


def reduce_allcaps(t: Column) -> Column:
    """Runs of two or more capitals in small letters."""
    parts = F.regexp_extract_all(t, F.lit(r"[A-Z]{2,}|[^A-Z]+|[A-Z]"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[A-Z]{2,}$"), F.lower(p)).otherwise(p)), "")


def preprocess(df: DataFrame, text_col: str = "text_orig", out: str = "text_prepro") -> DataFrame:
    """Add the preprocessed text. The patterns are dear, so a scan of few large files is spread over the cores first by
    the caller's partitioning (``spark.sql.files.maxPartitionBytes``), not by a shuffle here."""
    return df.withColumn(out, rewrite_text(F.col(text_col)))


# Legacy preprocessing of the older text format; fixed values as above.
def legacy_rewrite(t: Column, genre: str = "sms") -> Column:
    """The earlier chain: unclosed tags, tags, replies and links get symbols of their own; hashtags keep their word."""
    t = apply(t, _rx(SMILEYS))
    t = F.regexp_replace(t, r"\[[^\[ \]]+$", "•")
    t = F.regexp_replace(t, r"\[[^\[ \]]*\]", "±")
    if genre in ("twe", "sns"):
        t = F.regexp_replace(t, r"@[\w\d]+", "™")
    t = F.regexp_replace(t, r"http:/\S+|www\.\S+", "∞")
    if genre == "twe":
        t = F.regexp_replace(t, r"#([\w\d]+)", "$1")
    if genre == "cgn":
        t = F.lower(F.regexp_replace(t, r"\b(?:xxx|ggg)\b|\*[a-z]\b", ""))
    return strip(apply(t, [*_rx(PRETOKENS), STRIP, *_rx(PLACEHOLDER_SPACES), *_rx(SPACES)]))
