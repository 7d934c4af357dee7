"""The core's queries and the SQL that checks them; every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import align, decide, evaluate, filtering, flooding, gold, prepro, suggest
from .operators.prepro import quoted
from .plans import pipeline
from .sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str, column: str = "text_orig") -> DataFrame:
    """(msg_id, column): second deliveries dropped."""
    return t(spark, d, "messages").select("msg_id", column).distinct()


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the delivered preprocessed texts."""
    return pipeline.tokens_of(texts(spark, d, "text_prepro"), text_col="text_prepro")


def resources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    r = {n: t(spark, d, n) for n in ("lexicon", "abbreviation", "flooding_abbrev", "gazetteer")}
    r["gold"] = t(spark, d, "csv_sent").select("post_id", "post", "ori", "tok", "tgt", "ne").distinct()
    g = evaluate.gold_tokens(r["gold"]).select(F.col("post_id").alias("msg_id"), "pos", F.col("tgt").alias("tok"))
    r["bigram"] = filtering.bigram_model(g)
    return r


_WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, {quoted(X.WS + '+')}), lambda x: x <> '')"
_TEXTS = "txt AS (SELECT DISTINCT msg_id, text_orig FROM messages)"
_TOKENS = f"tok AS MATERIALIZED (SELECT msg_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS tok FROM (SELECT msg_id, {_WORDS('text_prepro')} AS w FROM (SELECT DISTINCT msg_id, text_prepro FROM messages WHERE text_prepro IS NOT NULL)))"
_GOLDS = "gold AS (SELECT DISTINCT post_id, post, ori, tok, tgt, ne FROM csv_sent)"
_GTOK = f"{_GOLDS}, gtok AS (SELECT post_id, CAST(i - 1 AS INTEGER) AS pos, ori[i] AS ori, tok[i] AS tok, tgt[i] AS tgt, coalesce(list_contains(ne, i - 1), false) AS is_ne FROM (SELECT *, unnest(range(1, len(ori) + 1)) AS i FROM gold WHERE tgt IS NOT NULL))"
_LEX = "lex AS (SELECT DISTINCT word FROM lexicon)"
_LEXF = "lexf AS (SELECT word, max(freq) AS f FROM lexicon WHERE word IS NOT NULL GROUP BY word)"
_UNK = f"{_LEX}, unk AS MATERIALIZED (SELECT DISTINCT tok FROM tok ANTI JOIN lex ON tok = word)"
_BIGRAM = "bi AS (SELECT w1, w2, count(*) AS cnt FROM (SELECT coalesce(lag(tgt) OVER w, '<s>') AS w1, tgt AS w2 FROM gtok WINDOW w AS (PARTITION BY post_id ORDER BY pos) UNION ALL SELECT tgt, '</s>' FROM (SELECT tgt, lead(tgt) OVER (PARTITION BY post_id ORDER BY pos) AS nx FROM gtok) WHERE nx IS NULL) GROUP BY 1, 2)"


def _with(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


# Scans and preprocessing.
query("S1_messages", _with(_TEXTS, select="SELECT * FROM txt"))(lambda s, d: texts(s, d))
query("P0_rewrite_text", _with(_TEXTS, select=f"SELECT msg_id, {prepro.rewrite_text_sql('text_orig')} AS text_prepro FROM txt"))(lambda s, d: prepro.preprocess(texts(s, d)).select("msg_id", "text_prepro"))
query("P0_documents", f"SELECT doc_id, {prepro.rewrite_text_sql('text')} AS text_prepro FROM documents")(lambda s, d: t(s, d, "documents").select("doc_id", prepro.rewrite_text(F.col("text")).alias("text_prepro")))
for _name, _steps in prepro.STEPS.items():
    query(_name, _with(_TEXTS, select=f"SELECT msg_id, {prepro.apply_sql('text_orig', _steps)} AS result FROM txt"))(lambda s, d, steps=_steps: texts(s, d).select("msg_id", prepro.apply(F.col("text_orig"), steps).alias("result")))
query("P11_reduce_allcaps", _with(_TEXTS, select="SELECT msg_id, array_to_string(list_transform(regexp_extract_all(text_orig, '[A-Z]{2,}|[^A-Z]+|[A-Z]'), lambda x: CASE WHEN regexp_full_match(x, '[A-Z]{2,}') THEN lower(x) ELSE x END), '') AS result FROM txt"))(
    lambda s, d: texts(s, d).select("msg_id", prepro.reduce_allcaps(F.col("text_orig")).alias("result"))
)
query("P12_text_validation", _with(_TEXTS, select="SELECT msg_id, text_orig IS NOT NULL AS valid FROM txt"))(lambda s, d: texts(s, d).select("msg_id", F.col("text_orig").isNotNull().alias("valid")))
query("P_legacy_rewrite")(lambda s, d: texts(s, d).select("msg_id", prepro.legacy_rewrite(F.col("text_orig"), "twe").alias("result")))
query("K1_text_lines", "SELECT msg_id, CASE WHEN trim(coalesce(text_prepro, '')) = '' THEN chr(10) ELSE text_prepro END AS line FROM (SELECT DISTINCT msg_id, text_prepro FROM messages)")(
    lambda s, d: sinks.text_lines(texts(s, d, "text_prepro"), "msg_id", "text_prepro")
)
query("K2_deleted_lines", "SELECT count(*) FILTER (NOT b) AS kept, count(*) FILTER (b) AS deleted FROM (SELECT trim(replace(coalesce(text_prepro, ''), chr(10), '')) = '' AS b FROM (SELECT DISTINCT msg_id, text_prepro FROM messages))")(lambda s, d: sinks.deleted_lines(texts(s, d, "text_prepro"), "text_prepro"))

# Tokens, flooding.
query("D3_tokens", _with(_TOKENS, select="SELECT * FROM tok"))(lambda s, d: tokens(s, d))
_PUNCT = "tok"
for _c in ".?!:;,":
    _PUNCT = f"regexp_replace({_PUNCT}, '[{_c}]{{3,}}', '{_c}{_c}', 'g')"
query("L1_punctuation_flooding", _with(_TOKENS, select=f"SELECT msg_id, pos, replace({_PUNCT}, '..', '...') AS result FROM tok"))(lambda s, d: tokens(s, d).select("msg_id", "pos", flooding.punctuation(F.col("tok")).alias("result")))


def _runs_sql(excluded: str, keep: int) -> str:
    """Character runs of three or more, ignoring ASCII case, cut to the first character ``keep`` times."""
    fold = "CASE WHEN c BETWEEN 'A' AND 'Z' THEN lower(c) ELSE c END"
    return _with(
        _TOKENS,
        "d AS (SELECT DISTINCT tok FROM tok)",
        f"ch AS (SELECT tok, i, c, {fold} AS f FROM (SELECT tok, i, substring(tok, CAST(i AS INTEGER), 1) AS c FROM (SELECT tok, unnest(range(1, length(tok) + 1)) AS i FROM d)))",
        "st AS (SELECT *, sum(CASE WHEN f = p THEN 0 ELSE 1 END) OVER (PARTITION BY tok ORDER BY i) AS r FROM (SELECT *, lag(f) OVER (PARTITION BY tok ORDER BY i) AS p FROM ch))",
        "rn AS (SELECT *, count(*) OVER (PARTITION BY tok, r) AS n, row_number() OVER (PARTITION BY tok, r ORDER BY i) AS k, first_value(c) OVER (PARTITION BY tok, r ORDER BY i) AS h FROM st)",
        f"o AS (SELECT tok, string_agg(CASE WHEN n >= 3 AND NOT regexp_matches(h, '{excluded}') THEN h ELSE c END, '' ORDER BY i) AS result FROM rn WHERE n < 3 OR regexp_matches(h, '{excluded}') OR k <= {keep} GROUP BY tok)",
        select="SELECT msg_id, pos, result FROM tok JOIN o USING (tok)",
    )


query("L2_characters_to_two", _runs_sql("[0-9±ਊ•.]", 2))(lambda s, d: tokens(s, d).select("msg_id", "pos", flooding.chars_to_two(F.col("tok")).alias("result")))
query("L3_characters_to_one", _runs_sql("[0-9±™•.!?,]", 1))(lambda s, d: tokens(s, d).select("msg_id", "pos", flooding.chars_to_one(F.col("tok")).alias("result")))
query("L4_check_for_correctness", _with(_TOKENS, "k AS (SELECT word AS w FROM lexicon UNION SELECT key FROM flooding_abbrev)", select="SELECT msg_id, pos, tok, lower(tok) IN (SELECT w FROM k WHERE w IS NOT NULL) AS known FROM tok"))(
    lambda s, d: flooding.check(tokens(s, d), "tok", flooding.known_words(t(s, d, "lexicon"), t(s, d, "flooding_abbrev"))).select("msg_id", "pos", "tok", "known")
)
query("L2_L3_corrected_tokens")(lambda s, d: flooding.correct_tokens(tokens(s, d), flooding.known_words(t(s, d, "lexicon"), t(s, d, "flooding_abbrev"))))
query("L5_flooding_correct")(lambda s, d: flooding.correct(texts(s, d, "text_prepro"), flooding.known_words(t(s, d, "lexicon"), t(s, d, "flooding_abbrev"))))
query("L5_flooding_correct_dutch")(lambda s, d: flooding.correct(texts(s, d, "text_prepro"), flooding.known_words(t(s, d, "lexicon"), t(s, d, "flooding_abbrev")), language="nl"))

# Suggestion modules.
_CAST = "CAST(pos AS INTEGER) AS seg"
_BYTOK = f"SELECT msg_id, {_CAST}, tok AS ori, coalesce(alt, tok) AS alt FROM tok LEFT JOIN m USING (tok)"
query("M1_original", _with(_TOKENS, select=f"SELECT msg_id, {_CAST}, tok AS ori, tok AS alt FROM tok"))(lambda s, d: suggest.original(tokens(s, d)))
query("M2_abbreviation", _with(_TOKENS, _UNK, "ab AS (SELECT key, min(expansion) AS alt FROM abbreviation WHERE expansion IS NOT NULL AND expansion <> '' GROUP BY key)", "m AS (SELECT tok, alt FROM unk JOIN ab ON lower(tok) = key)", select=_BYTOK))(
    lambda s, d: suggest.abbreviation(tokens(s, d), t(s, d, "abbreviation"), t(s, d, "lexicon"))
)
query("M3_spelling")(lambda s, d: suggest.spelling(tokens(s, d), t(s, d, "lexicon")))
query(
    "M4_compound",
    _with(
        _TOKENS,
        _LEX,
        "n AS (SELECT *, lead(tok) OVER (PARTITION BY msg_id ORDER BY pos) AS nxt FROM tok)",
        "c AS (SELECT *, nxt IS NOT NULL AND tok NOT IN ('•', '±', '∞', 'ਊ') AND substring(nxt, 1, 1) NOT IN ('•', '±', '∞', 'ਊ', '?', '.', '!') AND (tok || nxt) IN (SELECT word FROM lex WHERE word IS NOT NULL) AS cand FROM n)",
        "r AS (SELECT *, sum(CASE WHEN cand THEN 0 ELSE 1 END) OVER (PARTITION BY msg_id ORDER BY pos) AS run FROM c)",
        "k AS (SELECT *, cand AND sum(CAST(cand AS INTEGER)) OVER (PARTITION BY msg_id, run ORDER BY pos) % 2 = 1 AS take FROM r)",
        "u AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY msg_id ORDER BY pos), false) AS used FROM k)",
        select=f"SELECT msg_id, {_CAST}, CASE WHEN used THEN '' WHEN take THEN tok || ' ' || nxt ELSE tok END AS ori, CASE WHEN used THEN '' WHEN take THEN tok || nxt ELSE tok END AS alt FROM u",
    ),
)(lambda s, d: suggest.compound(tokens(s, d), t(s, d, "lexicon")))
query(
    "M5_word_split",
    _with(
        _TOKENS,
        _LEXF,
        "sp AS (SELECT tok, i, substring(tok, 1, CAST(i AS INTEGER)) AS a, substring(tok, CAST(i AS INTEGER) + 1) AS b FROM (SELECT tok, unnest(range(2, length(tok) - 1)) AS i FROM (SELECT DISTINCT tok FROM tok WHERE length(tok) >= 4)))",
        "sc AS (SELECT sp.tok, i, a, b, sqrt(CAST(x.f AS DOUBLE) * CAST(y.f AS DOUBLE)) AS s, z.f AS whole FROM sp JOIN lexf x ON x.word = a JOIN lexf y ON y.word = b LEFT JOIN lexf z ON z.word = sp.tok)",
        "m AS (SELECT tok, a || ' ' || b AS alt FROM (SELECT *, row_number() OVER (PARTITION BY tok ORDER BY s DESC, i) AS rn FROM sc WHERE s > coalesce(whole, 0)) WHERE rn = 1)",
        select=_BYTOK,
    ),
)(lambda s, d: suggest.word_split(tokens(s, d), t(s, d, "lexicon")))
query(
    "M6_phonemic",
    _with(
        _TOKENS,
        _UNK,
        f"snd AS (SELECT {suggest.sound_key_sql('word')} AS key, word, freq FROM lexicon WHERE word IS NOT NULL)",
        "best AS (SELECT key, word FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY freq DESC, word) AS rn FROM snd) WHERE rn = 1)",
        f"m AS (SELECT tok, word AS alt FROM (SELECT tok, {suggest.sound_key_sql('tok')} AS key FROM unk WHERE regexp_full_match(tok, '\\p{{L}}+') AND length(tok) >= 3) JOIN best USING (key))",
        select=_BYTOK,
    ),
)(lambda s, d: suggest.phonemic(tokens(s, d), t(s, d, "lexicon")))
_PHRASE = "ph AS (SELECT src, tgt, count(*) AS n FROM (SELECT tok[i] AS src, tgt[i] AS tgt FROM (SELECT tok, tgt, unnest(range(1, len(tok) + 1)) AS i FROM gold WHERE tok IS NOT NULL AND tgt IS NOT NULL)) WHERE src IS NOT NULL AND tgt IS NOT NULL AND tgt NOT IN ('<com>', '<split>', '<LINEBREAK>') GROUP BY 1, 2)"
query("M7_smt_token", _with(_TOKENS, _GOLDS, _PHRASE, "m AS (SELECT src AS tok, tgt AS alt FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, tgt) AS rn FROM ph) WHERE rn = 1)", select=_BYTOK))(lambda s, d: suggest.smt_token(tokens(s, d), resources(s, d)["gold"]))


def _chars_sql(n: int) -> str:
    gram = "substring(src, i, 1)" if n == 1 else "substring('#' || src, i, 2)"
    seen = "substring(tok, i, 1)" if n == 1 else "substring('#' || tok, i, 2)"
    return _with(
        _TOKENS,
        _GOLDS,
        _PHRASE,
        f"pr AS (SELECT {gram} AS g, substring(tgt, i, 1) AS o, sum(n) AS n FROM (SELECT src, tgt, n, CAST(unnest(range(1, length(tgt) + 1)) AS INTEGER) AS i FROM ph WHERE length(src) = length(tgt) AND length(src) > 0) GROUP BY 1, 2)",
        "tb AS (SELECT g, o FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, o) AS rn FROM pr) WHERE rn = 1)",
        f"c AS (SELECT tok, i, {seen} AS g, substring(tok, i, 1) AS self FROM (SELECT tok, CAST(unnest(range(1, length(tok) + 1)) AS INTEGER) AS i FROM (SELECT DISTINCT tok FROM tok)))",
        "m AS (SELECT tok, string_agg(coalesce(o, self), '' ORDER BY i) AS alt FROM c LEFT JOIN tb USING (g) GROUP BY tok)",
        select=_BYTOK,
    )


query("M8_smt_unigram", _chars_sql(1))(lambda s, d: suggest.smt_chars(tokens(s, d), resources(s, d)["gold"], 1))
query("M9_smt_bigram", _chars_sql(2))(lambda s, d: suggest.smt_chars(tokens(s, d), resources(s, d)["gold"], 2))
_BEST_PHRASE = "m7 AS (SELECT src, tgt AS mid FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, tgt) AS rn FROM ph) WHERE rn = 1)"
_CASCADE = _with(
    _TOKENS,
    _GOLDS,
    _PHRASE,
    _BEST_PHRASE,
    "mids AS (SELECT tok, coalesce(mid, tok) AS mid FROM (SELECT DISTINCT tok FROM tok) LEFT JOIN m7 ON src = tok)",
    "pr AS (SELECT substring(src, i, 1) AS g, substring(tgt, i, 1) AS o, sum(n) AS n FROM (SELECT src, tgt, n, CAST(unnest(range(1, length(tgt) + 1)) AS INTEGER) AS i FROM ph WHERE length(src) = length(tgt) AND length(src) > 0) GROUP BY 1, 2)",
    "tb AS (SELECT g, o FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, o) AS rn FROM pr) WHERE rn = 1)",
    "c AS (SELECT mid, i, substring(mid, i, 1) AS g FROM (SELECT mid, CAST(unnest(range(1, length(mid) + 1)) AS INTEGER) AS i FROM (SELECT DISTINCT mid FROM mids)))",
    "o2 AS (SELECT mid, string_agg(coalesce(o, g), '' ORDER BY i) AS alt FROM c LEFT JOIN tb USING (g) GROUP BY mid)",
    "m AS (SELECT tok, alt FROM mids JOIN o2 USING (mid))",
    select=_BYTOK,
)
query("M10_smt_cascaded", _CASCADE)(lambda s, d: suggest.smt_cascaded(tokens(s, d), resources(s, d)["gold"]))
_TRANSLIT = _with(
    _TOKENS,
    _GOLDS,
    _PHRASE,
    "pr AS (SELECT substring('@' || src || '@', i, 3) AS g, substring(tgt, i, 1) AS o, sum(n) AS n FROM (SELECT src, tgt, n, CAST(unnest(range(1, length(tgt) + 1)) AS INTEGER) AS i FROM ph WHERE length(src) = length(tgt) AND length(src) > 0) GROUP BY 1, 2)",
    "tb AS (SELECT g, o FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, o) AS rn FROM pr) WHERE rn = 1)",
    "c AS (SELECT tok, i, substring('@' || tok || '@', i, 3) AS g, substring(tok, i, 1) AS self FROM (SELECT tok, CAST(unnest(range(1, length(tok) + 1)) AS INTEGER) AS i FROM (SELECT DISTINCT tok FROM tok)))",
    "m AS (SELECT tok, string_agg(coalesce(o, self), '' ORDER BY i) AS alt FROM c LEFT JOIN tb USING (g) GROUP BY tok)",
    select=_BYTOK,
)
query("M11_transliterate", _TRANSLIT)(lambda s, d: suggest.transliterate(tokens(s, d), resources(s, d)["gold"]))
query("M12_empty", _with(_TOKENS, select=f"SELECT msg_id, {_CAST}, tok AS ori, '' AS alt FROM tok"))(lambda s, d: suggest.empty(tokens(s, d)))
_NE = "ent AS (SELECT msg_id, pos, tok, lower(tok) IN (SELECT key FROM gazetteer WHERE key IS NOT NULL) OR regexp_full_match(tok, '@[\\w\\d]+') OR (prev IS NOT NULL AND prev NOT IN ('!', '.', '?', '-', ':', '...') AND regexp_full_match(tok, '\\p{Lu}\\p{Ll}+')) AS is_ne FROM (SELECT *, lag(tok) OVER (PARTITION BY msg_id ORDER BY pos) AS prev FROM tok))"
query("M13_new_ne", _with(_TOKENS, _NE, select=f"SELECT msg_id, {_CAST}, tok AS ori, CASE WHEN is_ne THEN 'ਊ' ELSE tok END AS alt FROM ent"))(lambda s, d: suggest.named_entities(tokens(s, d), t(s, d, "gazetteer")))
query("M13a_at_reply", _with(_TOKENS, select="SELECT msg_id, pos, regexp_full_match(tok, '@[\\w\\d]+') AS is_reply FROM tok"))(lambda s, d: tokens(s, d).select("msg_id", "pos", F.col("tok").rlike("^@[\\w\\d]+$").alias("is_reply")))
query("M13r_entity_flags", _with(_TOKENS, _NE, select=f"SELECT msg_id, {_CAST}, tok, is_ne FROM ent"))(lambda s, d: suggest.entity_flags(tokens(s, d), t(s, d, "gazetteer")))

# Token, n-gram and alignment functions.
query("T1_chunks", _with(_TOKENS, select="SELECT msg_id, pos, CAST(floor(pos / 50) AS INTEGER) AS chunk FROM tok"))(lambda s, d: tokens(s, d).select("msg_id", "pos", F.floor(F.col("pos") / 50).cast("int").alias("chunk")))


def _ngram_sql(n: int) -> str:
    s = "('#' || replace(text_orig, ' ', '#') || '#')"
    return _with(_TEXTS, select=f"SELECT msg_id, CASE WHEN length({s}) >= {n} THEN array_to_string(list_transform(range(1, length({s}) - {n} + 2), lambda i: substring({s}, CAST(i AS INTEGER), {n})), ' ') WHEN text_orig IS NOT NULL THEN '' END AS ngrams FROM txt")


query("T2_string_to_ngrams", _ngram_sql(2))(lambda s, d: texts(s, d).select("msg_id", F.when(F.col("text_orig").isNotNull(), X.ngrams(F.col("text_orig"), 2)).alias("ngrams")))
query("T3_ngrams_to_string", _with(_TEXTS, select="SELECT msg_id, CASE WHEN text_orig IS NULL THEN '' ELSE translate(regexp_replace('#' || replace(translate(text_orig, chr(160), ' '), ' ', '#') || '#', '^#|#$', '', 'g'), '#', ' ') END AS text FROM txt"))(lambda s, d: texts(s, d).select("msg_id", X.from_ngrams(X.ngrams(F.translate(F.col("text_orig"), " ", " "), 2), 2).alias("text")))
query("T4_vectorize", _with(_TOKENS, select="SELECT tok, array_to_string(list_transform(range(1, length(tok) + 1), lambda i: array_to_string(list_transform(range(0, 10), lambda k: k || '-' || substring('@@@@@' || tok || '@@@@@', CAST(i + k AS INTEGER), 1)), ' ')), ' | ') AS keys FROM (SELECT DISTINCT tok FROM tok)"))(
    lambda s, d: tokens(s, d).select("tok").distinct().select("tok", F.array_join(F.transform(X.windows(F.col("tok")), lambda k: F.array_join(k, " ")), " | ").alias("keys"))
)
_T5 = "t5 AS (SELECT msg_id, pos, coalesce(lag(tok) OVER w, '<s>') AS w1, tok AS w2 FROM tok WINDOW w AS (PARTITION BY msg_id ORDER BY pos) UNION ALL SELECT msg_id, pos + 1, tok, '</s>' FROM (SELECT *, lead(tok) OVER (PARTITION BY msg_id ORDER BY pos) AS nx FROM tok) WHERE nx IS NULL)"
query("T5_2grams", _with(_TOKENS, _T5, select="SELECT * FROM t5"))(lambda s, d: filtering.sentence_bigrams(tokens(s, d)))
query("T6_unk_marks", _with(_TEXTS, select=r"SELECT msg_id, regexp_replace(text_orig || ' ab|UNK|UNKB c', '(\|UNK[BQk]?)+', '', 'g') AS result FROM txt"))(lambda s, d: texts(s, d).select("msg_id", align.without_unk(F.concat("text_orig", F.lit(" ab|UNK|UNKB c"))).alias("result")))
_esc = "text_orig"
for _a, _b in align.ESCAPES:
    _esc = f"replace({_esc}, {'chr(10)' if _a == chr(10) else quoted(_a)}, {quoted(_b)})"
query("T7_escape", _with(_TEXTS, select=f"SELECT msg_id, {_esc} AS result FROM txt"))(lambda s, d: texts(s, d).select("msg_id", align.replaced(F.col("text_orig"), align.ESCAPES).alias("result")))
query("A1_align")(lambda s, d: align.align(sinks.parallel_corpus(resources(s, d)["gold"].where("tgt is not null").select("post_id", "post", "ori", "tok", "tgt")).select("post", "tok", "tgt"), "post", "tok", "tgt"))
query("A2_combine_trans")(lambda s, d: align.combine(resources(s, d)["gold"].where("tgt is not null").select("post_id", F.array_join("tok", " ").alias("o"), F.array_join("tgt", "|UNK ").alias("x")), "post_id", "o", "x"))
query("K9_align_fallback")(lambda s, d: align.align(t(s, d, "documents").select("doc_id", "text", F.lower("text").alias("low")), "doc_id", "text", "low").groupBy("align_fallback").agg(F.countDistinct("doc_id").alias("n_docs")))
_rates = lambda s, d: resources(s, d)["gold"].where("tgt is not null").select("post_id", F.lit("before").alias("module"), F.array_join("tgt", " ").alias("ref"), F.array_join("ori", " ").alias("hyp"))
query("E1_cer")(lambda s, d: _rates(s, d).select("post_id", X.cer(F.col("ref"), F.col("hyp")).alias("cer")))
query("E2_wer")(lambda s, d: _rates(s, d).select("post_id", F.round(X.wer(F.col("ref"), F.col("hyp")), 6).alias("wer")))
query("E3_check_hunspell", _with(_TOKENS, _LEX, select="SELECT DISTINCT tok, tok IN (SELECT word FROM lex WHERE word IS NOT NULL) AS known FROM tok"))(lambda s, d: decide.known_phrases(tokens(s, d).select("tok").distinct(), "tok", t(s, d, "lexicon")))

# Filtering.
_FLAG = "fl AS (SELECT msg_id, pos, tok, NOT EXISTS (SELECT 1 FROM bi WHERE bi.w1 = l AND bi.w2 = tok) AND NOT EXISTS (SELECT 1 FROM bi WHERE bi.w1 = tok AND bi.w2 = r) AS to_correct FROM (SELECT *, coalesce(lag(tok) OVER w, '<s>') AS l, coalesce(lead(tok) OVER w, '</s>') AS r FROM tok WINDOW w AS (PARTITION BY msg_id ORDER BY pos)))"
query("F0_no_filter", _with(_TOKENS, select="SELECT msg_id, pos, true AS to_correct FROM tok"))(lambda s, d: tokens(s, d).select("msg_id", "pos", F.lit(True).alias("to_correct")))
query("F1_bigram_model", _with(_GTOK, _BIGRAM, select="SELECT * FROM bi"))(lambda s, d: resources(s, d)["bigram"])
query("F2_preclassify", _with(_TOKENS, _GTOK, _BIGRAM, _FLAG, select="SELECT * FROM fl"))(lambda s, d: filtering.preclassify(tokens(s, d), resources(s, d)["bigram"]))
query("F2_word_flags", _with(_TOKENS, _GTOK, _BIGRAM, _FLAG, select="SELECT msg_id, tok, arg_max(to_correct, pos) AS flag FROM fl GROUP BY 1, 2"))(lambda s, d: filtering.word_flags(filtering.preclassify(tokens(s, d), resources(s, d)["bigram"])))
query("F3_hard_filter", _with(_TOKENS, _GTOK, _BIGRAM, _FLAG, _NE, select="SELECT fl.msg_id, fl.pos FROM fl JOIN ent USING (msg_id, pos) WHERE to_correct AND NOT is_ne"))(
    lambda s, d: filtering.hard_filter(filtering.preclassify(tokens(s, d), resources(s, d)["bigram"]), suggest.entity_flags(tokens(s, d), t(s, d, "gazetteer")))
)


def _outputs(s: SparkSession, d: str, names: list[str]) -> DataFrame:
    registry = suggest.modules(resources(s, d))
    toks = tokens(s, d)
    return decide.union({n: registry[n](toks) for n in names})


_SOFT = ["original", "abbreviation", "named_entities"]
_M2 = "ab AS (SELECT key, min(expansion) AS alt FROM abbreviation WHERE expansion IS NOT NULL AND expansion <> '' GROUP BY key), m2 AS (SELECT tok, alt FROM unk JOIN ab ON lower(tok) = key)"
_SUGG = "sg AS (SELECT msg_id, CAST(pos AS INTEGER) AS seg, 0 AS mod_ord, 'original' AS module, tok AS ori, tok AS alt FROM tok UNION ALL SELECT msg_id, CAST(pos AS INTEGER), 1, 'abbreviation', tok, coalesce(alt, tok) FROM tok LEFT JOIN m2 USING (tok) UNION ALL SELECT msg_id, CAST(pos AS INTEGER), 2, 'named_entities', tok, CASE WHEN is_ne THEN 'ਊ' ELSE tok END FROM ent)"
_SUGGS = (_TOKENS, _UNK, _M2, _NE, _SUGG)
query(
    "F4_soft_filter",
    _with(
        *_SUGGS,
        _GTOK,
        _BIGRAM,
        _FLAG,
        "wf AS (SELECT msg_id, tok FROM fl GROUP BY 1, 2 HAVING arg_max(to_correct, pos))",
        "ne AS (SELECT DISTINCT msg_id, ori FROM sg WHERE alt = 'ਊ')",
        select="SELECT sg.msg_id, seg, module, sg.ori, alt, CAST(wf.tok IS NOT NULL AS INTEGER) AS pre, CAST(ne.ori IS NOT NULL AS INTEGER) AS ne FROM sg LEFT JOIN wf ON wf.msg_id = sg.msg_id AND wf.tok = sg.ori LEFT JOIN ne ON ne.msg_id = sg.msg_id AND ne.ori = sg.ori",
    ),
)(lambda s, d: filtering.soft_filter(_outputs(s, d, _SOFT).select("msg_id", "seg", "module", "ori", "alt"), filtering.preclassify(tokens(s, d), resources(s, d)["bigram"])))

# Combination and decision.
_PHR = "phr AS (SELECT msg_id, trim(alt) AS alt, arg_min(ori, mod_ord * 1000000 + seg) AS ori, list_sort(list_distinct(list(module))) AS modules FROM sg GROUP BY msg_id, trim(alt))"
query("C1_phrases", _with(*_SUGGS, _PHR, select="SELECT msg_id, alt, ori, array_to_string(modules, ',') AS modules FROM phr"))(lambda s, d: decide.phrases(_outputs(s, d, _SOFT)).withColumn("modules", F.array_join("modules", ",")))
_KNOWN = "kn AS (SELECT alt, bool_and(p IN (SELECT word FROM lex WHERE word IS NOT NULL)) AS known FROM (SELECT alt, unnest(string_split(alt, ' ')) AS p FROM (SELECT DISTINCT alt FROM phr WHERE alt <> '')) WHERE p <> '' GROUP BY alt)"
_FEATS = "ft AS (SELECT msg_id, ori, alt, CAST(list_contains(modules, 'original') AS INTEGER) || ' ' || CAST(list_contains(modules, 'abbreviation') AS INTEGER) || ' ' || CAST(list_contains(modules, 'named_entities') AS INTEGER) || ' ' || CAST(coalesce(known, false) AS INTEGER) AS features FROM phr LEFT JOIN kn USING (alt))"
_table = lambda s, d: decide.phrase_table(decide.phrases(_outputs(s, d, _SOFT)), _SOFT, t(s, d, "lexicon"))
query("C2_phrase_table", _with(*_SUGGS, _PHR, _KNOWN, _FEATS, select="SELECT * FROM ft"))(lambda s, d: _table(s, d).withColumn("features", F.array_join(F.col("features").cast("array<string>"), " ")))
query("K3_phrase_table_lines", _with(*_SUGGS, _PHR, _KNOWN, _FEATS, select="SELECT msg_id, ori || ' ||| ' || alt || ' ||| ' || features AS line FROM ft"))(lambda s, d: decide.table_lines(_table(s, d)))
_BEST = "kn2 AS (SELECT alt, bool_and(p IN (SELECT word FROM lex WHERE word IS NOT NULL)) AS known FROM (SELECT alt, unnest(string_split(alt, ' ')) AS p FROM (SELECT DISTINCT alt FROM sg WHERE alt <> '')) WHERE p <> '' GROUP BY alt), bst AS (SELECT msg_id, seg, ori, alt AS tgt FROM (SELECT *, row_number() OVER (PARTITION BY msg_id, seg ORDER BY votes + CAST(coalesce(known, false) AS INTEGER) DESC, first, alt, ori) AS rn FROM (SELECT msg_id, seg, ori, alt, count(*) AS votes, min(mod_ord) AS first FROM sg GROUP BY 1, 2, 3, 4) LEFT JOIN kn2 USING (alt)) WHERE rn = 1)"
query("C3_best_by_place", _with(*_SUGGS, _BEST, select="SELECT * FROM bst"))(lambda s, d: decide.best_by_place(_outputs(s, d, _SOFT), t(s, d, "lexicon")))
query("C3_viterbi")(lambda s, d: decide.viterbi(_outputs(s, d, ["original", "abbreviation", "smt_token"]), resources(s, d)["bigram"]))
query("C5_assemble", _with(*_SUGGS, _BEST, select="SELECT msg_id, coalesce(string_agg(tgt, ' ' ORDER BY seg) FILTER (tgt <> ''), '') AS text_norm FROM bst GROUP BY msg_id"))(lambda s, d: decide.assemble(decide.best_by_place(_outputs(s, d, _SOFT), t(s, d, "lexicon"))))
query("R1_normalize")(lambda s, d: pipeline.normalize(texts(s, d), resources(s, d)))
query("R2_preprocess")(lambda s, d: pipeline.preprocess_run(texts(s, d), flooding.known_words(t(s, d, "lexicon"), t(s, d, "flooding_abbrev"))))

# Evaluation.
_NAMES = ["original", "abbreviation", "smt_token", "named_entities"]
_GT = "gt AS (SELECT post_id AS msg_id, pos, tok FROM gtok)"
_GSUGG = (
    _GTOK,
    "tok AS (SELECT post_id AS msg_id, pos, tok FROM gtok)",
    _UNK,
    _M2,
    _NE,
    _PHRASE,
    "m7 AS (SELECT src AS tok, tgt AS alt FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, tgt) AS rn FROM ph) WHERE rn = 1)",
    "sg AS (SELECT msg_id AS post_id, CAST(pos AS INTEGER) AS seg, 'original' AS module, tok AS ori, tok AS alt FROM tok UNION ALL SELECT msg_id, CAST(pos AS INTEGER), 'abbreviation', tok, coalesce(alt, tok) FROM tok LEFT JOIN m2 USING (tok) UNION ALL SELECT msg_id, CAST(pos AS INTEGER), 'smt_token', tok, coalesce(alt, tok) FROM tok LEFT JOIN m7 USING (tok) UNION ALL SELECT msg_id, CAST(pos AS INTEGER), 'named_entities', tok, CASE WHEN is_ne THEN 'ਊ' ELSE tok END FROM ent)",
    "pr AS (SELECT o.post_id, seg, module, o.ori, alt, CASE WHEN module = 'named_entities' AND is_ne THEN 'ਊ' ELSE tgt END AS tgt, is_ne FROM (SELECT *, row_number() OVER (PARTITION BY post_id, module, ori ORDER BY seg) AS k FROM sg) o JOIN (SELECT post_id, tok AS ori, tgt, is_ne, row_number() OVER (PARTITION BY post_id, tok ORDER BY pos) AS k FROM gtok) g ON o.post_id = g.post_id AND o.ori = g.ori AND o.k = g.k)",
)
_CLASS = (
    f"cl AS (SELECT *, len(aw) AS a, len(bw) AS b, len(ow) AS o, len(list_intersect(list_distinct(aw), list_distinct(bw))) AS c FROM (SELECT *, {_WORDS('alt')} AS aw, {_WORDS('tgt')} AS bw, {_WORDS('ori')} AS ow FROM pr))",
    "ca AS (SELECT *, CASE WHEN ori = tgt AND tgt = alt THEN 'nothing' WHEN ori = tgt THEN 'over' WHEN tgt = alt THEN 'corrected' ELSE 'missed' END AS kind, tgt <> alt AS e FROM cl)",
    "cn AS (SELECT module, sum(b) AS N, sum(o) AS tokens_overall, sum(a) AS num_sugg, sum(CASE WHEN kind = 'nothing' THEN a ELSE 0 END) AS n_nothing, sum(CASE WHEN kind = 'over' THEN a ELSE 0 END) AS n_over, sum(CASE WHEN kind = 'corrected' THEN a ELSE 0 END) AS n_corrected, sum(CASE WHEN kind = 'missed' THEN o ELSE 0 END) AS n_missed, sum(CASE WHEN e AND a < b THEN b - a ELSE 0 END) AS D, sum(CASE WHEN e AND a > b THEN a - b ELSE 0 END) AS I, sum(CASE WHEN e AND a <= b THEN a - c WHEN e THEN b - c ELSE 0 END) AS S FROM ca GROUP BY module)",
)
_pairs = lambda s, d: pipeline.module_pairs(resources(s, d)["gold"], resources(s, d), _NAMES)
query("V2_matched_tokens", _with(*_GSUGG, select="SELECT * FROM pr"))(_pairs)
query("V3_counters", _with(*_GSUGG, *_CLASS, select="SELECT module, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in "N tokens_overall num_sugg n_nothing n_over n_corrected n_missed D I S".split()) + " FROM cn"))(lambda s, d: evaluate.counters(_pairs(s, d)))
query("V6_alignment_wer", _with(*_GSUGG, *_CLASS, select="SELECT cn.module, round((D + S + I + abs(n0 - N)) / n0, 6) AS wer FROM cn, (SELECT CAST(N AS DOUBLE) AS n0 FROM cn WHERE module = 'original')"))(lambda s, d: evaluate.alignment_wer(evaluate.counters(_pairs(s, d))))
query("V7_precision_recall", _with(*_GSUGG, *_CLASS, select='SELECT cn.module, round((n_corrected + nothing - n_over) / CAST(nullif(num_sugg, 0) AS DOUBLE), 6) AS "precision", round((n_corrected + nothing - n_over) / CAST(nullif(N, 0) AS DOUBLE), 6) AS recall FROM cn, (SELECT n_nothing AS nothing FROM cn WHERE module = \'original\')'))(
    lambda s, d: evaluate.precision_recall(evaluate.counters(_pairs(s, d)))
)
query("V11_token_lists", _with(*_GSUGG, *_CLASS, select='SELECT module, kind AS "case", ori, count(*) AS n FROM ca WHERE kind <> \'nothing\' GROUP BY 1, 2, 3'))(lambda s, d: evaluate.token_lists(_pairs(s, d)))
query("V9_ne_target", _with(_GTOK, select="SELECT post_id, pos, CASE WHEN is_ne THEN 'ਊ' ELSE tgt END AS tgt FROM gtok"))(
    lambda s, d: evaluate.ne_target(evaluate.gold_tokens(resources(s, d)["gold"]).withColumn("module", F.lit("named_entities"))).select("post_id", "pos", "tgt")
)
_V1 = "v1 AS (SELECT post_id, CAST(pair AS INTEGER) AS pair, coalesce(string_agg(ori, ' ' ORDER BY pos) FILTER (NOT split), '') AS ori, coalesce(string_agg(tgt, ' ' ORDER BY pos) FILTER (NOT com), '') AS tgt FROM (SELECT *, sum(CASE WHEN com OR split THEN 0 ELSE 1 END) OVER (PARTITION BY post_id ORDER BY pos) AS pair FROM (SELECT *, lower(tgt) = '<com>' AS com, lower(ori) = '<split>' AS split FROM gtok WHERE ori <> '<LINEBREAK>')) WHERE pair > 0 GROUP BY post_id, pair)"
query("V1_realigned_gold", _with(_GTOK, _V1, select="SELECT * FROM v1"))(lambda s, d: evaluate.realigned(evaluate.gold_tokens(resources(s, d)["gold"])))
query(
    "V8_coverage",
    _with(
        *_GSUGG,
        _V1,
        f"cv AS (SELECT v1.post_id, len({_WORDS('v1.tgt')}) AS n, EXISTS (SELECT 1 FROM sg WHERE sg.post_id = v1.post_id AND sg.ori = v1.ori AND sg.alt = v1.tgt) AS hit FROM v1)",
        f"tt AS (SELECT CAST(coalesce(sum(n) FILTER (hit), 0) AS BIGINT) AS found, CAST(coalesce(sum(n) FILTER (NOT hit), 0) AS BIGINT) AS not_found, (SELECT sum(len({_WORDS('alt')})) FROM sg) AS words FROM cv)",
        select='SELECT found, not_found, round(found / CAST(words AS DOUBLE), 6) AS "precision", round(found / CAST(found + not_found AS DOUBLE), 6) AS recall FROM tt',
    ),
)(lambda s, d: evaluate.coverage(evaluate.realigned(evaluate.gold_tokens(resources(s, d)["gold"])), _pairs(s, d)))
query("V4_sentence_rates")(lambda s, d: evaluate.sentence_rates(_rates(s, d)))
query("V5_average_rates")(lambda s, d: evaluate.average_rates(evaluate.sentence_rates(_rates(s, d))))
query("V10_preclass_counters", _with(_GTOK, "tok AS (SELECT post_id AS msg_id, pos, tok FROM gtok)", _BIGRAM, _FLAG, select="SELECT count(*) FILTER (g.tok <> g.tgt AND to_correct) AS corrected, count(*) FILTER (g.tok = g.tgt AND to_correct) AS over_corrected, count(*) FILTER (g.tok <> g.tgt AND NOT to_correct) AS not_found FROM gtok g JOIN fl ON fl.msg_id = g.post_id AND fl.pos = g.pos"))(
    lambda s, d: (
        lambda g: evaluate.preclass_counters(filtering.preclassify(g.select(F.col("post_id").alias("msg_id"), "pos", "tok"), resources(s, d)["bigram"]).join(g.select(F.col("post_id").alias("msg_id"), "pos", F.col("tok").alias("ori"), "tgt"), ["msg_id", "pos"]))
    )(evaluate.gold_tokens(resources(s, d)["gold"]))
)
query("J8_gold_by_text", _with(_TEXTS, _GOLDS, select="SELECT DISTINCT t.msg_id, g.post_id FROM (SELECT msg_id, translate(text_orig, chr(160) || chr(8206), ' ') AS x FROM txt WHERE text_orig IS NOT NULL) t JOIN gold g ON g.post = t.x"))(
    lambda s, d: texts(s, d).select("msg_id", F.translate("text_orig", " ‎", " ").alias("post")).join(resources(s, d)["gold"].select("post_id", "post"), "post").select("msg_id", "post_id").distinct()
)

# Gold sheets and annotations, built from the gold records.
_SHEET = "sheet AS (SELECT CAST(post_id % 16 AS VARCHAR) AS file, post_id * 100000 + i - 1 AS row_no, CASE WHEN i = 1 AND post_id % 7 = 0 THEN 'x' ELSE '' END AS c0, CASE WHEN i = 1 THEN post_id || ' ' || post ELSE '' END AS c2, ori[i] AS c3, CASE WHEN tok[i] = ori[i] THEN '' ELSE tok[i] END AS c4, CASE WHEN tgt[i] = ori[i] THEN '' ELSE tgt[i] END AS c6, CASE WHEN ori[i] LIKE '#%' THEN 'x' ELSE '' END AS c7, CASE WHEN list_contains(ne, i - 1) THEN 'x' ELSE '' END AS c10 FROM (SELECT *, unnest(range(1, len(ori) + 1)) AS i FROM gold WHERE tgt IS NOT NULL))"


def sheet(s: SparkSession, d: str) -> DataFrame:
    """Gold records as the rows of a gold CSV sheet (FX2)."""
    g = resources(s, d)["gold"].where("tgt is not null").select("post_id", "post", "ne", F.posexplode(F.arrays_zip("ori", "tok", "tgt")).alias("i", "z"))
    first, o = F.col("i") == 0, F.col("z.ori")
    other = lambda c: F.when(F.col(f"z.{c}") == o, "").otherwise(F.col(f"z.{c}"))
    cells = {"c0": F.when(first & (F.col("post_id") % 7 == 0), "x").otherwise(""), "c2": F.when(first, F.concat_ws(" ", F.col("post_id").cast("string"), "post")).otherwise(""), "c3": o, "c4": other("tok"), "c6": other("tgt"), "c7": F.when(F.startswith(o, F.lit("#")), "x").otherwise(""), "c10": F.when(F.array_contains("ne", F.col("i")), "x").otherwise("")}
    blank = [F.lit("").alias(c) for c in ("c8", "c9", "c21")]
    return g.select((F.col("post_id") % 16).cast("string").alias("file"), (F.col("post_id") * 100000 + F.col("i")).alias("row_no"), *[v.alias(k) for k, v in cells.items()], *blank)


query("S5_google_docs", _with(_GTOK, select="SELECT post_id, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace('''' || ori, '^''0', '0'), '^''''', ''''), '^''=', '='), '^''\\+', '+') AS cell FROM gtok"))(
    lambda s, d: evaluate.gold_tokens(resources(s, d)["gold"]).select("post_id", "pos", readers.google_docs(F.concat(F.lit("'"), "ori")).alias("cell"))
)
query("S4_clean_cells", _with(_GTOK, select="SELECT post_id, pos, replace(trim(translate(ori || '  x' || chr(160), chr(160) || chr(8206), ' ')), '  ', ' ') AS cell FROM gtok"))(
    lambda s, d: evaluate.gold_tokens(resources(s, d)["gold"]).select("post_id", "pos", readers.cleaned(F.concat("ori", F.lit("  x "))).alias("cell"))
)
query("S7_skipped_posts", _with(_GOLDS, _SHEET, "f AS (SELECT *, sum(CASE WHEN c2 <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY row_no) AS p FROM sheet)", select="SELECT file, row_no, c3 FROM (SELECT *, first_value(c0) OVER (PARTITION BY file, p ORDER BY row_no) AS sk FROM f) WHERE sk = ''"))(
    lambda s, d: readers.without_skipped(sheet(s, d)).select("file", "row_no", "c3")
)
_POSTS = "f AS (SELECT *, last_value(nullif(c2, '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS post FROM sheet)"
_ROWS = "SELECT file, row_no, post, CAST(row_number() OVER (PARTITION BY file, post ORDER BY row_no) - 1 AS INTEGER) AS pos, c3 AS ori, CASE WHEN c7 <> '' THEN '•' WHEN c4 = '' THEN c3 ELSE c4 END AS tok, CASE WHEN c7 <> '' THEN '•' WHEN c6 = '' THEN c3 ELSE c6 END AS tgt, c10 <> '' AS is_ne FROM f WHERE c3 <> '' AND post IS NOT NULL"
query("S8_gold_loader", _with(_GOLDS, _SHEET, _POSTS, select=_ROWS))(lambda s, d: readers.gold_rows(sheet(s, d)))
_RECORDS = _with(
    _GOLDS,
    _SHEET,
    _POSTS,
    f"r AS ({_ROWS})",
    "g AS (SELECT file, post, max(row_no) AS last, string_agg(ori, ' ' ORDER BY pos) AS ori, string_agg(tok, ' ' ORDER BY pos) AS tok, string_agg(tgt, ' ' ORDER BY pos) AS tgt, coalesce(string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) FILTER (is_ne), '') AS ne FROM r GROUP BY file, post)",
    select="SELECT post, ori, tok, tgt, ne FROM (SELECT *, row_number() OVER (PARTITION BY post ORDER BY file DESC, last DESC) AS rn FROM g) WHERE rn = 1",
)
query("S8_gold_records", _RECORDS)(
    lambda s, d: readers.gold_records(readers.gold_rows(sheet(s, d))).select("post", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("ori", "tok", "tgt", "ne")])
)
query("S10_row_width", _with(_GOLDS, select="SELECT post_id, len(ori) + 4 AS cells FROM gold"))(
    lambda s, d: readers.checked_width(resources(s, d)["gold"].select("post_id", F.concat("ori", F.array_repeat(F.lit(""), 4)).alias("row")), "row", 0).select("post_id", F.size("row").cast("bigint").alias("cells"))
)
query("K4_parallel_corpus", _with(_GOLDS, select="SELECT post, array_to_string(ori, ' ') AS ori, array_to_string(tok, ' ') AS tok, array_to_string(tgt, ' ') AS tgt FROM gold WHERE tgt IS NOT NULL"))(lambda s, d: sinks.parallel_corpus(resources(s, d)["gold"]))
_SHEETW = f"ws AS (SELECT DISTINCT msg_id AS id, translate(text_orig, chr(160), ' ') AS text, {_WORDS(chr(40) + 'translate(text_orig, chr(160), ' + chr(39) + ' ' + chr(39) + '))')} AS w FROM messages WHERE text_orig IS NOT NULL)"
query("K6_annotation_sheet", _with(_SHEETW, select="SELECT id, CAST(i - 1 AS INTEGER) AS row_no, CASE WHEN i = 1 AND len(w) > 0 THEN CAST(id AS VARCHAR) ELSE '' END AS c0, CASE WHEN i = 1 AND len(w) > 0 THEN text ELSE '' END AS c1, CASE WHEN i <= len(w) THEN w[i] ELSE '' END AS c2 FROM (SELECT *, unnest(range(1, len(w) + 2)) AS i FROM ws)"))(
    lambda s, d: sinks.annotation_sheet(texts(s, d).where("text_orig is not null"), "msg_id", "text_orig")
)
query("K7_numbered_sheet", _with(_SHEETW, "nm AS (SELECT printf('sms%05d', row_number() OVER (ORDER BY id)) AS nid, text, w FROM ws)", select="SELECT nid AS id, CAST(i - 1 AS INTEGER) AS row_no, CASE WHEN i = 1 AND len(w) > 0 THEN nid ELSE '' END AS c0, CASE WHEN i = 1 AND len(w) > 0 THEN text ELSE '' END AS c1, CASE WHEN i <= len(w) THEN w[i] ELSE '' END AS c2 FROM (SELECT *, unnest(range(1, len(w) + 2)) AS i FROM nm)"))(
    lambda s, d: sinks.numbered_sheet(texts(s, d), "sms", "msg_id", "text_orig")
)
_ANN = "ann AS (SELECT post_id * 1000 + pos AS row_no, ori AS anom, CASE WHEN pos % 4 = 3 THEN '' ELSE tok END AS tok, CASE WHEN pos % 6 = 0 THEN tok || '#' WHEN pos % 6 = 1 THEN '<del>' || tok || '</del>' WHEN pos % 6 = 2 THEN '§' || tok || '§' WHEN pos % 6 = 3 THEN '<trans>' || tok || '</trans>x' WHEN pos % 6 = 4 THEN '<del>' || tok ELSE '' END AS oper, CASE WHEN pos % 5 = 4 THEN '' ELSE tgt END AS norm FROM gtok)"


def annotations(s: SparkSession, d: str) -> DataFrame:
    """Gold tokens as rows of a validation sheet (FX3), with operations made by a fixed rule."""
    g = evaluate.gold_tokens(resources(s, d)["gold"])
    k, tok = F.col("pos") % 6, F.col("tok")
    oper = F.when(k == 0, F.concat(tok, F.lit("#"))).when(k == 1, F.concat(F.lit("<del>"), tok, F.lit("</del>"))).when(k == 2, F.concat(F.lit("§"), tok, F.lit("§"))).when(k == 3, F.concat(F.lit("<trans>"), tok, F.lit("</trans>x"))).when(k == 4, F.concat(F.lit("<del>"), tok)).otherwise("")
    return g.select((F.col("post_id") * 1000 + F.col("pos")).alias("row_no"), F.col("ori").alias("anom"), F.when(F.col("pos") % 4 == 3, "").otherwise(tok).alias("tok"), oper.alias("oper"), F.when(F.col("pos") % 5 == 4, "").otherwise(F.col("tgt")).alias("norm"))


_OPS = "op AS (SELECT row_no, unnest(regexp_extract_all(oper, '<del>.+?</del>|<trans>.+?</trans>|§.+?§|#|[\\s\\S]')) AS x FROM ann), ops AS (SELECT row_no, CASE WHEN regexp_full_match(x, '<del>.+?</del>') THEN 'deletion' WHEN regexp_full_match(x, '<trans>.+?</trans>') THEN 'transposition' WHEN regexp_full_match(x, '§.+?§') THEN 'substitution' WHEN x = '#' THEN 'insertion' ELSE 'normal' END AS type, regexp_replace(x, '^(?:<del>|<trans>|§)(.+?)(?:</del>|</trans>|§)$', '\\1') AS text FROM op)"
query("S9_completed", _with(_GTOK, _ANN, select="SELECT row_no, CASE WHEN tok = '' THEN anom ELSE tok END AS tok FROM ann"))(lambda s, d: readers.completed(annotations(s, d)).select("row_no", "tok"))
query("G2_parse_operations", _with(_GTOK, _ANN, _OPS, select="SELECT row_no, type, text, count(*) AS n FROM ops GROUP BY 1, 2, 3"))(
    lambda s, d: annotations(s, d).select("row_no", F.explode(gold.parsed(F.col("oper"))).alias("o")).groupBy("row_no", "o.type", "o.text").agg(F.count(F.lit(1)).alias("n"))
)
query("G3_no_operations", _with(_GTOK, _ANN, select="SELECT row_no, CASE WHEN oper = '' AND norm <> '' AND lower(norm) <> lower(anom) AND lower(regexp_replace(norm, '\\[.*?\\]', '', 'g')) <> lower(anom) THEN 'NoOperations' END AS error FROM ann"))(
    lambda s, d: annotations(s, d).select("row_no", gold.no_operations_error(F.col("anom"), F.col("oper"), F.col("norm")).alias("error"))
)
_cnt = lambda tag: f"len(regexp_extract_all(oper, '{tag}'))"
query("G4_del_tags", _with(_GTOK, _ANN, select=f"SELECT row_no, CASE WHEN {_cnt('<del>')} <> {_cnt('</del>')} THEN 'DelTag' END AS error FROM ann"))(lambda s, d: annotations(s, d).select("row_no", gold.del_tag_error(F.col("oper")).alias("error")))
query("G5_trans_tags", _with(_GTOK, _ANN, select=f"SELECT row_no, CASE WHEN {_cnt('<trans>')} <> {_cnt('</trans>')} THEN 'TransTag' END AS error FROM ann"))(lambda s, d: annotations(s, d).select("row_no", gold.trans_tag_error(F.col("oper")).alias("error")))
_BARE = "lower(replace(regexp_replace(oper, '</?del>|</?trans>|§|#', '', 'g'), ' ', ''))"
query("G6_tok_correspondence", _with(_GTOK, _ANN, select=f"SELECT row_no, CASE WHEN {_BARE} <> lower(replace(tok, ' ', '')) THEN 'TokCorrespondence' END AS error FROM ann"))(lambda s, d: annotations(s, d).select("row_no", gold.tok_error(F.col("tok"), F.col("oper")).alias("error")))
query(
    "G7_validated",
    _with(
        _GTOK,
        _ANN,
        "fi AS (SELECT row_no, CASE WHEN tok = '' THEN anom ELSE tok END AS tok, oper, norm FROM ann)",
        select=f"SELECT row_no, CASE WHEN oper = '' AND norm <> '' AND lower(norm) <> lower(tok) AND lower(regexp_replace(norm, '\\[.*?\\]', '', 'g')) <> lower(tok) THEN 'NoOperations' WHEN oper <> '' AND {_cnt('<del>')} <> {_cnt('</del>')} THEN 'DelTag' WHEN oper <> '' AND {_cnt('<trans>')} <> {_cnt('</trans>')} THEN 'TransTag' WHEN oper <> '' AND {_BARE} <> lower(replace(tok, ' ', '')) THEN 'TokCorrespondence' END AS error_code FROM fi",
    ),
)(lambda s, d: gold.validated(annotations(s, d)).select("row_no", "error_code"))
query("G14_aligned")(lambda s, d: gold.aligned(annotations(s, d)).select("row_no", "error_code", "align_error", F.size("series").alias("n")))
query("K5_operation_rows")(lambda s, d: sinks.operation_rows(gold.aligned(annotations(s, d))))
query("G15_flag_warnings", _with(_GTOK, "fg AS (SELECT post_id * 1000 + pos AS row_no, CASE WHEN pos % 3 = 0 THEN CAST(pos % 4 AS VARCHAR) WHEN pos % 3 = 1 THEN 'x' ELSE 'y,1' END AS flag, tgt AS n FROM gtok)", select="SELECT row_no, flag, warning FROM (SELECT *, CASE WHEN flag = 'x' THEN NULL WHEN flag = 'y,1' THEN 'unexpected flag' WHEN CAST(flag AS INTEGER) < 1 OR CAST(flag AS INTEGER) > len(string_split(n, ' ')) THEN 'flag index out of range' END AS warning FROM fg) WHERE warning IS NOT NULL"))(
    lambda s, d: gold.flag_warnings(evaluate.gold_tokens(resources(s, d)["gold"]).select((F.col("post_id") * 1000 + F.col("pos")).alias("row_no"), F.col("ori").alias("anom"), "tok", F.col("tgt").alias("norm"), F.when(F.col("pos") % 3 == 0, (F.col("pos") % 4).cast("string")).when(F.col("pos") % 3 == 1, "x").otherwise("y,1").alias("flag")))
)
_HIST = "hi AS (SELECT 'tok' AS measure, length(tok) AS length FROM gtok UNION ALL SELECT 'norm', length(tgt) FROM gtok UNION ALL SELECT 'difference', length(tgt) - length(tok) FROM gtok), hs AS (SELECT measure, CAST(length AS INTEGER) AS length, count(*) AS n FROM hi GROUP BY 1, 2)"
_hist = lambda s, d: gold.length_histograms(evaluate.gold_tokens(resources(s, d)["gold"]).select("tok", F.col("tgt").alias("norm")))
query("G16_length_histograms", _with(_GTOK, _HIST, select="SELECT * FROM hs"))(_hist)
query("G17_average_lengths", _with(_GTOK, _HIST, select="SELECT measure, round(sum(length * n) / CAST(sum(n) AS DOUBLE), 6) AS mean FROM hs GROUP BY measure"))(lambda s, d: gold.average_lengths(_hist(s, d)))
query("G18_operation_counts", _with(_GTOK, _ANN, _OPS, select="SELECT type, count(*) AS n FROM ops GROUP BY type"))(lambda s, d: gold.operation_counts(annotations(s, d)))
