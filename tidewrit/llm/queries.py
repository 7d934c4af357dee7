"""The queries of this subpackage: name -> function of (spark, sf_dir)."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import abuse, copies, language, leaks, lookalikes, mojibake, pii, sentences, subjects, tokens
from .common import messages, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = table(spark, sf_dir, "messages")
    asked = table(spark, sf_dir, "seg_sample").select("msg_id").distinct()
    chosen = msgs.select("msg_id", "text_orig", "text_prepro").join(asked, "msg_id", "left_semi").dropDuplicates(["msg_id"])
    return sentences.sentence_spans(sentences.fields(chosen), sentences.fitted(msgs), "msg_id, field")


def p1_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = table(spark, sf_dir, "messages")
    return sentences.sentence_spans(sentences.fields(messages(spark, sf_dir, "text_orig", "text_prepro")), sentences.fitted(msgs), "msg_id, field")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(table(spark, sf_dir, "messages"), table(spark, sf_dir, "lexicon"), table(spark, sf_dir, "gazetteer"))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(table(spark, sf_dir, "messages"), table(spark, sf_dir, "lexicon"), table(spark, sf_dir, "gazetteer"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(mojibake.records(table(spark, sf_dir, "messages"), table(spark, sf_dir, "csv_sent")))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored(mojibake.records(table(spark, sf_dir, "messages"), table(spark, sf_dir, "csv_sent")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = lookalikes.gold_records(table(spark, sf_dir, "messages"), table(spark, sf_dir, "csv_sent"))
    return lookalikes.found(recs, table(spark, sf_dir, "lexicon"), table(spark, sf_dir, "gazetteer"))


def p6_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = lookalikes.gold_records(table(spark, sf_dir, "messages"), table(spark, sf_dir, "csv_sent"))
    return lookalikes.normalized(recs, table(spark, sf_dir, "lexicon"), table(spark, sf_dir, "gazetteer")).where("affected").select("field", "rec_id", "text", "fixed")


def pseudonym_key(spark: SparkSession) -> bytes:
    """The secret of the pseudonyms, from ``spark.tidewrit.pseudonym.key``; a new one for this query if none is set."""
    given = spark.conf.get("spark.tidewrit.pseudonym.key", None)
    return given.encode()[:64] if given else secrets.token_bytes(32)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pieces(table(spark, sf_dir, "messages"), table(spark, sf_dir, "gazetteer"))


def p4_anonymized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymized(table(spark, sf_dir, "messages"), table(spark, sf_dir, "gazetteer"), pseudonym_key(spark))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.hidden_copies(table(spark, sf_dir, "messages"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapsed(table(spark, sf_dir, "messages"))


def _abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scored(*(table(spark, sf_dir, t) for t in ("messages", "msg_label", "abuse_term", "lexicon", "gazetteer")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found(_abuse(spark, sf_dir))


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir).select("msg_id", "score", "category", "spans").dropDuplicates(["msg_id"])


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_abuse(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_shares(*(table(spark, sf_dir, t) for t in ("documents", "doc_label", "subject_area", "benchmark")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.found(_shares(spark, sf_dir))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shares(spark, sf_dir).select("doc_id", F.explode("s").alias("s"))
    return s.select("doc_id", "s.subject", "s.share", "s.confidence").where("share > 0").dropDuplicates(["doc_id", "subject"])


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(_shares(spark, sf_dir), table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("p") and name[1:2].isdigit()}


_CANON = "replace(replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+', '', 'g'), 'ς', 'σ'), 'ß', 'ss')"
_PARTS = "list_filter(regexp_split_to_array(t, '[|;]'), lambda p: regexp_matches(p, '[\\p{L}\\p{Nd}]'))"
_KEYS = f"""WITH m AS (SELECT DISTINCT msg_id, text_orig AS t FROM messages WHERE text_orig IS NOT NULL AND msg_id IS NOT NULL AND regexp_matches(text_orig, '[\\p{{L}}\\p{{Nd}}]')),
s AS (SELECT msg_id, t, {_PARTS} AS parts FROM m),
k AS (SELECT msg_id, CASE WHEN regexp_matches(t, '[|;]') AND len(parts) > 1 AND list_bool_and(list_transform(parts, lambda p: regexp_matches(p, '^[^:]*[\\p{{L}}\\p{{Nd}}][^:]*:')))
  THEN '|' || array_to_string(list_sort(list_transform(parts, lambda p: {_CANON.format("split_part(p, ':', 1)")} || ':' || {_CANON.format("regexp_replace(p, '^[^:]*:', '')")})), '|')
  ELSE {_CANON.format("t")} END AS key FROM s),
g AS (SELECT key, min(msg_id) AS keep_id, count(DISTINCT msg_id) AS n_copies FROM k GROUP BY key)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against brute force, round trips or held-out labels."""
    return {
        "p5_found": _KEYS + "SELECT DISTINCT keep_id, k.msg_id AS copy_id FROM k JOIN g USING (key) WHERE k.msg_id <> keep_id",
        "p5_counts": _KEYS + "SELECT keep_id, n_copies FROM g",
    }
