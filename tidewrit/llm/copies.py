"""Problem 5: records that differ only in white space, case, punctuation or the order of their fields.

A message made of labelled fields (``label: value``, set apart by | or ;) has one field for each, any other message has
one field, its whole text. Field values are dictionary-encoded: each distinct value is canonicalised once, canonical
values get integer identifiers, and records become sorted tuples of identifiers. Only these compact tuples are grouped.

Values are met by two 64-bit hashes of them, so that texts are shuffled once, when distinct values are made. An
identifier is made of two hashes of the canonical value; that no two values share one is verified over the whole
dictionary, not assumed. Values and groups that hold more than a thousandth of all rows are spread over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A key is hot if it holds more than one row in so many; so there are at most as many hot keys, which are broadcast.
HOT = 1000
#: Rows of a hot key are spread over so many salts.
SALTS = 64


def canonical(text: Column) -> Column:
    """Letters, their marks and decimal digits, without case; all else is dropped."""
    folded = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}\\p{Nd}]+", "")
    return F.replace(F.translate(folded, "ς", "σ"), F.lit("ß"), F.lit("ss"))


def field_values(text: Column) -> Column:
    """(labelled, value) of each field of a text."""
    parts = F.filter(F.split(text, "[|;]"), lambda p: p.rlike("[\\p{L}\\p{Nd}]"))
    labelled = text.rlike("[|;]") & (F.size(parts) > 1) & F.forall(parts, lambda p: p.contains(":") & F.substring_index(p, ":", 1).rlike("[\\p{L}\\p{Nd}]"))
    field = lambda flag: lambda v: F.struct(F.lit(flag).alias("labelled"), v.alias("value"))
    return F.when(labelled, F.transform(parts, field(True))).otherwise(F.transform(F.array(text), field(False)))


def two_hashes(*columns: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(7919), *columns), F.xxhash64(F.lit(104729), *columns)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: str) -> DataFrame:
    """Inner join of rows with their keys' entries (``n``: how many rows have the key).

    Entries of hot keys are repeated for each salt; there are at most ``HOT`` of them, which bounds the broadcast.
    """
    total = right.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    hot = right.where(F.col("n") * HOT > total)
    flags = F.broadcast(hot.select(*keys, F.lit(SALTS).alias("salts")))  # at most HOT rows
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(spread_by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    rows = left.join(flags, keys, "left").withColumn("salt", salt).drop("salts")
    repeated = F.when(F.col("n") * HOT > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(right.withColumn("salt", F.explode(repeated)).drop("n"), [*keys, "salt"]).drop("salt")


def dictionary(fields: DataFrame) -> DataFrame:
    """(r1, r2, a, b, check, n): for each distinct field value, by its hashes, the identifier of its canonical value.

    ``n`` is the number of rows that have it. A shared hash of different values fails the query.
    """
    values = fields.groupBy("labelled", "value").agg(F.count(F.lit(1)).alias("n"))
    label, rest = F.substring_index("value", ":", 1), F.regexp_replace("value", "^[^:]*:", "")
    c = F.when(F.col("labelled"), F.concat(canonical(label), F.lit(":"), canonical(rest))).otherwise(canonical(F.col("value")))
    r1, r2 = two_hashes(F.col("labelled"), F.col("value"))
    a, b = two_hashes(F.col("labelled"), F.col("c"))
    check = F.xxhash64(F.lit(15485863), "c")
    return written(values.withColumn("c", c).select(r1.alias("r1"), r2.alias("r2"), a.alias("a"), b.alias("b"), check.alias("check"), "n"))


def verified(entries: DataFrame) -> DataFrame:
    """The dictionary, after a check that identifiers and values belong to each other: no identifier has two values (told
    apart by a third hash), and no two values share their hashes."""
    same = entries.groupBy("a", "b").agg((F.min("check") != F.max("check")).alias("clash")).where("clash").select("a")
    twice = entries.groupBy("r1", "r2").count().where("count > 1").select(F.col("r1").alias("a"))
    if same.unionByName(twice).limit(1).collect():
        raise ValueError("two values share an identifier; change the seeds of two_hashes")
    return entries.select("r1", "r2", F.struct("a", "b").alias("vid"), "n")


def record_tuples(df: DataFrame, id_col: str = "msg_id", text_col: str = "text_orig") -> DataFrame:
    """(rec, key): each record's id and its sorted tuple of value identifiers.

    Records without letter or digit and those without id are dropped. A second delivery may give a second row.
    """
    rows = df.select(F.col(id_col).alias("rec"), F.col(text_col).alias("t")).where("rec is not null and t is not null").where(F.col("t").rlike("[\\p{L}\\p{Nd}]"))
    fields = rows.select("rec", F.xxhash64("t").alias("t"), F.posexplode(field_values(F.col("t"))).alias("pos", "f")).select("rec", "t", "pos", "f.labelled", "f.value")
    entries = verified(dictionary(fields))
    r1, r2 = two_hashes(F.col("labelled"), F.col("value"))
    met = salted_join(fields.select("rec", "t", "pos", "labelled", r1.alias("r1"), r2.alias("r2")), entries, ["r1", "r2"], "rec")
    plain = met.where("not labelled").select("rec", F.array("vid").alias("key"))
    # A set, since a second delivery has the same fields again.
    tuples = met.where("labelled").groupBy("rec", "t").agg(F.collect_set(F.struct("pos", "vid")).alias("f"))
    return plain.unionByName(tuples.select("rec", F.array_sort(F.transform("f", lambda x: x["vid"])).alias("key")))


def hidden_copies(df: DataFrame, id_col: str = "msg_id", text_col: str = "text_orig") -> DataFrame:
    """(keep_id, copy_id): each set's smallest id with each other id of the set, each pair once.

    The tuples are written to the shared folder, since both sides of the join need them. A second delivery (the same id
    again) is no copy. Null, blank or symbol-only texts are never copies. Empty input gives an empty result.
    """
    k1, k2 = two_hashes(F.col("key"))
    keys = written(record_tuples(df, id_col, text_col).select("rec", "key", k1.alias("k1"), k2.alias("k2")))
    groups = keys.groupBy("k1", "k2", "key").agg(F.min("rec").alias("keep_id"), F.max("rec").alias("most"), F.count(F.lit(1)).alias("n")).where("most <> keep_id").drop("most")
    members = salted_join(keys, groups, ["k1", "k2", "key"], "rec")
    return members.where("rec <> keep_id").select("keep_id", F.col("rec").alias("copy_id")).distinct()


def collapsed(df: DataFrame, id_col: str = "msg_id", text_col: str = "text_orig") -> DataFrame:
    """(keep_id, n_copies): one row per record with text, with the number of distinct ids that carry it.

    Deliveries of one id are counted once: ids are made distinct per key first, which spreads a hot group over its ids.
    """
    keys = record_tuples(df, id_col, text_col).distinct()
    return keys.groupBy("key").agg(F.min("rec").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")).select("keep_id", "n_copies")
