"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside the groups.

Normalising and hashing are built-in functions.  Rows are first grouped by hash alone, in narrow rows.  Then the texts of hashes with two
rows or more are grouped by (hash, text), which compares them byte by byte, in a map-side combining aggregate, so that a hot group shrinks to a
row per map task before the shuffle and a collision of hashes makes two groups.  These texts are found by a cheaper hash, of the whole text in
lower case, which equal texts share, where such hashes are few enough to be sent to every task (``BROADCAST_ROWS``; they are counted
first); beyond it all texts are grouped.

Defined results: a null text counts as empty; rows that repeat an id with an equal text are one document of the output and
each counts in ``group_size``; ids may be null (a group of null ids only keeps one of them); extra columns are ignored by
``groups`` and kept by ``keep_one``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, few, free_names

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z become a-z; other characters stay; null is empty.  Where all characters are ASCII, lower case is the same and sooner done."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _low(text: Column) -> Column:
    """A cheap hash that equal texts share."""
    return F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))


def groups(documents: DataFrame, keep: str = "smallest", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_rows, low of every document, dropped ones too."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"), _low(F.col("text")).alias("low"))
    narrow = rows.select("doc_id", hash_of(F.col("t")).alias("h"), F.sha2("t", 256).alias("text_sha256"), "low")
    keys = cut(narrow.groupBy("h", "doc_id", "text_sha256", "low").agg(F.count("*").alias("n_rows")))
    sizes = cut(keys.groupBy("h").agg(F.sum("n_rows").alias("group_size"), best("doc_id").alias("keep_id"), F.min("low").alias("low"), F.max("low").alias("low2")))

    hashed = lambda df: df.select("doc_id", hash_of(F.col("t")).alias("h"), "t")
    shared = few(sizes.where("group_size > 1").select(F.explode(F.array("low", "low2")).alias("k")).distinct())
    # a false match costs a comparison, no more; of texts that collide two at least meet here
    some = rows if shared is None else rows.join(shared, F.col("low") == F.col("k"), "left_semi")
    collided = cut(hashed(some).groupBy("h", "t").agg(F.lit(1)).groupBy("h").count().where("count > 1").select("h"))
    if collided.isEmpty():
        out = keys.join(sizes.drop("low", "low2"), "h")
    else:  # the texts of a hash differ, so their SHA-256 tells them apart once each has been compared
        clash = hashed(rows).join(collided, "h").groupBy("h", "t").agg(F.count("*").alias("group_size"), best("doc_id").alias("keep_id"))
        clash = clash.select("h", F.sha2("t", 256).alias("text_sha256"), "group_size", "keep_id")
        alone = keys.join(collided, "h", "left_anti").join(sizes.drop("low", "low2"), "h")
        out = alone.unionByName(keys.join(collided, "h", "left_semi").join(clash, ["h", "text_sha256"]))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_rows", "low")


def keep_one(documents: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows, with all their columns, that stay: one of each group of equal texts.

    Few rows go, so those that go are looked for, by id and the cheaper hash first: whole texts move only where they are too many for every
    task to know.
    """
    found_id, found_low, found, own_id, own_low, met = free_names(documents, "found_id", "found_low", "found", "own_id", "own_low", "met")
    listed = groups(documents, keep).where("NOT kept OR n_rows > 1").groupBy(F.col("doc_id").alias(found_id), F.col("low").alias(found_low))
    listed = cut(listed.agg(F.collect_list(F.struct(F.unhex("text_sha256").alias("sha"), "kept")).alias(found)))  # texts of an id that differ in case alone
    rows = documents.withColumns({own_id: F.col("doc_id").cast("long"), own_low: _low(F.col("text"))})
    joined = rows.join(few(listed) or listed, F.col(own_id).eqNullSafe(F.col(found_id)) & (F.col(own_low) == F.col(found_low)), "left")
    sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
    # null: a row that stays; false: one that goes; true: one of several that are the same document
    joined = joined.withColumn(met, F.when(F.col(found).isNotNull(), F.get(F.filter(found, lambda x: x["sha"] == sha), F.lit(0))["kept"]))
    once = joined.where(F.col(met).isNull())
    if listed.where(F.exists(found, lambda x: x["kept"])).isEmpty():
        return once.select(*documents.columns)
    repeated = joined.where(F.col(met)).withColumn(own_low, sha).dropDuplicates([own_id, own_low])
    return once.select(*documents.columns).unionByName(repeated.select(*documents.columns))
