"""Exact duplicates by progressive refinement.

Texts are equal when they are identical after A-Z are made small.  First the
rows are grouped by the length of the text, then those of a length that occurs
again by a hash of the first ``PREFIX`` characters, and only texts of a (length,
prefix) pair that occurs again are read to the end and hashed (SHA-256).
Lengths and prefix hashes are written once as a narrow table; the text itself
never moves: what survives a round is told by a bitmap of a fixed size, and
what a shared bit lets through wrongly falls out in the next round, the last
of which is exact.

Equal rows are counted before every shuffle, so a group of copies reaches it
as a row for each task.  A group's size goes back to its rows by a join
that Spark splits where one group is hot.

DataFrame functions only.  Defined results: a null text is an empty one.  Of
equal texts the row with the largest doc_id stays, a null id only where
all are null; of several rows with that id and text one stays, and as all they
have in common is in the result, any of them is meant.  An empty table gives no
rows.  Texts of any length are hashed whole.  Columns of the table besides
doc_id and text are not touched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions.ordering import expand_copies
from llm.common import LOWER, UPPER, is_small, stage
from llm.sieve import marked, sieve

#: Characters of the prefix hash.
PREFIX = 64
#: Bits of the bitmaps (2 MB).
BITS = 24


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _small(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _again(rows: DataFrame, *keys: str) -> DataFrame:
    """Sieve of the keys that more than one row has."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("rows_of_key")).where("rows_of_key > 1")
    return sieve(many.select(F.xxhash64(*keys).alias("key")), BITS)


def _hashed(rows: DataFrame, all_digests: bool) -> DataFrame:
    """``rows`` (doc_id, text, ...) with size, prefix, survives and digest (null where nothing asks for it)."""
    size, prefix = F.octet_length(_text()).alias("size"), F.xxhash64(_small(F.substring(_text(), 1, PREFIX))).alias("prefix")
    narrow = stage(rows.select(size, prefix), "lengths")
    same_length = marked(narrow, F.xxhash64("size"), _again(narrow, "size"), BITS, "again").where("again")
    found = marked(rows.withColumns({"size": size, "prefix": prefix}), F.xxhash64("size", "prefix"), _again(same_length, "size", "prefix"), BITS, "survives")
    digest = F.unhex(F.sha2(_small(_text()), 256))
    return found.withColumn("digest", digest if all_digests else F.when(F.col("survives"), digest))


def _groups(hashed: DataFrame) -> DataFrame:
    """(digest, group_size, keep_id, keep_copies) of texts that more than one row has."""
    rows = hashed.where("survives").groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    groups = rows.groupBy("digest").agg(F.sum("copies").alias("group_size"), F.max(F.struct("doc_id", "copies")).alias("last"))
    return groups.where("group_size > 1").select("digest", "group_size", F.col("last.doc_id").alias("keep_id"), F.col("last.copies").alias("keep_copies"))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def exact_duplicates(docs: DataFrame, all_digests: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The digest is there for texts that were read to the end; with
    ``all_digests`` all are, in the same scan.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = stage(_hashed(rows, all_digests).select("doc_id", "survives", "digest"), "digests")
    groups = stage(_groups(hashed), "groups")
    joined = hashed.join(_sized(groups), "digest", "left")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    alone = F.isnull("group_size")
    once = joined.where(alone | ~stays | (F.col("keep_copies") == 1)).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | stays).alias("kept"),
        "digest",
    )
    # rows with the id and text of the one that stays are alike: one of them is kept
    alike = groups.where("keep_copies > 1").withColumnRenamed("keep_copies", "copies")
    alike = expand_copies(alike, "copies", "ordinal").select(
        F.col("keep_id").alias("doc_id"), "keep_id", "group_size", (F.col("ordinal") == 0).alias("kept"), "digest"
    )
    return once.unionByName(alike).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows with one id and text but different other columns the one whose
    hash over all columns is smallest stays.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = _hashed(rows, all_digests=False)
    groups = stage(_groups(hashed.select("doc_id", "survives", "digest")), "groups")
    joined = hashed.select("row", "doc_id", "digest").join(_sized(groups), "digest", "left")
    stays = joined.where(F.isnull("group_size") | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    once = stays.where(F.isnull("group_size") | (F.col("keep_copies") == 1)).select("row")
    alike = stays.where("keep_copies > 1").groupBy("digest").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return once.unionByName(alike).select("row.*")
