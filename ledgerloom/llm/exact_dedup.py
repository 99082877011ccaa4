"""Exact duplicates by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, hint_small, lower_ascii, materialize, unused

PREFIX_CHARS = 256
KEY = ["_len", "_prefix", "_full"]


def _refined(docs: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    """``docs`` with _len, _prefix and _full; _full is null for rows that length or prefix hash shows to be alone.

    Each pass reads only what it needs: lengths are those of the texts as they are, for lower case keeps them; prefixes are cut
    before they are lower-cased; whole texts are lower-cased and hashed only where a prefix recurs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    shaped = docs.withColumn("_len", F.octet_length(text).cast("long"))
    lengths = materialize(shaped.groupBy("_len").count().where("count > 1").select("_len", F.lit(True).alias("_same_len")), "dedup-lengths")
    prefix = F.xxhash64(F.translate(F.substring(text, 1, prefix_chars), UPPER, UPPER.lower()))
    prefixed = shaped.join(hint_small(lengths, 16), "_len", "left").withColumn("_prefix", F.when(F.col("_same_len"), prefix))
    prefixes = materialize(
        prefixed.where("_same_len").groupBy("_len", "_prefix").count().where("count > 1").select("_len", "_prefix", F.lit(True).alias("_same_prefix")),
        "dedup-prefixes",
    )
    full = F.when(F.col("_same_prefix"), F.sha2(lower_ascii(text), 256))
    return prefixed.join(hint_small(prefixes, 32), ["_len", "_prefix"], "left").withColumn("_full", full)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, and with ``digest`` text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty, so null and empty texts form one group.
    Of a group the row with the largest id stays; null ids lose to all others. If that id occurs more than once in the group
    (repeated rows), exactly one of its rows is marked kept. A group of null ids only has keep_id null and one kept row.
    Empty input gives no rows. Other columns are neither read nor returned.

    Groups are formed by length, then by hash of a prefix, then by SHA-256 of the whole text, each step only for rows which
    the one before could not tell apart. Rows of known singletons take no part in the last grouping's comparison of texts.
    """
    # The digest of a text that is not alone is its full hash; only the others are hashed for it.
    digests = [F.coalesce("_full", F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256)).alias("text_sha256")] if digest else []
    out = ["doc_id", "keep_id", "group_size", "kept", *(["text_sha256"] if digest else [])]
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Rows are numbered as they are written, so that of rows that tie on the id one number wins.
    numbered = _refined(plain, "text", prefix_chars).select("doc_id", *KEY, *digests, F.monotonically_increasing_id().alias("_row"))
    refined = materialize(numbered, "dedup-rows")
    shared = refined.where(F.col("_full").isNotNull())
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "_row"))
    groups = shared.groupBy(KEY).agg(best.alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = groups.select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best._row").alias("_keep"), "group_size")
    # A group's row goes to its members, broadcast if all groups' rows are measured small; else both sides are shuffled, and a
    # group that is too large for a task is split by Spark at run time, for its other side has one row.
    judged = refined.join(hint_small(materialize(groups, "dedup-groups"), 120), KEY, "left")
    judged = judged.withColumn("kept", F.coalesce(F.col("_row") == F.col("_keep"), F.lit(True)))
    judged = judged.withColumn("keep_id", F.when(F.col("_keep").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    return judged.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long"))).select(out)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns unchanged; the rules are those of ``exact_duplicates``.

    The winners of groups of two or more go to the rows: broadcast if counted small, so that no text is shuffled; beyond that (about
    a million recurring prefixes, or 280,000 groups) the join shuffles the rows. Rows that tie with their winner on the id are
    brought together to leave one. Columns may have any names, those that begin with an underscore too.
    """
    # Columns that begin with an underscore, id and text too, go by other names meanwhile, as the work's own names begin so.
    clash = {c: unused(docs.columns, f"own{i}") for i, c in enumerate(docs.columns) if c.startswith("_")}
    renamed = docs.withColumnsRenamed(clash) if clash else docs
    id_col, text_col = clash.get(id_col, id_col), clash.get(text_col, text_col)
    refined = _refined(renamed, text_col, prefix_chars)
    per_id = refined.where(F.col("_full").isNotNull()).groupBy(*KEY, F.col(id_col).alias("_id")).agg(F.count("*").alias("_rows"))
    best = F.max(F.struct(F.col("_id").isNotNull().alias("has"), F.col("_id"), F.col("_rows")))
    groups = materialize(
        per_id.groupBy(KEY).agg(best.alias("_best")).select(*KEY, F.col("_best._id").alias("_keep"), (F.col("_best._rows") > 1).alias("_tie")),
        "dedup-winners",
    )
    judged = refined.join(hint_small(groups, 120), KEY, "left")
    own = [F.col(c) for c in renamed.columns]
    winner = F.col("_full").isNull() | F.col(id_col).eqNullSafe(F.col("_keep"))
    single = judged.where(winner & ~F.coalesce(F.col("_tie"), F.lit(False))).select(own)
    tied = judged.where(winner & F.coalesce(F.col("_tie"), F.lit(False))).dropDuplicates(KEY).select(own)
    kept = single.unionByName(tied)
    return kept.withColumnsRenamed({v: k for k, v in clash.items()}) if clash else kept


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group, and the row of it that stays, for each document, dropped ones too. Null texts are empty texts; ties are as in ``exact_duplicates``."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


OP7_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
