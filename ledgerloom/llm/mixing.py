"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hint_small, materialize, unused

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Words that each source is to give.

    ``sizes`` has one row per source: source, source_size. Sources by code point (null last) get ``weights`` in turn and
    share ``share`` times all words by weight. No target exceeds ``cap`` times its source's size; what is cut off goes to
    the others by weight until none is above. That end state is a water level: sources are capped in order of cap / weight
    for as long as the level that the rest would get is at or above their cap. Needs ``share <= cap``.
    A source without words gets 0. Returns source, source_size, weight, target. One task ranks all sources, a row each; a
    million of them are a few dozen MB.
    """
    if share > cap:
        raise ValueError("share must not exceed cap")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("_n", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") - 1) % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_w", F.sum("weight").over(everything))
    )
    before = Window.orderBy(F.col("_cap") / F.col("weight"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_w_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_capped", (F.col("_all") - F.col("_cap_before")) * F.col("weight") >= F.col("_cap") * (F.col("_w") - F.col("_w_before")))
        .withColumn("_cap_sum", F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everything), F.lit(0.0)))
        .withColumn("_w_sum", F.coalesce(F.sum(F.when(F.col("_capped"), F.col("weight"))).over(everything), F.lit(0.0)))
    )
    free = F.col("weight") * (F.col("_all") - F.col("_cap_sum")) / (F.col("_w") - F.col("_w_sum"))
    return level.select("source", "source_size", "weight", F.when(F.col("_capped"), F.col("_cap")).otherwise(free).alias("target"))


def _source_key(column: str):
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n"))


def systematic_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1",
) -> DataFrame:
    """Copies of each document in the mix, by systematic sampling within each source.

    A document's expected copies are target / source size, at most ``cap``. Within a source, documents stand in the order
    (words, keyed md5, id, hash of the text); their expected copies are summed up along it, one random offset per source is added, and a copy
    is emitted for each integer passed. Order by size keeps a source's words within about one document of its target.

    The order is never formed in one task: sizes are counted per source, keyed buckets per size, and rows are numbered only
    within (source, size, bucket), so a source with a third of all rows is spread like any other.

    Null text counts as 0 words; null source is a source of its own, last; null ids share one place in the order. Rows that
    repeat are rows of their own and may differ in copies. Empty input gives no rows. Only the three named columns are read.
    Returns doc_id, source, size, source_size, target, copies, taken and text_hash.
    """
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _source_key(source_col).alias("_s"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("_h"),
            F.xxhash64(text_col).alias("_t"),
        ).withColumn("_b", F.substring("_h", 1, 2)),
        "mix-sized",
    )
    buckets = materialize(sized.groupBy("_s", "source", "size", "_b").agg(F.count("*").alias("_c")), "mix-buckets")
    runs = buckets.groupBy("_s", "source", "size").agg(F.sum("_c").alias("_c"))
    targets = source_targets(runs.groupBy("source").agg(F.sum(F.col("_c") * F.col("size")).alias("source_size")), weights, share, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:offset:"), _source_key("source"))), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    targets = targets.select(
        _source_key("source").alias("_s"), "source_size", "target", offset.alias("_u"),
        F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)).alias("_e"),
    )
    before = Window.partitionBy("_s").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    run_base = runs.select("_s", "size", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_run"))
    before = Window.partitionBy("_s", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.select("_s", "size", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_bucket"))
    bases = bases.join(run_base, ["_s", "size"]).join(hint_small(materialize(targets, "mix-targets"), 64, "_s"), "_s")
    place = F.row_number().over(Window.partitionBy("_s", "size", "_b").orderBy("_h", "doc_id", "_t"))
    rows = sized.withColumn("_i", place).join(bases, ["_s", "size", "_b"]).withColumn("_i", F.col("_i") + F.col("_bucket") + F.col("_run"))
    copies = F.floor(F.col("_u") + F.col("_i") * F.col("_e")) - F.floor(F.col("_u") + (F.col("_i") - 1) * F.col("_e"))
    return rows.withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.col("_t").alias("text_hash")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as ``systematic_copies`` takes it, all columns unchanged.

    Copies are decided per (id, source, text hash); rows that agree in all three have one text and take theirs in any order.
    Nulls, repeats and empty input are as in ``systematic_copies``.
    """
    taken = systematic_copies(docs, id_col, text_col, source_col, **options)
    named = ("_id", "_source", "_t", "_hash", "_copies", "_take", "_least", "_n", "_total")
    _id, _source, _t, _hash, _copies, _take, _least, _n, _total = (unused(docs.columns, c) for c in named)
    taken = materialize(taken.groupBy(F.col("doc_id").alias(_id), F.col("source").alias(_source), F.col("text_hash").alias(_t)).agg(F.min("copies").alias(_least), F.max("copies").alias(_copies), F.count("*").alias(_n), F.sum("copies").alias(_total)), "mix-copies")
    rows = docs.withColumn(_hash, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col(_id)) & F.col(source_col).eqNullSafe(F.col(_source)) & (F.col(_hash) == F.col(_t))
    joined = rows.join(hint_small(taken, 96, _source), same)
    # Copies of rows of one source differ by one at most. Only repeated rows that do differ are numbered, and as many get the more.
    single = joined.where(F.col(_least) == F.col(_copies)).withColumn(_take, F.col(_copies))
    nth = F.row_number().over(Window.partitionBy(_id, _source, _t).orderBy(F.lit(1)))
    more = nth <= F.col(_total) - F.col(_n) * F.col(_least)
    repeated = joined.where(F.col(_least) < F.col(_copies)).withColumn(_take, F.col(_least) + more.cast("long"))
    both = single.unionByName(repeated).where(F.col(_take) > 0)
    return both.withColumn(_take, F.explode(F.array_repeat(F.lit(0), F.col(_take).cast("int")))).select(docs.columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document. Null texts have size 0, null sources are one source; no documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return systematic_copies(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
         coalesce('s' || source, 'n') AS s
  FROM documents),
per AS (SELECT s, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY s, source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM per),
weighed AS (SELECT *, ([3.0, 1.0, 2.0])[(n - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
                   sum(source_size) OVER () * 1.5::DOUBLE AS total FROM ranked),
running AS (SELECT *, sum(w) OVER () AS w_all,
                   coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
            FROM weighed WINDOW b AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, (total - cap_before) * w >= cap * (w_all - w_before) AS capped FROM running),
level AS (SELECT *, coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS cap_sum,
                 coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0) AS w_sum FROM marked),
targets AS (SELECT s, source_size,
                   CASE WHEN capped THEN cap ELSE w * (total - cap_sum) / (w_all - w_sum) END AS target,
                   ('0x' || substr(md5('mix-1:offset:' || s), 1, 5))::INT / 1048576.0::DOUBLE AS u FROM level),
placed AS (SELECT doc_id, size, source_size, target, u,
                  CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS e,
                  row_number() OVER (PARTITION BY s ORDER BY size, h, doc_id) AS i
           FROM sized JOIN targets USING (s)),
counted AS (SELECT *, (floor(u + i * e) - floor(u + (i - 1) * e))::BIGINT AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""
