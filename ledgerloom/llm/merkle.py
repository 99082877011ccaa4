"""Merkle manifest of a dataset: a tree of digests per group, one over the groups, and a proof for each row, by lag and lead windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hint_small, lower_ascii, materialize

#: Children of a node, and runs of children that a window sorts at once.
FAN, RUNS = 16, 16
#: The bits of ``monotonically_increasing_id`` that count within a partition.
ROW_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path, from the leaf's to the root's children, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _depth(n: Column) -> Column:
    """Levels above ``n`` leaves: powers of the fan, 1 included, that are below ``n``."""
    return reduce(lambda a, b: a + b, ((n > F.lit(FAN**k)).cast("int") for k in range(15)))


def _siblings(w, kept: Column) -> tuple[Column, Column]:
    """Digests of a run before and after each node: lags and leads at fixed offsets, where its slot and the run's length reach."""
    slot = F.col("pos") % FAN
    length = F.least(F.lit(FAN), F.col("n") - (F.col("pos") - slot))
    before = [F.when(kept & (slot >= k), F.lag("hash", k).over(w)) for k in range(FAN - 1, 0, -1)]
    after = [F.when(kept & (slot + k < length), F.lead("hash", k).over(w)) for k in range(1, FAN)]
    return F.concat_ws("", *before), F.concat_ws("", *after)


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level: each first child hashes itself and what follows in its run."""
    w = Window.partitionBy("tree", F.floor(F.col("pos") / (FAN * RUNS))).orderBy("pos")
    family = nodes.select("tree", "pos", "n", "hash", _siblings(w, F.lit(True))[1].alias("after"))
    up = [F.expr(f"pos DIV {FAN}").alias("pos"), F.expr(f"(n + {FAN - 1}) DIV {FAN}").alias("n"), digest(F.col("hash"), F.col("after")).alias("hash")]
    return family.where(F.col("pos") % FAN == 0).select("tree", *up)


def _levels(leaves: DataFrame, most: int, tag: str) -> list[DataFrame]:
    """tree, pos, n and hash of the nodes of all trees by level, while one of them has more than one node; ``most`` is the largest tree."""
    out = [leaves]
    while most > 1:
        out.append(materialize(_parents(out[-1].select("tree", "pos", "n", "hash").where("n > 1")), f"merkle-{tag}-{len(out)}"))
        most = -(-most // FAN)
    return out


def _with_paths(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """``levels[0]`` with ``above``: of its node in ``roots`` (tree, depth, above) for a lone leaf, else that with all siblings on the way.

    From the roots down: the node above a run goes in front of it as slot -1, so that each child finds it, and its own siblings, in
    one window.
    """
    at_root = {depth: roots.where(F.col("depth") == depth) for depth in range(len(levels))}
    above = at_root[len(levels) - 1].select("tree", F.lit(0).cast("bigint").alias("pos"), "above")
    extra = [c for c in levels[0].columns if c not in ("tree", "pos", "n", "hash")]
    for level in range(len(levels) - 2, -1, -1):
        own = extra if level == 0 else []
        children = levels[level].where("n > 1").select("tree", F.expr(f"pos DIV {FAN}").alias("run"), (F.col("pos") % FAN).alias("slot"), "pos", "n", "hash", *own)
        heads = above.select("tree", F.col("pos").alias("run"), F.lit(-1).cast("bigint").alias("slot"), "above")
        both = children.unionByName(heads, allowMissingColumns=True)
        w = Window.partitionBy("tree", F.floor(F.col("run") / RUNS)).orderBy("run", "slot")
        before, after = _siblings(w, F.col("slot") >= 0)
        held = F.last("above", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = both.select("tree", "slot", "pos", "n", "hash", *own, before.alias("before"), after.alias("after"), held.alias("held")).where("slot >= 0")
        step = F.array(F.struct("before", "after"))
        lower = F.struct(F.concat(step, F.col("held.path")).alias("path"), F.col("held.subroot").alias("subroot"))
        above = found.select("tree", "pos", "n", "hash", *own, lower.alias("above"))
        if level:
            above = above.select("tree", "pos", "above").unionByName(at_root[level].select("tree", F.lit(0).cast("bigint").alias("pos"), "above"))
    lone = levels[0].where("n = 1").join(at_root[0].select("tree", "above"), "tree")
    return lone.unionByName(above) if len(levels) > 1 else lone


@dataclass
class Manifest:
    """Levels of the groups' trees, from the rows' leaves up, and of the tree over the groups, whose leaves are their roots."""

    groups: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    def nodes(self) -> DataFrame:
        """The table to store: tree (the group's number by order of its value, null first; -1 is the tree over the groups), level, pos, hash."""
        parts = [t.select("tree", F.lit(i).alias("level"), "pos", "hash") for tables in (self.levels, self.top) for i, t in enumerate(tables)]
        return reduce(DataFrame.unionByName, parts)

    def proofs(self) -> DataFrame:
        """The rows' columns with leaf, subroot, root and path: before and after, the siblings left and right of each node on the way, joined."""
        none = F.expr("CAST(array() AS array<struct<before: string, after: string>>)")
        start = F.struct(none.alias("path"), F.lit(self.root).cast("string").alias("subroot"))
        over = _with_paths(self.top, self.top[-1].select("tree", F.lit(len(self.top) - 1).alias("depth"), start.alias("above")))
        roots = over.select(F.col("pos").alias("tree"), F.struct(F.col("above.path").alias("path"), F.col("hash").alias("subroot")).alias("above"))
        roots = roots.join(self.groups.select("tree", _depth(F.col("n")).alias("depth")), "tree")
        rows = _with_paths(self.levels, roots)
        return rows.select(*(c for c in rows.columns if c not in ("tree", "pos", "n", "hash", "above")), F.col("hash").alias("leaf"), "above.subroot", F.lit(self.root).cast("string").alias("root"), "above.path")


def manifest(rows: DataFrame, leaf: Column, group_col: str, id_col: str, carry: Sequence[Column] = ()) -> Manifest:
    """The trees over ``rows``: per value of ``group_col`` its leaves ascend by ``id_col``, null first; ``carry`` goes along with each leaf.

    Rows of one id are in order of their leaves, so that repeats and ties have one result. Empty input has no trees and root null.

    Only digests and ids are dealt and sorted, by ranges of their order and not by group, so a group of any size is spread over
    tasks. Every 16 nodes make one of the next level, whose windows hold 256 nodes and end within a run's border.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col(group_col).alias("_group"), F.col(id_col).alias("_id"), leaf.alias("hash"), *carry, F.monotonically_increasing_id().alias("_row"))
    order = ["_group", "_id", "hash", "_row"]
    # Written first: a task that is run again must not count rows anew while others hold the old numbers.
    dealt = materialize(plain, "merkle-rows").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    placed = materialize(dealt.sortWithinPartitions(*order).drop("_row").withColumn("_at", F.monotonically_increasing_id()), "merkle-placed")
    # A row per group and range that it reaches into: first place there, rows there.
    range_of = F.shiftright("_at", ROW_BITS)
    pieces = materialize(placed.groupBy("_group", range_of.alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")), "merkle-pieces")
    sizes = pieces.groupBy("_group").agg(F.sum("_rows").alias("n"))
    # Groups are numbered as the ranges come; of those that begin in one range, by value.
    begin = pieces.groupBy("_group").agg(F.min("_first").alias("_begin"))
    per_range = begin.groupBy(F.shiftright("_begin", ROW_BITS).alias("_range")).agg(F.count("*").alias("_groups"))
    earlier = F.coalesce(F.sum("_groups").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_begin")) - 1
    groups = begin.withColumn("_range", F.shiftright("_begin", ROW_BITS)).join(per_range.select("_range", earlier.alias("_earlier")), "_range")
    groups = groups.select("_group", (F.col("_earlier") + within).cast("bigint").alias("tree")).join(sizes.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
    groups = materialize(groups, "merkle-groups")
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.select(F.col("_group").alias("_g"), "_range", (F.col("_first") - before).alias("_zero"))
    starts = starts.join(groups, F.col("_g").eqNullSafe(F.col("_group"))).select("_g", F.col("_range").alias("_r"), "_zero", "tree", "n")
    starts = hint_small(materialize(starts, "merkle-starts"), 64, *(["_g"] if dict(plain.dtypes)["_group"] == "string" else []))
    here = F.col("_group").eqNullSafe(F.col("_g")) & (range_of == F.col("_r"))
    extra = [c for c in plain.columns if c not in order]
    leaves = placed.join(starts, here).select("tree", (F.col("_at") - F.col("_zero")).alias("pos"), "n", "hash", F.col("_id").alias(id_col), *extra)
    leaves = materialize(leaves, "merkle-leaves")
    count, most = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    levels = _levels(leaves, most, "group")
    subroots = reduce(DataFrame.unionByName, (t.where("n = 1").select("tree", "hash") for t in levels))
    over = subroots.select(F.lit(-1).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("bigint").alias("n"), "hash")
    top = _levels(materialize(over, "merkle-top"), count, "top")
    found = top[-1].first()
    return Manifest(groups.select("tree", F.col("_group").alias(group_col), "n"), levels, top, found["hash"] if found else None)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of each document, and whether its leaf as (perhaps) tampered with leads to the root.

    Nulls are ``-`` in a leaf; a null source is a source, the first; documents without id come first in theirs and are not tampered
    with. Repeated rows have leaves of their own.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(chosen, digest(*fields, field(lower_ascii(F.col("text")))))
    found = manifest(docs, digest(*fields, field(F.col("text"))), "source", "doc_id", [tampered.alias("tampered")]).proofs()
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("path"), F.coalesce("tampered", "leaf")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6) -> str:
    """The same in SQL, for trees of up to 16 ** ``levels`` leaves, a table for each level."""

    def text(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    head = " || ".join(text(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""leaf AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS n, sha256({head} || {text('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {text(lower)}) END AS tampered FROM documents)"""
    ]
    for tree, start in (("a", "SELECT g, pos, n, leaf AS h FROM leaf"), ("b", "SELECT 0 AS g, g AS pos, count(*) OVER () AS n, h FROM sub")):
        parts.append(f"{tree}0 AS ({start})")
        for i in range(levels):
            parts.append(f"{tree}{i + 1} AS (SELECT g, pos // 16 AS pos, (max(n) + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {tree}{i} WHERE n > 1 GROUP BY g, pos // 16)")
            run = "OVER (PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN"
            sides = f"coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
            parts.append(f"s{tree}{i} AS (SELECT g, pos, {sides} FROM {tree}{i} WHERE n > 1)")
        if tree == "a":
            parts.append("sub AS (" + " UNION ALL ".join(f"SELECT g, h FROM a{i} WHERE n = 1" for i in range(levels + 1)) + ")")
    parts.append("f0 AS (SELECT *, coalesce(tampered, leaf) AS cur, '' AS proof FROM leaf)")
    for k in range(2 * levels):
        tree, i = ("a", k) if k < levels else ("b", k - levels)
        place = f"s.g = f.g AND s.pos = f.pos // {16**i}" if tree == "a" else f"s.pos = f.g // {16**i}"
        parts.append(f"""f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN s.g IS NULL THEN cur ELSE sha256(l || cur || r) END AS cur, proof || coalesce(l || r, '') AS proof)
  FROM f{k} f LEFT JOIN s{tree}{i} s ON {place})""")
    parts.append("root AS (" + " UNION ALL ".join(f"SELECT h AS root FROM b{i} WHERE n = 1" for i in range(levels + 1)) + ")")
    return f"""WITH {', '.join(parts)}
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM f{2 * levels} f JOIN sub USING (g) CROSS JOIN root"""


OP13_SQL = _sql()
