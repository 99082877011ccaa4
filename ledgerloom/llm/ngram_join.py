"""N-gram Jaccard join: an exact self-join of documents in the metric space of their shingle sets.

Jaccard distance is a metric, so with radius r = 1 - threshold and pivots p and q, a set y that is linked to a set x nearer to p
than to q has ``d(y, p) <= d(x, p) + r <= d(x, q) + r <= d(y, q) + 2r``. The steps, none of which loses a link:

1. Equal sets become one class. A prefix bound drops classes that share too little with any other to have a link.
2. Every shingle has a pivot: the class with the smallest key among those that contain it. A class belongs to the region of a
   pivot if one of its rarest shingles has that pivot. Two linked classes have one of their rarest shingles in common, hence a
   region. A pair with several regions in common is looked at in the one with the smallest pivot.
3. A region with many members gets pivots of its own, and each member the Voronoi cell of its nearest. Members whose distance to
   another cell's pivot is within the window of twice the radius, and within the radius of the distances that the cell's own
   members have, are replicated there, and each cell is a region again, until it is small enough. Of a pair with different cells one is replicated to the other's: to the cell that comes first.
   Cells that pivots don't separate (all members about equally far from each other) are left whole.
4. Members of a region are compared exactly, in blocks of bounded size: each region's members are dealt to parts, and each pair of
   parts meets in a task. A block returns one row for each member, with its number of links and its component in the block,
   never a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, hint_small, materialize, prepare_tasks, unused
from .components import connected_components
from .wordhash import mix, shingle_sets

WORDS = 5
#: A link needs DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Members, and shingles of all of them, of a part of a region; a region of up to twice as many members is one part.
MEMBERS, PART_SHINGLES = 128, 2_000_000
#: Pivots of a region that is split, and how often parts of it are split again at most.
PIVOTS, LEVELS = 16, 4
#: A split is kept if it leaves at most this share of a region's pairs.
WORTH = 0.7
#: Shingles that are multiplied out at once when sets are compared.
COLUMNS = 4096
POSTINGS = 1_500_000
#: Buckets of shingles whose counts of nodes meet in one pack.
PACKED = 2
_SHARED = np.int64(-(1 << 63))
_LOW = np.uint64(0xFFFFFFFF)


def _least(n):
    """The smallest intersection that a set of ``n`` can have with a linked one; also the smallest size of that one."""
    return -(-NUM * n // DEN)


def _sure(n: int) -> int:
    return max(1, n - _least(n))


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    a, b = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(), np.bitwise_xor.reduce(mix(s + np.uint64(0x1234567)))
    pair = mix(np.array([a + np.uint64(len(s)), b], np.uint64)).view(np.int64)
    return int(pair[0] if pair[0] != _SHARED else 0), int(pair[1])


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], WORDS)


def _joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Arrays stored as bytes, one after the other, and their lengths."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, n, a, b of every row: size and fingerprints of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", 2 << 20):
            sets = _sets(batch)
            prints = [_fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([p for p, _ in prints], pa.int64()), pa.array([p for _, p in prints], pa.int64())],
                ["doc_id", "n", "a", "b"],
            )

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, a long, b long")


def _shared_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """node and c: how many of the prefix shingles of a class occur in the prefix of another; may be more, never less.

    A prefix has the shingles with the smallest hashes, twice as many as a linked set may lack. A shingle that recurs within
    a batch is sent once, as known to be shared, however many documents have it.
    """

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in byte_slices(batches, "text", 8 << 20):
            nodes, prefixes = [], []
            for part in byte_slices([batch], "text", 2 << 20):
                for s in _sets(part):
                    if len(s):
                        nodes.append(_fingerprint(s)[0])
                        prefixes.append(s[: len(s) - _least(len(s)) + _sure(len(s))])
            if not nodes:
                continue
            nodes, first = np.unique(np.array(nodes, np.int64), return_index=True)
            prefixes = [prefixes[i] for i in first]
            h = np.concatenate(prefixes)
            own = np.repeat(nodes, [len(p) for p in prefixes])
            order = np.argsort(h)
            h, own = h[order], own[order]
            new = np.append(True, h[1:] != h[:-1])
            again = ~np.append(new[1:], True) | ~new
            known, times = np.unique(own[again], return_counts=True)
            own[again] = _SHARED
            h, own = h[new], own[new]
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cells, own, bucket = (h[order] & _LOW).astype("<u4"), own[order], bucket[order]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(ends))
            turn += 1
            rows = [(int(r), cells[ends[r] : ends[r + 1]].tobytes(), own[ends[r] : ends[r + 1]].tobytes()) for r in used]
            rows.append((-1 - int(nodes[0]) % buckets, times.astype("<u4").tobytes(), known.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["r", "cell", "node"])

    # Counts of a bucket leave it packed by groups of nodes, each of which is added up in one task.
    packs = -(-buckets // PACKED)

    def packed(node: np.ndarray, c: np.ndarray) -> pa.Table:
        pack = node % packs
        order = np.argsort(pack, kind="stable")
        node, c, pack = node[order].astype("<i8"), c[order].astype("<u4"), pack[order]
        ends = np.searchsorted(pack, np.arange(packs + 1))
        used = np.flatnonzero(np.diff(ends))
        cut = lambda a: pa.array([a[ends[i] : ends[i + 1]].tobytes() for i in used], pa.binary())
        return pa.table({"pack": used.astype(np.int64), "node": cut(node), "c": cut(c)})

    def count(table: pa.Table) -> pa.Table:
        cell, _ = _joined(table.column("cell"), "<u4")
        node, _ = _joined(table.column("node"), "<i8")
        if table.column("r")[0].as_py() < 0:
            return packed(node, cell)
        order = np.lexsort((node, cell))
        cell, node = cell[order], node[order]
        fresh = np.append(True, (cell[1:] != cell[:-1]) | (node[1:] != node[:-1]))
        cell, node = cell[fresh], node[fresh]
        start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        size = np.diff(np.append(start, len(cell)))
        shared = np.repeat((size > 1) | (node[start] == _SHARED), size) & (node != _SHARED)
        return packed(*np.unique(node[shared], return_counts=True))

    def add(table: pa.Table) -> pa.Table:
        c, _ = _joined(table.column("c"), "<u4")
        nodes, where = np.unique(_joined(table.column("node"), "<i8")[0], return_inverse=True)
        return pa.table({"node": nodes, "c": np.bincount(where, c).astype(np.int64)})

    sent = docs.select("text").mapInArrow(postings, "r long, cell binary, node binary")
    return sent.groupBy("r").applyInArrow(count, "pack long, node binary, c binary").groupBy("pack").applyInArrow(add, "node long, c long")


def _regions(sets: DataFrame, buckets: int) -> DataFrame:
    """p, x, n: the regions of each class. Shingles are counted over all classes, per batch first; the counts and pivots of
    those that recur go back to the batches that sent them."""

    def forward(table: pa.Table) -> pa.Table:
        h, sizes = _joined(table.column("set"), "<u8")
        own = np.repeat(table.column("x").to_numpy(), sizes)
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        times = np.diff(np.append(start, len(h)))
        h, own = h[start], own[start]
        r = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(r, kind="stable")
        cells, own, times, r = (h[order] & _LOW).astype("<u4"), own[order], times[order].astype("<u4"), r[order]
        ends = np.searchsorted(r, np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(ends))
        cut = lambda a: [a[ends[i] : ends[i + 1]].tobytes() for i in used]
        batch = np.full(len(used), table.column("batch")[0].as_py(), np.int64)
        return pa.table({"r": used, "batch": batch, "cell": pa.array(cut(cells), pa.binary()), "df": pa.array(cut(times), pa.binary()), "pivot": pa.array(cut(own), pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        cell, sizes = _joined(table.column("cell"), "<u4")
        df, _ = _joined(table.column("df"), "<u4")
        pivot, _ = _joined(table.column("pivot"), "<i8")
        cells, where = np.unique(cell, return_inverse=True)
        sums = np.bincount(where, df).astype("<u4")
        least = np.full(len(cells), np.iinfo(np.int64).max)
        np.minimum.at(least, where, pivot)
        out, at = [], 0
        for batch, n in zip(table.column("batch").to_pylist(), sizes.tolist()):
            w = where[at : at + n]
            w, at = w[sums[w] > 1], at + n
            if len(w):
                out.append((batch, cells[w].tobytes(), sums[w].tobytes(), least[w].tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = list(zip(*out)) or [[]] * 4
        made = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["batch", "cell", "df", "pivot"])
        return made.append_column("r", pa.array(np.full(len(made), table.column("r")[0].as_py(), np.int64)))

    def regions(left: pa.Table, right: pa.Table) -> pa.Table:
        cell, sizes = _joined(right.column("cell"), "<u4")
        key = np.repeat(right.column("r").to_numpy(), sizes).astype(np.uint64) << np.uint64(32) | cell
        order = np.argsort(key)
        key, df, pivot = key[order], _joined(right.column("df"), "<u4")[0][order], _joined(right.column("pivot"), "<i8")[0][order]
        ps, xs, ns = [], [], []
        for x, raw in zip(left.column("x").to_pylist(), left.column("set").to_pylist()) if len(key) else ():
            h = np.frombuffer(raw, "<u8")
            own = ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | h & _LOW
            at = np.minimum(np.searchsorted(key, own), len(key) - 1)
            known = key[at] == own
            rank = np.where(known, df[at], 1)
            first = np.lexsort((own, rank))[: len(h) - _least(len(h)) + 1]
            found = np.unique(pivot[at[first[rank[first] > 1]]])
            ps += found.tolist()
            xs += [x] * len(found)
            ns += [len(h)] * len(found)
        return pa.table({"p": pa.array(ps, pa.int64()), "x": pa.array(xs, pa.int64()), "n": pa.array(ns, pa.int64())})

    sent = sets.groupBy("batch").applyInArrow(forward, "r long, batch long, cell binary, df binary, pivot binary")
    back = sent.groupBy("r").applyInArrow(total, "batch long, cell binary, df binary, pivot binary, r long")
    return _fresh(sets).groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(regions, "p long, x long, n long")


def _fresh(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, so that both sides of a cogroup may stem from one table."""
    return df.toDF(*df.columns)


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of ``left`` with each of ``right``: products of incidence matrices, some shingles at a time."""
    flat = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    both = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float64)
    if not len(both):
        return out.astype(np.int64)
    for k in (0, 1):
        at = np.minimum(np.searchsorted(both, flat[k]), len(both) - 1)
        there = both[at] == flat[k]
        at, own = at[there], rows[k][there]
        order = np.argsort(at, kind="stable")
        flat[k], rows[k] = at[order], own[order]
    for first in range(0, len(both), COLUMNS):
        part = []
        for k, side in enumerate((left, right)):
            a, b = np.searchsorted(flat[k], (first, first + COLUMNS))
            part.append(np.zeros((len(side), min(COLUMNS, len(both) - first)), np.float32))
            part[k][rows[k][a:b], flat[k][a:b] - first] = 1
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def _linked(both, n, m):
    return DEN * both >= NUM * (n + m - both)


def _to_cells(left: pa.Table, right: pa.Table) -> pa.Table:
    """cell, q, x, outer, d: the Voronoi cell of each member (left) among the pivots (right), and the cells before it whose window
    the member is in, as an outer one. q numbers a region's pivots by their keys, d is the distance to the cell's pivot."""
    out: list[list] = [[], [], [], []]
    if len(left) and len(right):
        pivots = sorted(zip(right.column("q").to_pylist(), right.column("set").to_pylist()))
        sets = [[np.frombuffer(s, "<u8") for s in column] for column in (left.column("set").to_pylist(), [s for _, s in pivots])]
        both = _intersections(*sets)
        n, m = (np.array([len(s) for s in side]) for side in sets)
        distance = 1 - both / (n[:, None] + m - both)
        own = distance.argmin(1)
        least = distance[np.arange(len(n)), own]
        inside = (distance <= least[:, None] + 2 * (1 - NUM / DEN) + 1e-9) & (np.arange(len(m)) < own[:, None])
        row, q = np.nonzero(inside)
        x = left.column("x").to_numpy()
        out = [[*own.tolist(), *q.tolist()], [*x.tolist(), *x[row].tolist()], [0] * len(own) + [1] * len(q), [*least.tolist(), *distance[row, q].tolist()]]
    cell = (left if len(left) else right).column("cell")[0].as_py()
    return pa.table({"cell": pa.array([cell] * len(out[0]), pa.int64()), "q": pa.array(out[0], pa.int64()), "x": pa.array(out[1], pa.int64()), "outer": pa.array(out[2], pa.int64()), "d": pa.array(out[3], pa.float64())})


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest number that each row of a symmetric matrix of links reaches."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label, len(label)).min(1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(table: pa.Table) -> pa.Table:
    """x, links, root of the members of one block: two parts of a region, or one part with itself.

    Pairs that belong elsewhere are left out: those with a common region of a smaller pivot, and those that are both outer
    members of a cell.
    """
    x, part, outer, w = (table.column(c).to_numpy() for c in ("x", "part", "outer", "w"))
    sets = [np.frombuffer(s, "<u8") for s in table.column("set").to_pylist()]
    p = table.column("p").to_numpy()[0]
    earlier = [(c := np.frombuffer(s, "<i8"))[c < p].view(np.uint64) for s in table.column("regions").to_pylist()]
    order = np.lexsort((x, part))
    first, second = (order[part[order] == table.column(side)[0].as_py()] for side in ("a", "b"))
    n = np.array([len(s) for s in sets])
    pick = lambda values, rows: [values[i] for i in rows]
    found = _linked(_intersections(pick(sets, first), pick(sets, second)), n[first][:, None], n[second])
    found &= (outer[first][:, None] & outer[second]) == 0
    found &= _intersections([np.unique(e) for e in pick(earlier, first)], [np.unique(e) for e in pick(earlier, second)]) == 0
    size = len(x)
    square = np.zeros((size, size), bool)
    square[np.ix_(first, second)] = found
    square |= square.T
    np.fill_diagonal(square, False)
    links = square.astype(np.int64) @ w
    root = x[_roots(square)]
    some = np.flatnonzero(links)
    return pa.table({"x": x[some], "links": links[some], "root": root[some]})


def _salt(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts)


def _numbers(n: Column) -> Column:
    """0 to n - 1, a row each."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _sizes(cells: DataFrame) -> DataFrame:
    """cell, m and the parts that its members are dealt to, for cells with two members or more."""
    most = lambda c, n: F.ceil(c / n).cast("long")
    found = cells.groupBy("cell").agg(F.count("*").alias("m"), F.sum("n").alias("_n")).where("m > 1")
    by_members = F.when(F.col("m") > 2 * MEMBERS, most(F.col("m"), MEMBERS)).otherwise(F.lit(1).cast("long"))
    return found.select("cell", "m", F.greatest(by_members, most(F.col("_n"), PART_SHINGLES)).alias("parts"))


def _split(big: DataFrame, sets: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(cells, whole): the Voronoi cells of regions that are worth splitting, and the regions that are not."""
    by_hash = F.pmod(F.xxhash64(F.lit(level), "x"), F.lit(PIVOTS))
    pivots = big.groupBy("cell", by_hash.alias("_b")).agg(F.min_by("x", F.xxhash64(F.lit(-level - 1), "x")).alias("q"), F.first("parts").alias("parts"))
    pivots = materialize(pivots.select("cell", "q", "parts"), "ngram-pivots")
    dealt = big.select("cell", "x", _salt("x", F.col("parts")).alias("salt")).join(sets, "x")
    sent = pivots.join(sets.withColumnRenamed("x", "q"), "q").select("cell", "q", "set", _numbers(F.col("parts")).alias("salt"))
    cells = materialize(dealt.groupBy("cell", "salt").cogroup(_fresh(sent).groupBy("cell", "salt")).applyInArrow(_to_cells, "cell long, q long, x long, outer long, d double"), "ngram-distances")
    # No link leads to an outer member that is further from the pivot than the cell's own members by more than the radius, or nearer.
    own = cells.where("outer = 0").groupBy("cell", "q").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    window = (F.col("outer") == 0) | F.col("d").between(F.col("least") - (1 - NUM / DEN) - 1e-9, F.col("most") + (1 - NUM / DEN) + 1e-9)
    cells = materialize(cells.join(own, ["cell", "q"]).where(window).select("cell", "q", "x", "outer"), "ngram-cells")
    per = cells.groupBy("cell", "q").agg(F.count_if(F.col("outer") == 0).alias("h"), F.count("*").alias("m"))
    pairs = per.groupBy("cell").agg(F.sum(F.col("h") * (F.col("m") - F.col("h") / 2)).alias("after"))
    worth = materialize(pairs.join(big.groupBy("cell").agg(F.first("m").alias("m")), "cell").where(F.col("after") <= WORTH * F.col("m") * F.col("m") / 2).select("cell"), "ngram-worth")
    rest = ["cell", "p", "x", "n", "outer"]
    children = cells.withColumnRenamed("outer", "_o").join(worth, "cell").join(big.select(*rest), ["cell", "x"])
    bit = F.shiftleft(F.col("_o"), level).bitwiseOR(F.col("outer"))
    return children.select(F.xxhash64("cell", "q").alias("cell"), "p", "x", "n", bit.alias("outer")), big.join(worth, "cell", "left_anti").select(*rest)


def _compared(members: DataFrame, sets: DataFrame, weights: DataFrame) -> DataFrame:
    """x, links and root of every member of every block of the regions ``members`` (p, x, n)."""
    regions = members.groupBy("x").agg(F.sort_array(F.collect_list("p")).alias("_p"))
    number = pa.binary()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v, "<i8").tobytes() for v in batch.column(1).to_pylist()], number)], ["x", "regions"])

    facts = materialize(sets.join(regions.mapInArrow(packed, "x long, regions binary"), "x").join(weights, "x"), "ngram-facts")
    todo = members.select(F.col("p").alias("cell"), "p", "x", "n", F.lit(0).cast("long").alias("outer"))
    done = []
    for level in range(LEVELS):
        sized = materialize(todo.join(hint_small(materialize(_sizes(todo), "ngram-sizes"), 24), "cell"), "ngram-regions-sized")
        big = sized.where(F.col("m") > 2 * MEMBERS)
        done.append(sized.where(F.col("m") <= 2 * MEMBERS).drop("m", "parts"))
        if big.isEmpty():
            todo = None
            break
        todo, whole = _split(big, sets, level)
        todo = materialize(todo, "ngram-todo")
        done.append(whole)
    for more in [*done[1:], *([todo] if todo is not None else [])]:
        done[0] = done[0].unionByName(more)
    cells = materialize(done[0], "ngram-done")
    placed = cells.join(hint_small(materialize(_sizes(cells), "ngram-sizes"), 24), "cell").withColumn("part", _salt("x", F.col("parts"))).withColumn("other", _numbers(F.col("parts")))
    placed = placed.select("cell", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "p", "x", "outer", "part")
    return placed.join(facts, "x").groupBy("cell", "a", "b").applyInArrow(_compare, "x long, links long, root long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, node, component_id and n_links for every row of ``docs``.

    A text's words are runs of other characters than space and tab to carriage return, A-Z lower-cased; its set has its
    distinct five-word shingles, or its whole sequence if it has fewer words. Two rows link if their sets' intersection is
    at least 80 % of their union. ``node`` stands for a set, component_id is the smallest doc_id reachable by links, and n_links
    the number of other rows that the row links with.

    Null and empty texts, and texts of white space, have an empty set, link with nothing (not even each other) and are
    components of their own. Null ids are never a component_id unless all ids of the component are null. Rows may repeat
    or share an id: each row counts by its own text. Empty input gives no rows. Other columns are ignored.

    Shingles and sets are told apart by 64-bit hashes (sets by two of them and their size).
    """
    spark = docs.sparkSession
    prepare_tasks(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(_classes(docs), "ngram-rows")
    classes = materialize(rows.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("w")), "ngram-classes")
    shingles = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-shingles * 2 // 5 // POSTINGS))
    least = F.ceil(F.col("n") * NUM / DEN)
    sure = F.greatest(F.lit(1), least - F.ceil(least * NUM / DEN))
    shared = _shared_counts(docs, buckets).withColumnRenamed("node", "a")
    alive = materialize(classes.join(shared, "a").where(F.col("c") >= sure).select("a", "n", "rep"), "ngram-alive")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", 2 << 20):
            sets = _sets(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_fingerprint(s)[0] for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["x", "set"]
            )

    left = alive.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    batches = max(partitions, -(-left // POSTINGS))
    found = docs.join(hint_small(alive.select(F.col("rep").alias("_rep")), 16), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    sets = found.mapInArrow(to_sets, "x long, set binary").join(hint_small(alive.select(F.col("a").alias("x")), 16), "x", "left_semi")
    sets = materialize(sets.dropDuplicates(["x"]).withColumn("batch", F.pmod(F.xxhash64("x"), F.lit(batches))), "ngram-sets")

    members = materialize(_regions(sets, max(partitions, -(-left // POSTINGS))), "ngram-regions")
    weights = classes.join(alive.select("a"), "a").select(F.col("a").alias("x"), "w")
    compared = materialize(_compared(members, sets.select("x", "set"), weights), "ngram-compared")
    final = connected_components(compared.select(F.col("root").alias("u"), F.col("x").alias("v")), "ngram-final").withColumnRenamed("node", "a")
    counts = compared.groupBy(F.col("x").alias("a")).agg(F.sum("links").alias("links"))
    joined = classes.join(final, "a", "left").join(counts, "a", "left").withColumn("component", F.coalesce("component", "a"))
    smallest = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    links = F.coalesce("links", F.lit(0)) + F.col("w") - 1
    named = materialize(joined.join(smallest, "component").select("a", "b", "n", "component_id", links.alias("n_links")), "ngram-named")
    # Rows without shingles, all of one key, have no part in the join.
    linked = rows.where("n > 0").join(named, ["a", "b", "n"])
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("node"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.col("a").alias("node"), "component_id", F.col("n_links").cast("long").alias("n_links")).unionByName(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with all columns unchanged: of each component the rows of its component_id, one if that id repeats.

    Rows without words stay; so do rows of components that have null ids only, one of each set. Ids should be distinct, as
    exact dedup leaves them; if an id repeats, rows of it stay together with the one that is kept unless they are equal.
    """
    rows = jaccard_classes(docs, id_col, text_col)
    gone = materialize(rows.where("n_shingles > 0 AND NOT (doc_id <=> component_id)").select("doc_id"), "ngram-gone")
    other = unused(docs.columns, "_gone")
    return docs.join(hint_small(gone.withColumnRenamed("doc_id", other), 16), F.col(id_col) == F.col(other), "left_anti")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and number of links of each document. Texts that are null, empty or white space have no shingles and stand alone."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_links")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END) AS g
      FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.component_id, (SELECT count(*) FROM links WHERE u = d.doc_id)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u) m USING (doc_id)
"""
