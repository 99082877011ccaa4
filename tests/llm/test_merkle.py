"""Merkle manifests against a plain version."""

from hashlib import sha256
from itertools import groupby
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle as MK
from support import DATA, same_rows


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, path of each leaf as a list of (left, right))."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a - a % 16
            paths[i].append(("".join(level[run:a]), "".join(level[a + 1 : run + 16])))
        level = [H(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [a // 16 for a in at]
    return level[0], paths


def plain_version(rows):
    """Of (doc_id, source, lang, n_chars, text)."""

    def leaf(values):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def first_null(v):
        return (v is not None, v if not isinstance(v, str) else v.encode())

    rows = sorted(rows, key=lambda r: (first_null(r[1]), first_null(r[0]), leaf(r)))
    groups = [(list(g), *tree([leaf(r) for r in g])) for g in ([*g] for _, g in groupby(rows, key=lambda r: r[1]))]
    if not groups:
        return []
    root, over = tree([g[1] for g in groups])
    out = []
    for (members, subroot, paths), up in zip(groups, over):
        for r, path in zip(members, paths):
            path, node, text = path + up, leaf(r), r[4]
            if r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0:
                low = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                node = leaf((*r[:4], low))
            for a, b in path:
                node = H(a, node, b)
            out.append((r[0], leaf(r), subroot, root, H(*(a + b for a, b in path)), node, node == root))
    return out


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def run(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, MK.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [17], [1, 16, 17, 256, 257, 600], [1] * 40 + [300]])
def test_sizes_around_the_fan(spark, tmp_path, sizes):
    rows = [(1000 * g + 7 * i, f"s{g:02}" if g else None, "en", i, f"Text {i % 5}") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert run(spark, tmp_path, df) == sorted(plain_version(rows), key=repr)


def test_odd_rows_repeats_and_ties(odd, spark, tmp_path):
    df = odd.withColumn("lang", F.when(F.col("n") % 2 == 0, F.lit("dé"))).withColumn("n_chars", F.col("n").cast("bigint"))
    df = df.unionByName(df.where("doc_id = 4")).unionByName(df.where("doc_id % 2 = 0"))
    rows = [tuple(r) for r in df.select(COLUMNS).collect()]
    assert run(spark, tmp_path, df) == sorted(plain_version(rows), key=repr)


def test_no_rows(empty):
    made = MK.manifest(empty, MK.digest(MK.field(F.col("text"))), "source", "doc_id")
    assert made.root is None and made.proofs().count() == 0 and made.nodes().count() == 0


def test_manifest_of_other_columns_and_nodes(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 3).alias("part"), F.col("id").cast("string").alias("hash"))
    made = MK.manifest(df, MK.digest(MK.field(F.col("hash"))), "part", "k")
    leaves = [[H(f"{len(str(i))}:{i}") for i in range(p, 300, 3)] for p in range(3)]
    assert made.root == tree([tree(x)[0] for x in leaves])[0]
    nodes = made.nodes().groupBy("tree", "level").count().orderBy("tree", "level").collect()
    assert [tuple(r) for r in nodes] == [(-1, 0, 3), (-1, 1, 1)] + [(t, i, n) for t in range(3) for i, n in enumerate((100, 7, 1))]
    assert made.proofs().where(MK.folded(F.col("path"), F.col("leaf")) != F.col("root")).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, oracle, size):
    assert same_rows(MK.op13_merkle_manifest(spark, f"{DATA}/{size}"), *oracle(MK.OP13_SQL, size))
