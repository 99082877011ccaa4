"""Lines and records of text files, with numbers that do not depend on how files are split.

A first pass counts, for each split, its lines and the quotes in them. Prefix sums over the splits of a file tell at which line a
split begins and whether it begins inside quotes; so every split is read by a task of its own, also where fields hold line breaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_below
from .scratch import scratch_path, ship_package

WHOLE, OPEN, TAIL, MIDDLE = range(4)
#: A row for each split is broadcast up to this size, which is 800,000 splits; beyond it lines are shuffled and sorted.
SPLIT_BYTES = 64 << 20
PART_BITS = 33


def _scan(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Lines as the splits give them; ``_at`` has the task in its upper bits and counts its lines in the lower ones."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(folder)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return rows.withColumn("_key", F.xxhash64("file_path")).withColumn("_task", F.shiftright("_at", PART_BITS))


def odd_quotes(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def _splits(scan: DataFrame) -> DataFrame:
    """Per split: its first line's place, the lines before it in its file, whether it begins inside quotes, and whether any line of the file ends inside."""
    per = scan.groupBy("file_path", "_key", "_block", "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.count_if(odd_quotes(F.col("value"))).alias("_odd"))
    file = Window.partitionBy("file_path")
    earlier = file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        "_key", "_block", "_task", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        (F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2 == 1).alias("_inside"), (F.sum("_odd").over(file) > 0).alias("_spans"),
    )


def _numbered(spark: SparkSession, folder: str, glob: str) -> tuple[DataFrame, DataFrame]:
    """(lines with their numbers, the splits' table)."""
    scan, path = _scan(spark, folder, glob), scratch_path(spark, "splits")
    found = _splits(scan)
    found.write.parquet(path)
    splits = spark.read.schema(found.schema).parquet(path)
    small = broadcast_below(splits, SPLIT_BYTES // 64, SPLIT_BYTES * 2)
    # Splits that the first pass did not see mean that settings changed in between; a wrong number would be worse than an error.
    stale = F.raise_error(F.lit("files are split in another way than when they were counted: keep spark.sql.files settings between reading and running"))
    lines = scan.join(small, ["_key", "_block", "_task"], "left")
    numbered = lines.withColumn("line", F.when(F.col("_first").isNotNull(), F.col("_before") + F.col("_at") - F.col("_first") + 1).otherwise(stale.cast("bigint")))
    return numbered, splits


def read_lines(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """value, file_path and line (from 1, the same in every read) of all lines below ``folder``; lines end at line feeds."""
    return _numbered(spark, folder, glob)[0].select("value", "file_path", "line")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to records. A record that goes on beyond its split, or came in from the one before, is given in parts."""
    split, inside, held, begun, kind = None, False, [], 0, WHOLE  # what is open at the end of a batch

    def rows(values: list, lines: list, kinds: list, where: tuple) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [pa.array(values, pa.string()), pa.array([where[0]] * n, pa.string()), pa.array(lines, pa.int64()), pa.array([where[1]] * n, pa.int64()), pa.array(kinds, pa.int32())],
            ["value", "file_path", "line", "block", "kind"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        names, blocks = batch.column("file_path"), batch.column("_block").to_numpy()
        ids = names.dictionary_encode().indices.to_numpy()
        odd = pc.count_substring(batch.column("value"), '"').to_numpy() % 2
        numbers, first_inside = batch.column("line").to_numpy(), batch.column("_inside").to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(ids) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:]):
            here = (names[a].as_py(), int(blocks[a]))
            if here != split:
                if held:  # the split before ended inside quotes
                    yield rows(["\n".join(held)], [begun], [OPEN if kind == WHOLE else MIDDLE], split)
                split, inside, held, begun = here, bool(first_inside[a]), [], int(numbers[a])
                kind = TAIL if inside else WHOLE
            values = batch.column("value").slice(a, b - a)
            after = (np.cumsum(odd[a:b]) + inside) % 2 == 1
            before = np.append(inside, after[:-1])
            whole = ~before & ~after
            if whole.any():
                picked = values.filter(pa.array(whole))
                where = [pa.array([v] * len(picked), t) for v, t in ((here[0], pa.string()), (here[1], pa.int64()), (WHOLE, pa.int32()))]
                yield pa.RecordBatch.from_arrays([picked, where[0], pa.array(numbers[a:b][whole], pa.int64()), where[1], where[2]], ["value", "file_path", "line", "block", "kind"])
            out: tuple[list, list, list] = ([], [], [])
            for i in np.flatnonzero(before | after).tolist():
                if not before[i]:
                    held, begun, kind = [], int(numbers[a + i]), WHOLE
                held.append(values[i].as_py())
                if not after[i]:
                    for column, value in zip(out, ("\n".join(held), begun, kind)):
                        column.append(value)
                    held = []
            if out[0]:
                yield rows(*out, here)
            inside = bool(after[-1])
    if held:
        yield rows(["\n".join(held)], [begun], [OPEN if kind == WHOLE else MIDDLE], split)


def read_records(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """value, file_path and line (that of its first line) of all CSV records below ``folder``: line breaks inside quotes belong to the record.

    Quotes stand around fields, doubled within them; one in the middle of a bare field counts as well, as readers that refuse
    such files would have it. Files in which no line ends inside quotes are read as lines. Lines of the others are joined in the
    order of their split, and what goes on beyond a split, at most two parts of it, is put together by shuffling those parts alone;
    their records are written once. A record that is still open at the end of its file is given as it is. A final carriage
    return is no part of a record.
    """
    numbered, splits = _numbered(spark, folder, glob)
    n_splits, spans, plain = splits.agg(F.count("*"), F.bool_or("_spans"), F.bool_or(~F.col("_spans"))).first()
    found = numbered.where(~F.col("_spans")).select("value", "file_path", "line")
    if spans:
        # In a shuffled join, which only a great many splits need, the order of lines is lost.
        lines = numbered.where("_spans").select("value", "file_path", "line", "_block", "_inside")
        if n_splits * 64 > SPLIT_BYTES:
            lines = lines.repartition("file_path", "_block").sortWithinPartitions("file_path", "_block", "line")
        path = scratch_path(spark, "records")
        ship_package(spark)
        lines.mapInArrow(_joined, "value string, file_path string, line bigint, block bigint, kind int").write.parquet(path)
        parts = spark.read.schema("value string, file_path string, line bigint, block bigint, kind int").parquet(path)
        torn = parts.where(F.col("kind") != WHOLE)
        begun = F.count_if(F.col("kind") == OPEN).over(Window.partitionBy("file_path").orderBy("block", "line"))
        pieces = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
        mended = torn.withColumn("_record", begun).groupBy("file_path", "_record").agg(pieces.alias("p"), F.min("line").alias("line"))
        mended = mended.select(F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"), "file_path", "line")
        joined = parts.where(F.col("kind") == WHOLE).select("value", "file_path", "line").unionByName(mended)
        found = found.unionByName(joined) if plain else joined  # files of no record across lines are read again only where there are any
    ends = F.endswith("value", F.lit("\r"))
    return found.withColumn("value", F.when(ends, F.expr("left(value, char_length(value) - 1)")).otherwise(F.col("value")))
