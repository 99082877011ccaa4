"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A side of a join is broadcast only if it has been counted and its rows need no more than this.
BROADCAST_BYTES = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, from ``spark.checkpoint.dir``; where that is unset, a new local one in local
    mode, and an error on a cluster, whose executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_made: list[str] = []
#: Paths of written tables that are to be discarded before the driver ends, by the identity of their DataFrame.
_written: dict[int, str] = {}


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder; it is removed when the driver ends."""
    _made.append(f"{scratch_dir(spark)}/ledgerloom/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def remove(path: str) -> None:
    with contextlib.suppress(Exception):  # what can't be reached here is left to whoever keeps the folder
        system, name = open_fs(path)
        system.delete_dir(name)


@atexit.register
def remove_scratch() -> None:
    for path in _made:
        remove(path)


def discard(table: DataFrame) -> None:
    """Remove what ``materialize`` wrote for ``table``, which nothing reads any more."""
    if path := _written.pop(id(table), None):
        remove(path)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, as driver and tasks open it; a plain path is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and a lost executor loses nothing."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(table)] = path
    return table


def hint_small(table: DataFrame, row_bytes: int, *texts: str) -> DataFrame:
    """``table`` (materialized) with a broadcast hint if its measured size allows it; else as it is, and the join shuffles.

    The size is ``row_bytes`` for each row, and what the columns ``texts`` hold.
    """
    held = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(row_bytes))
    return F.broadcast(table) if (table.agg(F.sum(held)).first()[0] or 0) <= BROADCAST_BYTES else table


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (names don't differ by case alone)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Where all characters are ASCII, which lengths tell, Spark's own lower case does the same, sooner."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application, so that tasks can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    folder = new_path(spark, "package")
    system, name = open_fs(folder)
    system.create_dir(name, recursive=True)
    with system.open_output_stream(f"{name}/{root.name}.zip", compression=None) as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")


def prepare_tasks(spark: SparkSession, rows: int = 2000, max_bytes: int = 16 << 20) -> None:
    """Before Python functions run in tasks: bound what a worker is handed at once, in rows and bytes, and ship the package.

    The bounds are settings of the session, which Spark reads when a query starts; so they are set here and stay set.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, target: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece has about ``target`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = used = 0
        for i, n in enumerate(sizes):
            if used and used + n > target:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += n
        if start < len(sizes):
            yield batch.slice(start)
