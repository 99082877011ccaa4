"""Folders shared by driver and executors for tables and checkpoints that a run needs in between."""

from __future__ import annotations

import atexit
import contextlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import SparkSession

_made: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``, removed when the driver ends.

    Where that is unset, a local folder is made in local mode; on a cluster, whose executors would not see it, this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/ledgerloom/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def open_fs(path: str) -> tuple[FileSystem, str]:
    """The file system of a URI, as driver and tasks open it; a plain path is local."""
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def remove(path: str) -> None:
    with contextlib.suppress(Exception):  # what can't be reached here is left to whoever keeps the folder
        system, name = open_fs(path)
        system.delete_dir(name)


@atexit.register
def remove_scratch() -> None:
    for path in _made:
        remove(path)


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
    folder = scratch_path(spark, "package")
    system, name = open_fs(folder)
    system.create_dir(name, recursive=True)
    with system.open_output_stream(f"{name}/{root.name}.zip", compression=None) as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")
