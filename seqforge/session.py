"""Session helpers: the shared folder in which lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (tests on one machine) a local folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", master := spark.sparkContext.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="seqforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: The paths made since each :func:`temporary` that is open began.
_open: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/seqforge/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession, keep: str = "\0") -> Iterator[list[str]]:
    """Tables that are written to the shared folder inside are deleted at the end, but for those whose name begins with
    ``keep``, which pass to the :func:`temporary` around this one. What still reads the others must be written by then."""
    _open.append(made := [])
    try:
        yield made
    finally:
        _open.pop()
        for path in made:
            if path.rpartition("/")[2].startswith(keep):
                if _open:
                    _open[-1].append(path)
            else:
                delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing. ``group_bytes``: of a
    row group, for tables of large rows."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> None:
    """Delete all that :func:`materialise` has written to the shared folder; results that still read it must be done."""
    delete(spark, f"{shared_dir(spark)}/seqforge")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: a zip of its sources, served by the driver."""
    sc = spark.sparkContext
    name = "seqforge_src.zip"
    if name in sc._python_includes:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="seqforge-src-")) / name
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
