"""Tables written between the rounds of iterative operators, and code sent to the executors."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a session whose driver is its only machine gets a folder of its own; any other is refused."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or _local()


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared(spark)}/loam-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet and read it again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS = 500_000  # of a join or an aggregate that meet in a task


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df with `rows` rows, dealt by columns to tasks of about `ROWS` of them, so that a task's memory doesn't grow with the table; where the session's own number of partitions does that, it is left to Spark."""
    n = 1 + rows // ROWS
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: workers elsewhere have no path to it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[2]
        out = Path(tempfile.mkdtemp(prefix="spark-")) / "loam_core.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted((root / "loam").rglob("*.py")):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(str(out))
        _shipped.add(app)
