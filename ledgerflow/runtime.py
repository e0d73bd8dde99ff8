"""Session helpers: code shipping, and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Arrow batches hold few rows, as rows can be long texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the executors, once per application, and keep Arrow batches small unless they are set."""
    context = spark.sparkContext
    for name, small in BATCHES.items():
        # without a value of its own the session gives the one asked with
        if spark.conf.get(name, small) == small:
            spark.conf.set(name, small)
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp()) / "ledgerflow.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset, and all runs on this machine, one in the local temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/ledgerflow-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what cut() wrote for these frames; nothing may read them afterwards. Other frames are left alone."""
    for frame in frames:
        if written := frame.__dict__.pop("_cut_path", None):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that are of use only until a block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.frames = spark, []

    def __enter__(self) -> Scratch:
        return self

    def cut(self, df: DataFrame, name: str = "cut") -> DataFrame:
        found = cut(df, name)
        self.frames.append(found)
        return found

    def drop(self, *frames: DataFrame) -> None:
        drop(self.spark, *frames)

    def __exit__(self, *failed) -> None:
        drop(self.spark, *self.frames)
