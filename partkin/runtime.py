"""What a session needs: this package on its executors, and a shared folder where lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Rows that are broadcast at most, where a count says how many there are; more are joined by a shuffle.
FEW = 100_000


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="partkin-")) / "partkin_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for p in sorted(here.rglob("*.py")):
                out.write(p, Path(here.name) / p.relative_to(here))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def tuned(spark: SparkSession) -> SparkSession:
    """Has generated methods that the JVM would never compile run as separate expressions.

    Reading a line takes some thirty expressions; as one method they exceed the 8000 bytes of code
    above which HotSpot only interprets. A session that set the limit itself keeps its own.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit) == "65535":
        spark.conf.set(limit, "8000")
    return spark


def shared_folder(context: SparkContext) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where none is set, a local one is made if driver and executors are one process, as in tests; on a
    cluster that is an error.
    """
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="partkin-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder.

    Files go when Spark finds the result unreachable, if it is set to clean checkpoints.
    """
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder as Parquet, for tables of many rows.

    A checkpoint holds whole rows; columns take a fraction of that, and readers read those they need.
    What was shuffled to compute it goes at once. Files go when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark.sparkContext)}/kept-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(folder)


def few(df: DataFrame) -> DataFrame:
    """``df``, which should be kept, with the hint to broadcast it if a count says that its rows are few."""
    return F.broadcast(df) if df.count() <= FEW else df
