"""How plans are cut and spread over a cluster."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: the session's ``spark.checkpoint.dir``; only a local
    session without one gets a temporary folder, which is removed when the driver ends."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tamarack-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder that all executors share, and read from there.

    A lost executor loses nothing of it.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written_parts(df: DataFrame, part: str) -> list[tuple[int, str, int]]:
    """``df`` written once to the checkpoint folder, a partition to a file of its own: what ``part`` is in
    a file, the file's URI and its rows. Tasks open them by PyArrow, which knows file, hdfs, s3 and gs."""
    folder = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.option("parquet.enable.dictionary", "false").parquet(folder)
    files = df.sparkSession.read.parquet(folder).groupBy(part, F.col("_metadata.file_path").alias("_file")).count()
    return sorted((r[part], r["_file"], r["count"]) for r in files.collect())


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Makes this package importable for the session's Python workers, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="tamarack-code-")) / "tamarack.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))  # the driver serves it to the executors
    _shipped.add(sc.applicationId)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


#: Bytes of input per partition of an explicit exchange.
PART_BYTES = 64 << 20


def shuffle_parts(df: DataFrame, per_core: int = 3, growth: float = 1.0) -> int:
    """Partitions of an explicit exchange of ``df``'s rows: by their size as the optimizer estimates it,
    ``growth`` times that if an operator multiplies them; at least what the session asks for and
    ``per_core`` a core."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 50  # a plan without statistics claims the largest number there is
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * cores(spark), math.ceil(size * growth / PART_BYTES) if known else 0)


def spread(df: DataFrame, *by: str | Column, per_core: int = 2) -> DataFrame:
    """``df`` with enough partitions for work that is heavy per row.

    A scan that already splits into ``per_core`` partitions a core stays as it is, without shuffle.
    """
    least = per_core * cores(df.sparkSession)
    if df.rdd.getNumPartitions() >= least:
        return df
    return df.repartition(least, *by)


def salt(c: Column, ways: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(ways)).cast("int")
