"""Sessions, the shared work folder, and tables written between stages."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings this library expects; conf adds or overrides."""
    builder = SparkSession.builder.master(master).appName("sparkloom")
    base = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=base | conf).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if its scan has fewer partitions than there are cores: else a table of one row group would be one task.

    Tables of any size worth the name have more, and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def give_back() -> None:
    """Hand memory that a finished task no longer uses back to the system: Python workers live on, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, _local, True)
    return f"file://{_local}"


_local: str | None = None


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the work folder and read it again: lineage ends here and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
