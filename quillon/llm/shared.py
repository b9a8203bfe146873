"""Session helpers of this subpackage: the shared folder, table materialisation, Arrow batch sizes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and Python. Documents average a few KB and may
#: be a hundred times longer, so the default of 10,000 rows would make batches of many MB.
BATCH_ROWS = 1000
#: Bytes of one batch, beyond which it ends after a row: a batch of long texts has few rows.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local session, as in tests, may go without: it is given a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, reread with df's schema.

    Shuffle files behind the table are of no more use. Spark deletes them, on all executors, once
    the driver's JVM finds their objects unreachable; that is asked for here, as it might else
    happen only after many stages.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.quillon_folder = at
    spark.sparkContext._jvm.System.gc()
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once all that was derived from them is itself written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.quillon_folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000") or 0) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "", str(2**31 - 1), "2147483647b"):
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Returns what this process has freed to the system; else a Python worker keeps the most that any of its tasks took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def column(name: str) -> Column:
    """The column of that very name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(docs: DataFrame, carry: list[str]) -> tuple[list[Column], str]:
    """The columns of carry under names that no operator uses, and their part of a schema."""
    kinds = docs.select(*[column(c).alias(f"own_{i}") for i, c in enumerate(carry)])
    return [column(c).alias(f"own_{i}") for i, c in enumerate(carry)], ", ".join(f"{c} {t}" for c, t in kinds.dtypes)


def restored(carry: list[str]) -> list[Column]:
    return [F.col(f"own_{i}").alias(c) for i, c in enumerate(carry)]


def row_keys(docs: DataFrame) -> list[Column]:
    """k1, k2: 128 bits of doc_id (of any type, null or not) and text (null as empty). Rows with equal keys are equal in both."""
    text = F.coalesce(docs["text"], F.lit(""))
    unnamed = docs["doc_id"].isNull()
    return [F.xxhash64(unnamed, docs["doc_id"], text).alias("k1"), F.xxhash64(F.lit("second"), unnamed, docs["doc_id"], text).alias("k2")]
