"""What the training-data operators share: word rule, folds, staging of tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(name: str = "text") -> Column:
    """Number of words of a text as long; null counts as empty."""
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def fold(key: str, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n: the split into folds."""
    return (F.crc32(F.col(key).cast("string")) % n).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session may lack the setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lithoframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and reread: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lithoframe/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let the executors drop the shuffle files behind them."""
    for table in tables:
        jvm = table.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(table.staged_at)
        at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if tables:
        jvm.System.gc()  # Spark's cleaner removes the files of shuffles that are no longer referred to


def trimmed(make: Callable) -> Callable:
    """make, which gives a worker's free memory back when its task ends: workers stay for the next stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from make(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim is not None:
                trim(0)

    return run


def unused(name: str, columns: list[str]) -> str:
    """name, or name with a number, such that no column is called that (case doesn't matter to Spark)."""
    have, out, k = {c.lower() for c in columns}, name, 0
    while out.lower() in have:
        k += 1
        out = f"{name}_{k}"
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
