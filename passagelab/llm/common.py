"""What the corpus operators share: reading tables and the shared scratch folder."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast is made only of tables counted to be at most this many rows of a few bytes.
BROADCAST_ROWS = 1_000_000
#: Bytes of strings in such a table at most.
BROADCAST_BYTES = 64 << 20


#: Bytes of a batch for a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where none is set (local
    tests) a temporary folder is made and set for the rest of the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="passagelab-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get in bytes, unless the session has a smaller bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Scratch:
    """Tables of one run in the shared folder.

    ``keep(df, name)`` writes a table and reads it back, which cuts the lineage:
    a lost executor costs a re-read, not a recomputation. ``drop(name)`` deletes
    a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bound_batches(spark)
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, True)


def replacing(df: DataFrame, *made: str) -> DataFrame:
    """``df`` without the columns that are named like those about to be made; case doesn't count."""
    names = {m.lower() for m in made}
    return df.select(*[df[c] for c in df.columns if c.lower() not in names]) if names & {c.lower() for c in df.columns} else df


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts; nulls have none."""
    return df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``limit`` rows and its strings few enough bytes, looking at no more rows than that."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = F.sum(sum(texts[1:], texts[0]).cast("long")) if texts else F.lit(0)
    rows, held = df.limit(limit + 1).agg(F.count("*"), size).first()
    return rows <= limit and (held or 0) <= BROADCAST_BYTES


def broadcast_if_bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if its measured size allows, else as it is."""
    return F.broadcast(df) if bounded(df, limit) else df


def release() -> None:
    """Give freed memory back to the system; a Python worker outlives its task and stays beside the next one's."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(batches_to_batches):
    """A function for ``mapInArrow`` that releases memory when its partition is done."""

    @functools.wraps(batches_to_batches)
    def run(batches):
        try:
            yield from batches_to_batches(batches)
        finally:
            release()

    return run
