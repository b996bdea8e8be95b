"""Sharding by a two-pass external shuffle.

Pass one scatters the rows uniformly over memory-sized buckets by a seeded hash;
pass two shuffles every bucket in memory by Fisher-Yates and writes it. The
buckets laid end to end are one random permutation of the table, so dealing its
positions out in turn gives shards whose row counts differ by one at most.
"""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_bounded, replacing

#: Bytes of text that one bucket holds on average.
BUCKET_BYTES = 16 << 20
#: Tasks of pass two at most; beyond, a task takes several buckets, one after another.
MAX_TASKS = 100_000
#: Buckets whose starts are summed up together.
GROUP_BUCKETS = 4096


def fisher_yates(n: int, seed: str) -> list[int]:
    """A permutation of ``range(n)``: each place swaps with a random earlier one."""
    rng, order = random.Random(seed), list(range(n))
    for i in range(n - 1, 0, -1):
        j = int(rng.random() * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def two_pass_shuffle(df: DataFrame, scratch: Scratch, text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``df`` with ``_position``, its place in one random permutation.

    The bucket hash takes the row's number in its input partition as well as its
    content, so repeated rows, even a third of the table, scatter like all others.
    The order is a function of the seed and of how the input is laid out. Null
    texts count as empty; an empty table stays empty; columns of ``df`` that are
    named like the ones made here (``_position`` and others that begin so) are replaced.
    """
    df = replacing(df, "_bucket", "_order", "_place", "_position", "_start")
    total = df.agg(F.sum(F.octet_length(F.coalesce(text, F.lit(""))) + 64)).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    keyed = df.withColumn("_order", F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), F.col(text)))
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.lit(n)).cast("int"))

    def shuffled(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("_order", "ascending")]))
        bucket = t["_bucket"][0].as_py()
        t = t.take(pa.array(fisher_yates(t.num_rows, f"{seed}/{bucket}"), pa.int64()))
        return t.append_column("_place", pa.array(range(t.num_rows), pa.int64()))

    schema = keyed.withColumn("_place", F.lit(0).cast("long")).schema
    dealt = keyed.repartition(min(n, MAX_TASKS), "_bucket")
    written = scratch.keep(dealt.groupBy("_bucket").applyInArrow(shuffled, schema), "buckets")
    # rows before each bucket, in two steps: before its group of buckets, and before it in there
    sizes = written.groupBy("_bucket").agg(F.count("*").alias("rows")).withColumn("_group", F.expr(f"_bucket div {GROUP_BUCKETS}"))
    groups = sizes.groupBy("_group").agg(F.sum("rows").alias("rows"))
    groups = groups.select("_group", F.coalesce(F.sum("rows").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("rows").over(Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_inside", inside).join(groups, "_group").select("_bucket", (F.col("_base") + F.col("_inside")).alias("_start"))
    starts = scratch.keep(starts, "starts")
    placed = written.join(broadcast_if_bounded(starts), "_bucket")
    return placed.withColumn("_position", F.col("_start") + F.col("_place")).drop("_bucket", "_order", "_place", "_start")


def shard(df: DataFrame, scratch: Scratch, shards: int = 8, text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``df`` with its ``shard`` and its ``slot`` there, gapless from 0.

    The law is ``rows``: shard sizes differ by one row at most. Columns of ``df``
    named ``shard`` or ``slot`` are replaced.
    """
    df = replacing(df, "shard", "slot")
    placed = two_pass_shuffle(df, scratch, text, seed, bucket_bytes)
    return placed.withColumns({"shard": F.pmod("_position", F.lit(shards)).cast("int"), "slot": F.expr(f"_position div {shards}")}).drop("_position")


def write_shards(df: DataFrame, scratch: Scratch, path: str, **options) -> None:
    """The shards as files under ``path``, one folder each, in slot order."""
    placed = shard(df, scratch, **options)
    placed.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in eight shards under the law ``rows``.

    A null text has no bytes and the checksum of the empty text. Extra columns
    are not carried into the digest.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = shard(docs, Scratch(spark, "shards"))
    full = F.coalesce("text", F.lit(""))
    return placed.select("doc_id", (F.octet_length(full) + 1).cast("long").alias("size"), F.crc32(full).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
