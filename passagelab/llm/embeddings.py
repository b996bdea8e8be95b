"""Near-duplicate vectors by sorted projection passes and an exact check of what they leave apart.

Each pass gives every vector one sortable key, the concatenated signs of random
projections, and compares vectors with the bounded window of their neighbours in
the order of these keys. What several passes find is united. A vector that is a
near copy of another shares all but a few signs with it, so with fresh
projections in each pass the two soon stand side by side. How soon depends on the
number of vectors with their label, and so does the number of passes.

A window misses pairs, the more the larger a label is or the more its vectors lie
around one direction. So labels of every size are then compared once more, all
vectors with all in blocks: that counts the links of each vector and gives the links
between what the passes left apart. Neither the number of passes nor the blocks'
sizes show in a result.

Pairs of equal vectors are never made: they are one class with its size. In a
window only a forest of links is emitted, and in a block none inside a component,
so a crowd of near copies costs block products and one count for each row and
block, not a row a pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, table
from .components import components

#: Chance that all passes miss a lone pair just at the threshold, if the label is worth as many; the exact check finds it then.
MISS = 1e-6
#: Signs in a key; a key is one long.
SIGNS = 48
#: Neighbours after each vector that it is compared with.
WINDOW = 512
#: A quarter of the rows in a block of the exact check, at least; large labels take larger blocks, up to so many bytes
#: of doubles, to be cut into no more than so many blocks. And the cosines of one matrix product.
BLOCK = 512
BLOCK_BYTES = 8 << 20
BLOCKS = 16
PRODUCT = 1 << 21
#: Cosines nearer than this to the threshold are computed again one by one.
EDGE = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def stacked(column) -> np.ndarray:
    """Rows of one length as a matrix of doubles."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def linked_rows(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two matrices of unit vectors are linked; at an edge this must not depend on the block's shape."""
    found = a @ b.T
    hit = found >= threshold
    i, j = np.nonzero(np.abs(found - threshold) < EDGE)
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        hit[x, y] = (a[x] * b[y]).sum(axis=1) >= threshold
    return hit


def passes_for(n: int, threshold: float, window: int, miss: float = MISS) -> float:
    """Passes after which a lone pair at the threshold is missed with a chance of ``miss`` among ``n`` vectors.

    Two vectors at angle t share a sign with chance 1 - t / pi. They must share about
    log2(n / window) of them to stand in one window, if the signs halve the vectors.
    """
    same = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    halvings = max(0.0, np.log2(n / window))
    chance = same**halvings
    if chance >= 1:
        return 1
    return float(np.ceil(np.log(miss) / np.log1p(-chance))) if chance > 1e-12 else float("inf")


def usable(key: str, vector: str, label: str) -> Column:
    """Whether key and label aren't null and the vector is finite, without nulls and not zero."""
    x = F.col(vector)
    good = F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(good, F.lit(False))


def forest(n: int, pairs) -> list[tuple[int, int]]:
    """A spanning forest of the pairs over ``range(n)``."""
    top, kept = list(range(n)), []

    def root(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            top[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def first_links(hit: np.ndarray) -> np.ndarray:
    """The links of a strict upper triangle without those that the first link of their row leads to."""
    first = hit.argmax(axis=1)
    return hit & ~(hit[first] & hit.any(axis=1)[:, None])


def first_links_between(hit: np.ndarray) -> np.ndarray:
    """The links of a rectangle without those that lead over the first link of their row to an earlier row."""
    rows = np.arange(len(hit))
    first = hit.argmax(axis=1)
    earlier = hit.argmax(axis=0)[first]
    kept = hit & ~(hit[earlier] & (earlier < rows)[:, None])
    kept[rows, first] = hit[rows, first]
    return kept


def sign_keys(x: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """The signs of the projections of each row as one number."""
    return (x @ plane.T > 0) @ (1 << np.arange(len(plane), dtype=np.int64)[::-1])


def plane_of(seed: int, d: int, number: int, signs: int) -> np.ndarray:
    return np.random.default_rng([seed, d, number]).standard_normal((signs, d))


def projection_keys(classes: DataFrame, signs: int, seed: int) -> DataFrame:
    """Each class once for each of its ``passes``, with its key there."""

    def keyed(batches):
        planes: dict[tuple, np.ndarray] = {}
        for b in batches:
            lengths, passes = b.column("length").to_numpy(), b.column("passes").to_numpy()
            for d in np.unique(lengths):
                for p in range(passes[lengths == d].max()):
                    part = b.filter(pa.array((lengths == d) & (passes > p)))
                    # each pass reads other projections first, so it sorts by other signs
                    if (d, p) not in planes:
                        planes[d, p] = plane_of(seed, int(d), p, signs)
                    key = sign_keys(stacked(part.column("vector")), planes[d, p])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), p), pa.int32()), pa.array(key, pa.int64()), part.column("label"), part.column("length"), part.column("rep"), part.column("vector")], names=["pass", "key", "label", "length", "rep", "vector"])

    kind = classes.schema
    return classes.select("label", "length", "passes", "rep", "vector").mapInArrow(keyed, f"pass int, key long, label {kind['label'].dataType.simpleString()}, length int, rep long, vector {kind['vector'].dataType.simpleString()}")


def window_links(sorted_rows: DataFrame, scratch: Scratch, threshold: float, window: int) -> DataFrame:
    """Links that unite each row with those of the ``window`` rows that follow it that are near it.

    Rows near a partition's edge are compared once more with those beyond it, so
    the links don't depend on where the partitions end.
    """
    row = sorted_rows.schema
    names = ["a", "b", "part", "pos", *row.names]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *(f.type for f in to_arrow_schema(row))]

    def linked(batches):
        part, at, held = TaskContext.get().partitionId(), 0, None

        def made(n, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if isinstance(columns.get(c), np.ndarray) else columns.get(c, pa.nulls(n, k)) for c, k in zip(names, kinds)], names=names)

        def beside(t, first):
            columns = {c: t[c].combine_chunks().cast(k) for c, k in zip(names[4:], kinds[4:])}
            return made(t.num_rows, part=np.full(t.num_rows, part), pos=np.arange(first, first + t.num_rows), **columns)

        for b in batches:
            for i in range(0, b.num_rows, window):
                t = pa.Table.from_batches([b.slice(i, window)])
                if at < window:
                    yield beside(t.slice(0, window - at), at)
                at += t.num_rows
                fresh = 0 if held is None else held.num_rows
                t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
                for a, b2 in near_pairs(t, fresh, threshold, window):
                    yield made(len(a), a=a, b=b2)
                held = t.slice(max(0, t.num_rows - window))
        if at > window:
            # the last rows without those that are among the first
            last = min(window, at - window)
            yield beside(held.slice(held.num_rows - last), at - last)
        yield made(1, part=np.array([part]), pos=np.array([at]))

    both = scratch.keep(sorted_rows.mapInArrow(linked, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("pos", T.LongType()), *row.fields])), "passes")
    sizes = both.where("part IS NOT NULL AND rep IS NULL").select("part", "pos").orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes], dtype=np.int64)])
    edges = np.unique(starts[(starts > 0) & (starts < starts[-1])])
    near = []
    for (part, n), start in zip(sizes, starts.tolist()):
        low, high = np.searchsorted(edges, [start - window + 1, start + n + window])
        near += [(part, start, e) for e in edges[low:high].tolist()] if n else []
    links = both.where("a IS NOT NULL").select("a", "b")
    if not near:
        return links
    near = sorted_rows.sparkSession.createDataFrame(near, "part int, start long, edge long")
    beside = both.where("part IS NOT NULL AND rep IS NOT NULL").join(F.broadcast(near), "part").withColumn("rank", F.col("start") + F.col("pos"))
    beside = beside.where((F.col("rank") >= F.col("edge") - window) & (F.col("rank") < F.col("edge") + window)).drop("a", "b", "part", "pos", "start")

    def over(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank").combine_chunks()
        fresh = int((t["rank"].to_numpy() < t["edge"][0].as_py()).sum())
        found = list(near_pairs(t, fresh, threshold, window))
        return pa.table({c: pa.array(np.concatenate([x[k] for x in found]) if found else [], pa.int64()) for k, c in enumerate("ab")})

    return links.unionAll(beside.groupBy("edge").applyInArrow(over, "a long, b long"))


def near_pairs(t: pa.Table, fresh: int, threshold: float, window: int):
    """Links of rows of one pass and label, at most ``window`` apart, whose later row is number ``fresh`` or later."""
    label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    passes, lengths, reps = t["pass"].to_numpy(), t["length"].to_numpy(), t["rep"].to_numpy()
    edge = (np.diff(label) != 0) | (np.diff(passes) != 0) | (np.diff(lengths) != 0)
    for rows in np.split(np.arange(t.num_rows), np.flatnonzero(edge) + 1):
        if len(rows) < 2 or rows[-1] < fresh:
            continue
        x = unit(stacked(t["vector"].slice(rows[0], len(rows))))
        new = max(0, fresh - int(rows[0]))
        number = np.arange(len(rows))
        apart = number[None, new:] - number[:, None]
        near = linked_rows(x, x[new:], threshold) & (apart > 0) & (apart <= window)
        if not near.any():
            continue
        hit = np.zeros((len(rows), len(rows)), bool)
        hit[:, new:] = near
        i, j = np.nonzero(first_links(hit))
        kept = forest(len(rows), zip(i.tolist(), j.tolist()))
        if kept:
            i, j = np.array(kept).T
            yield reps[rows[i]], reps[rows[j]]


def block_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Each row once for every pair of its group's blocks that its own one is in.

    Rows are dealt over the ``blocks`` of their group ``by`` by a hash.
    """
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(*by, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "size", "component", "vector")


def planned(classes: DataFrame, scratch: Scratch, threshold: float, window: int, block: int) -> DataFrame:
    """The classes that share a label and length with others, with the ``passes`` and ``blocks`` of these.

    A row is copied once a pass and once a block. More passes than blocks would cost
    more than the exact check after them, which needs none.
    """

    @F.pandas_udf("double")
    def needed(n: pd.Series) -> pd.Series:
        return n.map(lambda k: passes_for(k, threshold, window))

    sized = classes.withColumn("length", F.size("vector"))
    plan = sized.groupBy("label", "length").agg(F.count("*").alias("n")).where("n > 1")
    most = F.greatest(F.lit(4 * block), F.least(F.ceil(F.col("n") / BLOCKS), F.floor(F.lit(BLOCK_BYTES / 8) / F.col("length"))))
    plan = plan.withColumn("blocks", F.ceil(F.col("n") / most).cast("int")).withColumn("passes", F.least(needed("n"), "blocks").cast("int"))
    return sized.join(scratch.keep(plan.drop("n"), "plan"), ["label", "length"])


def near_links(rows: DataFrame, scratch: Scratch, threshold: float, signs: int, window: int, seed: int) -> DataFrame:
    """Links between near classes of each label, by sorted projection passes; some may be missed."""
    order = ["pass", "label", "length", "key", "rep"]
    keyed = projection_keys(rows, signs, seed).repartitionByRange(*order).sortWithinPartitions(*order)
    return window_links(keyed, scratch, threshold, window)


def exact_links(rows: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, n)`` by comparing each row with all of its label and length, in blocks.

    Where b is null, n are rows that class a is linked to outside itself, to be summed
    over a. Else a and b are linked classes of two components; with links inside the
    components, these unite all that are linked.
    """

    def checked(t: pa.Table) -> pa.Table:
        x, y = t["x"][0].as_py(), t["y"][0].as_py()
        own, sizes, inside, reps = t["own"].to_numpy(), t["size"].to_numpy(), t["component"].to_numpy(), t["rep"].to_numpy().astype(np.int64)
        v = unit(stacked(t["vector"]))
        a, b = np.flatnonzero(own == x), np.flatnonzero(own == y)
        n, links = np.zeros(t.num_rows), [np.zeros((0, 2), np.int64)]
        strip = max(1, PRODUCT // max(1, len(b)))
        for at in range(0, len(a), strip):
            part = a[at : at + strip]
            hit = linked_rows(v[part], v[b], threshold)
            if x == y:
                hit[np.arange(len(part)), at + np.arange(len(part))] = False
            i, j = np.nonzero(hit)
            n[part] += np.bincount(i, sizes[b[j]], len(part))
            if x != y:
                n[b] += np.bincount(j, sizes[part[i]], len(b))
            apart = inside[part[i]] != inside[b[j]]
            if x == y:
                apart &= at + i < j
            if apart.any():
                hit[:] = False
                hit[i[apart], j[apart]] = True
                i, j = np.nonzero(first_links_between(hit))
                links.append(np.stack([reps[part[i]], reps[b[j]]], axis=1))
        links, counted = np.concatenate(links), np.flatnonzero(n)
        none = pa.nulls(len(links), pa.int64()), pa.nulls(len(counted), pa.int64())
        counts = pa.table({"a": reps[counted], "b": none[1], "n": n[counted].astype(np.int64)})
        return pa.concat_tables([counts, pa.table({"a": links[:, 0], "b": links[:, 1], "n": none[0]})])

    by = ["label", "length", "x", "y"]
    # dealt by the blocks, too: a label alone would put all its blocks into one task
    return block_pairs(rows, by[:2]).repartition(*by).groupBy(*by).applyInArrow(checked, "a long, b long, n long")


def near_duplicates(df: DataFrame, scratch: Scratch, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", signs: int = SIGNS, window: int = WINDOW, block: int = BLOCK, seed: int = 23) -> DataFrame:
    """Per row of ``df``: ``key``, ``n_links``, ``component_id`` and ``kept``.

    Only rows of one label are compared, by cosine in doubles. Rows with a null
    label or key, or a vector that is null, zero or holds nulls or non-finite
    values, link with nothing and stand alone. Rows that repeat a key are one
    vector only if label and vector are equal, too; of such rows one may be usable and
    another not. An empty table stays empty.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    rows = rows.withColumn("good", usable("id", "vector", "label"))
    good = rows.where("good")
    classes = good.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    classes = scratch.keep(classes, "classes")
    many = planned(classes, scratch, threshold, window, block)
    links = scratch.keep(near_links(many, scratch, threshold, signs, window, seed), "links")
    found = scratch.keep(components(links, scratch), "found").withColumnRenamed("id", "rep")
    held = many.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    exact = scratch.keep(exact_links(held, threshold), "exact")
    missed = exact.where("b IS NOT NULL").select("a", "b")
    if not missed.isEmpty():
        found = scratch.keep(components(links.unionAll(missed), scratch, "exact-components"), "exact-found").withColumnRenamed("id", "rep")
    degrees = exact.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    known = classes.join(found, "rep", "left").join(degrees, "rep", "left").select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.join(known, ["label", "vector"])
    alone = rows.where("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.select("id", "n_links", "component_id").unionAll(alone).select(F.col("id").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links of at least 0.93 between the vectors of ``embeddings`` with one label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "vectors"))


OP7_SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as size from v),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id < b.vec_id
  where list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
x as (select a, b from l union all select b, a from l),
r(vec_id, c) as (select vec_id, vec_id from embeddings union select r.vec_id, x.b from r join x on x.a = r.c),
m as (select vec_id, min(c) as c from r group by vec_id),
n as (select a, count(*) as n from x group by a)
select m.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, m.c as component_id, m.c = m.vec_id as kept
from m left join n on n.a = m.vec_id
"""
