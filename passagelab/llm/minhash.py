"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets are one class from the start. Classes whose
signatures agree in a whole band are candidates. A candidate pair's signatures are
compared a batch at a time, and it is dropped once the posterior probability that
its similarity reaches the threshold falls below ``miss``. Survivors are verified
exactly on their full sets.

No bucket is expanded into all its pairs. Every class is first paired with two of
the smallest classes of its buckets, and the links so confirmed give components. Only
buckets whose members then lie in different components are looked at again, once
for all buckets with the same members: members that aren't in the component of the
smallest one meet all members of other components, block by block. A block first
tells by the signatures which members have a surviving candidate at all; only
those bring their sets, and the block verifies them and gives a row for each two
components it unites. So no candidate link between components is lost, and the
tables have a row a member and block, not a row a pair.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_bounded, releasing, table
from .components import components
from .fragments import CHUNK_BYTES, U, _inner, mixed
from .substrings import WHITE

SHINGLE_WORDS = 5
#: Similarity as a fraction, numerator and denominator.
SIMILARITY = (4, 5)
#: Bands and rows of each: a pair at 0.8 shares no band with a chance of 2.5e-7.
BANDS, ROWS = 50, 6
#: Signature places that are compared in a batch, and the chance of a wrong drop in any of them.
BATCH = 50
MISS = 1e-6
#: Members of one side of a block when a bucket is looked at again; the other side has four times as many.
BLOCK = 512

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def word_lists(raw: bytes, words: int):
    """The words of a text, in parts that share ``words - 1`` of them."""
    at, carry = 0, []
    while at < len(raw):
        white = WHITE.search(raw, at + CHUNK_BYTES)
        end = white.start() if white else len(raw)
        found = raw[at:end].split()
        if found:
            yield carry + found
            carry = (carry + found)[-(words - 1) :] if words > 1 else []
        at = end


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct hashed shingles of a text, ascending; with fewer words the whole sequence is one."""
    parts = []
    for w in word_lists((text or "").encode().translate(LOWER), words):
        h = pd.util.hash_array(np.array(w, object), categorize=False)
        if len(w) < words and parts:
            continue
        out = np.zeros(max(1, len(w) - words + 1), U)
        for k in range(min(words, len(w))):
            out = mixed(out * U(0x9E3779B97F4A7C15) + h[k : k + len(out)])
        parts.append(out)
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, U)


@lru_cache(maxsize=2)
def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(s: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Smallest value of each of ``n`` hash functions over a set."""
    a, b = _coefficients(n, seed)
    x = (s >> U(32)).astype(np.uint32) ^ s.astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        v = np.multiply.outer(x[at : at + 2048], a)
        v += b
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(out, v.min(axis=0), out=out)
    return out


@lru_cache(maxsize=8)
def fewest_matches(places: int, batch: int, threshold: float, miss: float) -> tuple[int, ...]:
    """For each number of compared places the fewest matches that keep a pair.

    The similarity's prior is uniform; given m matches in n places its posterior is
    Beta(m + 1, n - m + 1), and that exceeds the threshold with the chance that a
    binomial of n + 1 trials at the threshold has at most m successes.
    """
    from math import comb

    out = []
    for n in range(batch, places + 1, batch):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of two signature matrices stay candidates through all batches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(fewest_matches(a.shape[1], BATCH, threshold, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    keep = np.zeros(len(a), bool)
    keep[alive] = True
    return keep


def _bytes_matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, BANDS * ROWS), np.uint8)


def sketches(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """``(doc_id, n_shingles, set_key, signature, bands)`` for rows with an id; no key without words.

    The signature keeps the low byte of each place; unequal sets agree on it with
    one chance in 256 more, which only ever keeps a candidate.
    """

    def sketched(batches):
        for b in batches:
            n, keys, sigs, bands = [], [], [], []
            for x in b.column(1):
                s = shingles(x.as_py(), words)
                n.append(len(s))
                if not len(s):
                    keys.append(None)
                    sigs.append(None)
                    bands.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                v = signature(s, BANDS * ROWS, seed)
                sigs.append(v.astype(np.uint8).tobytes())
                h = np.arange(BANDS, dtype=U)
                for r in range(ROWS):
                    h = mixed(h * U(0x9E3779B97F4A7C15) + v[r::ROWS].astype(U))
                bands.append(h.astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "signature", "bands"])

    return docs.select("doc_id", "text").mapInArrow(releasing(sketched), "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>")


def sequential(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs ``(a, b, sa, sb)`` whose signatures leave them candidates."""

    def kept(batches):
        for x in batches:
            ok = survives(_bytes_matrix(x.column(2)), _bytes_matrix(x.column(3)), threshold, miss)
            yield pa.RecordBatch.from_arrays([x.column(0).filter(pa.array(ok)), x.column(1).filter(pa.array(ok))], names=["a", "b"])

    return pairs.mapInArrow(releasing(kept), "a long, b long")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``(doc_id, set)`` of the documents ``ids``; a set is its sorted shingles' bytes."""

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x.as_py(), words).tobytes() for x in b.column(1)], pa.binary())], names=["doc_id", "set"])

    texts = docs.select("doc_id", "text").join(broadcast_if_bounded(ids), "doc_id", "left_semi")
    return texts.mapInArrow(releasing(sets), "doc_id long, set binary")


def verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""
    own = shingle_sets(docs, pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct(), words)
    up, down = similarity

    def confirmed(batches):
        for x in batches:
            ok = []
            for s, t in zip(x.column(2), x.column(3)):
                s, t = (np.frombuffer(v.as_buffer(), U) for v in (s, t))
                shared = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(down * shared >= up * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([x.column(0).filter(pa.array(ok, pa.bool_())), x.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    a, b = own.select(F.col("doc_id").alias("a"), F.col("set").alias("s")), own.select(F.col("doc_id").alias("b"), F.col("set").alias("t"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "s", "t").mapInArrow(releasing(confirmed), "a long, b long")


def met_blocks(buckets: DataFrame, classes: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """``(band, k, m, stray, rep, component, signature)``: the blocks of the buckets that still hold several components.

    ``k`` numbers parts of a bucket's strays, the members outside the component of
    its smallest one, and ``m`` parts of all its members. Of buckets with the same
    members one is taken.
    """
    labelled = buckets.join(labels, "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    told = [F.bit_xor(F.xxhash64(F.lit(i), "rep")).alias(f"h{i}") for i in (1, 2)]
    mixed_up = labelled.groupBy("band").agg(F.min_by("component", "rep").alias("main"), F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), *told).where("x <> y")
    mixed_up = mixed_up.groupBy("n", "x", "y", "h1", "h2").agg(F.min("band").alias("band"), F.min_by("main", "band").alias("main"))
    members = labelled.join(mixed_up.select("band", "main", "n"), "band")
    strays = members.where("component <> main").groupBy("band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = members.join(strays, "band").withColumn("slices", F.ceil(F.col("n") / (4 * block)).cast("int"))
    as_stray = members.where("component <> main").withColumn("k", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("blocks")).cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    as_all = members.withColumn("m", F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("slices")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["band", "k", "m", "rep", "component"]
    met = as_stray.select(*cols, F.lit(True).alias("stray")).unionAll(as_all.select(*cols, F.lit(False)))
    return met.join(classes.select(F.col("doc_id").alias("rep"), "signature"), "rep").select("band", "k", "m", "stray", "rep", "component", "signature")


BLOCK_ROW = "band long, k int, m int, stray boolean, rep long, component long, signature binary"


def surviving_members(met: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The members of each block that are left a candidate in it, as a stray or as any member."""

    def alive(t: pa.Table) -> pa.Table:
        stray, comp, sig = t["stray"].to_numpy(), t["component"].to_numpy(), _bytes_matrix(t["signature"])
        rows, keep = np.flatnonzero(~stray), np.zeros(len(stray), bool)
        for i in np.flatnonzero(stray).tolist():
            other = rows[comp[rows] != comp[i]]
            other = other[survives(np.broadcast_to(sig[i], (len(other), sig.shape[1])), sig[other], threshold, miss)]
            keep[other] = True
            keep[i] = len(other) > 0
        return t.filter(pa.array(keep))

    return met.groupBy("band", "k", "m").applyInArrow(alive, BLOCK_ROW)


def uniting_links(alive: DataFrame, sets: DataFrame, similarity: tuple[int, int], miss: float) -> DataFrame:
    """Links ``(a, b)`` verified inside the blocks, one for each two components that a block unites."""
    up, down = similarity

    def confirmed(t: pa.Table) -> pa.Table:
        stray, rep, comp, sig = t["stray"].to_numpy(), t["rep"].to_numpy(), t["component"].to_numpy().copy(), _bytes_matrix(t["signature"])
        sets = [np.frombuffer(x.as_buffer(), U) for x in t["set"]]
        size = np.array(list(map(len, sets)), np.int64)
        at = np.cumsum(np.r_[0, size])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        marked, rows, a, b = np.zeros(int(ids.max()) + 1, np.int32), np.flatnonzero(~stray), [], []
        del sets
        for i in np.flatnonzero(stray).tolist():
            other = rows[comp[rows] != comp[i]]
            other = other[down * np.minimum(size[other], size[i]) >= up * np.maximum(size[other], size[i])]
            other = other[survives(np.broadcast_to(sig[i], (len(other), sig.shape[1])), sig[other], up / down, miss)]
            if not len(other):
                continue
            own = ids[at[i] : at[i + 1]]
            marked[own] = 1
            begins = np.cumsum(np.r_[0, size[other][:-1]])
            shared = np.add.reduceat(marked[ids[np.repeat(at[other], size[other]) + _inner(size[other])]], begins)
            marked[own] = 0
            hits = other[down * shared >= up * (size[i] + size[other] - shared)]
            found, first = np.unique(comp[hits], return_index=True)
            a += [rep[i]] * len(found)
            b += rep[hits[first]].tolist()
            comp[np.isin(comp, found)] = comp[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    joined = alive.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    return joined.groupBy("band", "k", "m").applyInArrow(confirmed, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY, miss: float = MISS, block: int = BLOCK, seed: int = 29) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs (doc_id, text)``.

    Components are those of the graph that links documents whose sets of
    ``words``-word shingles, with ASCII letters in lower case, have a Jaccard
    similarity of at least ``similarity``. Texts without words, null ones too, link
    with nothing; a row without id has no component and isn't kept. Rows with one
    id are one document.
    """
    threshold = similarity[0] / similarity[1]
    docs = docs.select("doc_id", "text")
    rows = scratch.keep(sketches(docs, words, seed), "sketches")
    sets = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    reps = scratch.keep(sets.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "reps")
    classes = sets.join(reps, "set_key").where("doc_id = rep").select("doc_id", "signature", "bands").dropDuplicates(["doc_id", "signature"])
    classes = scratch.keep(classes, "classes")
    buckets = classes.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last").select("band", "first")
    buckets = scratch.keep(buckets.join(shared, "band"), "buckets")
    # two partners for each class: the smallest, and the one it shares most bands with
    counts = buckets.where("rep <> first").groupBy("rep", "first").count()
    best = counts.groupBy("rep").agg(F.min("first").alias("x"), F.max_by("first", F.struct("count", -F.col("first"))).alias("y"))
    pairs = best.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), F.col("rep").alias("b"))
    a, b = classes.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa")), classes.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"))
    pairs = scratch.keep(sequential(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), threshold, miss), "pairs")
    links = scratch.keep(verified(pairs, docs, words, similarity), "links")
    labels = scratch.keep(components(links, scratch, "near").withColumnRenamed("id", "rep"), "labels")
    alive = scratch.keep(surviving_members(met_blocks(buckets.select("band", "rep"), classes, labels, block), threshold, miss), "alive")
    if not alive.isEmpty():
        sets = shingle_sets(docs, alive.select(F.col("rep").alias("doc_id")).distinct(), words)
        more = scratch.keep(uniting_links(alive, sets.dropDuplicates(["doc_id", "set"]), similarity, miss), "more")
        labels = scratch.keep(components(links.unionAll(more), scratch, "all").withColumnRenamed("id", "rep"), "labels-2")
    scratch.drop("classes", "buckets", "pairs", "links", "alive", "more")
    found = reps.join(labels, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents`` by two-word shingles at 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "minhash"), words=2)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP5_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, hash(case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end) as t
      from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, c) as (select doc_id, doc_id from d union select r.doc_id, e.b from r join e on e.a = r.c),
m as (select doc_id, min(c) as c from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, m.c = d.doc_id as kept
from d join m using (doc_id) left join n using (doc_id)
"""
