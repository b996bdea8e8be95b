"""Suffix-array dedup of byte strings, built blockwise with a difference cover.

Texts are cut into the stretches that hold repeated anchors, and each group of
stretches gets its own suffix array over the places where a window begins. They
are sorted one bucket of first bytes at a time, by no more than 64 bytes. Ties are
not compared on: any two places have a distance, below the cover's period, at which
both are in the cover, and there ranks of the cover's places, computed once, decide.
(Stretches are laid out with their anchors at multiples of the period, so most ties
have one such distance, and a sort by ranks does.) So a bucket needs memory for its own suffixes only, and the ranks take a place for
each of six in 31 bytes, however long the repeats are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .fragments import BYTE_VALUES, CHUNK_BYTES, Chunk, Kind, U, _inner, remove_repeats

WINDOW_BYTES = 100
ANCHOR_BYTES = 32
#: A perfect difference set: every distance modulo the period lies between two of its members.
COVER = (0, 1, 3, 8, 12, 18)
PERIOD = 31
#: Suffixes that are sorted at once.
BLOCK_SUFFIXES = 1 << 18
#: Ties of at most this many suffixes are resolved pair by pair, larger ones by residues.
FEW = 16


def shifts() -> np.ndarray:
    """For two residues, the smallest distance that takes both into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if inside[(a + d) % PERIOD] and inside[(b + d) % PERIOD])
    return out


SHIFTS = shifts()
SLOT = np.zeros(PERIOD, np.int64)
SLOT[list(COVER)] = np.arange(len(COVER))


class Text:
    """Bytes behind each other, padded; and every eight of them as a big-endian number."""

    def __init__(self, raw: bytes, depth: int):
        self.n = len(raw)
        eights = np.frombuffer(raw + bytes(2 * depth + 4 * PERIOD + 16), np.uint8).astype(U)
        for width in (1, 2, 4):
            eights = (eights[:-width] << U(8 * width)) | eights[width:]
        self.eights = eights

    def key(self, at: np.ndarray) -> np.ndarray:
        return self.eights[at]


class CoverRanks:
    """Ranks of the cover's places by at least their next ``depth`` bytes; nothing is kept for others."""

    def __init__(self, text: Text, depth: int):
        places = np.add.outer(np.arange(0, text.n + PERIOD, PERIOD), COVER).ravel()
        levels = [text.key(places + d) for d in (0, 8, 16, PERIOD - 8)]
        by = np.lexsort(levels[::-1])
        new = np.zeros(len(by), bool)
        for level in levels:
            level = level[by]
            new[1:] |= level[1:] != level[:-1]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new) + 1
        known = PERIOD
        while known < depth:
            # a place this much further on is in the cover as well
            step = known // PERIOD * len(COVER)
            ahead = np.zeros_like(rank)
            ahead[: max(0, len(rank) - step)] = rank[step:]
            rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1] + 1
            known *= 2
        self.rank = rank.astype(np.int32)

    def of(self, places: np.ndarray) -> np.ndarray:
        return self.rank[places // PERIOD * len(COVER) + SLOT[places % PERIOD]].astype(np.int64)


def mixed_ties(order: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Which suffixes are in a tie whose places have several residues."""
    if not len(order):
        return np.zeros(0, bool)
    at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    residue = order % PERIOD
    return np.repeat(np.minimum.reduceat(residue, at) != np.maximum.reduceat(residue, at), np.diff(np.r_[at, len(order)]))


def refined(order: np.ndarray, node: np.ndarray, text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Ties of several residues, sorted further by bytes 32 to 64, which parts most of them by residue."""
    for d in range(32, 64, 8):
        open_ = np.flatnonzero(mixed_ties(order, node))
        if not len(open_):
            break
        key = text.key(order[open_] + d)
        by = np.lexsort((key, node[open_]))
        order = order.copy()
        order[open_], key = order[open_][by], key[by]
        more = np.zeros(len(order), bool)
        more[open_[1:]] = (node[open_[1:]] == node[open_[:-1]]) & (key[1:] != key[:-1])
        node = node + np.cumsum(more)
    return order, node


def tied_by_cover(order: np.ndarray, node: np.ndarray, ranks: CoverRanks) -> np.ndarray:
    """``order`` with its ties ``node`` sorted by the ranks of the cover.

    A tie whose places have one residue is sorted by its ranks at their one distance
    into the cover. In others the smaller ones of the tie are counted for each
    suffix: in small ties pair by pair; in large ones for two residues at a time,
    which share one distance, by sorting and searching.
    """
    size = np.bincount(node)
    tied = np.flatnonzero(size[node] > 1)
    if not len(tied):
        return order
    m, x = node[tied], order[tied]
    at = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    count = np.diff(np.r_[at, len(tied)])
    residue = x % PERIOD
    alike = ~mixed_ties(x, m)
    by = np.zeros(len(tied), np.int64)
    one = x[alike]
    by[alike] = ranks.of(one + SHIFTS[residue[alike], residue[alike]])
    count = np.repeat(count, count)
    few = np.flatnonzero(~alike & (count <= FEW))
    if len(few):
        at = np.flatnonzero(np.r_[True, m[few][1:] != m[few][:-1]])
        each, first = count[few], np.repeat(at, count[few][at])
        mine = np.repeat(np.arange(len(few)), each)
        other = _inner(each) + np.repeat(first, each)
        p, q = x[few[mine]], x[few[other]]
        d = SHIFTS[p % PERIOD, q % PERIOD]
        by[few] = np.bincount(mine, weights=ranks.of(q + d) < ranks.of(p + d), minlength=len(few))
    many = np.flatnonzero(~alike & (count > FEW))
    if len(many):
        p, base = x[many], m[many] * (int(ranks.rank.max()) + 2)
        parts = [(r, np.flatnonzero(residue[many] == r)) for r in np.unique(residue[many]).tolist()]
        found = np.zeros(len(many), np.int64)
        for a, i in parts:
            for b, j in parts:
                d = SHIFTS[a, b]
                there = np.sort(base[j] + ranks.of(p[j] + d))
                found[i] += np.searchsorted(there, base[i] + ranks.of(p[i] + d)) - np.searchsorted(there, base[i])
        by[many] = found
    out = order.copy()
    out[tied] = x[np.lexsort((by, m))]
    return out


def window_classes(raw: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array over ``starts`` as an order of them, and along it the number of each window's class.

    Windows of one class have the same ``length`` bytes; they are neighbours, as
    the ranks reach at least that far.
    """
    text = Text(raw, length)
    ranks = CoverRanks(text, length)
    places = starts[np.argsort(text.key(starts), kind="stable")]
    first = text.key(places)
    done, classes, number, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    while at < len(places):
        end = min(at + BLOCK_SUFFIXES, len(places))
        while end < len(places) and first[end] == first[end - 1]:
            end += 1
        block = places[at:end]
        levels = [first[at:end], *(text.key(block + d) for d in (8, 16, 24))]
        by = np.lexsort(levels[::-1])
        new = np.zeros(len(by), bool)
        for level in levels:
            level = level[by]
            new[1:] |= level[1:] != level[:-1]
        block, node = refined(block[by], np.cumsum(new), text)
        block = tied_by_cover(block, node, ranks)
        # neighbours of one tie share 32 bytes; their common prefix may still be short of the window
        near = np.flatnonzero(node[1:] == node[:-1])
        for d in range(32, length, 8):
            a, b = text.key(block[near] + d), text.key(block[near + 1] + d)
            if d + 8 > length:
                a, b = a >> U(8 * (d + 8 - length)), b >> U(8 * (d + 8 - length))
            near = near[a == b]
        new = np.ones(len(block), bool)
        new[near + 1] = False
        classes.append(np.cumsum(new) + number)
        number = int(classes[-1][-1])
        done.append(block)
        at = end
    index = np.zeros(text.n + 1, np.int32)
    index[starts] = np.arange(len(starts))
    return index[np.concatenate(done)].astype(np.int64), np.concatenate(classes)


def byte_pieces(raw: bytes, length: int):
    """``(place, bytes)``; pieces share ``length - 1`` bytes."""
    for at in range(0, max(1, len(raw) - length + 1), CHUNK_BYTES):
        yield at, raw[at : at + CHUNK_BYTES + length - 1]


def byte_units(buffer: bytes) -> tuple:
    return BYTE_VALUES[np.frombuffer(buffer, np.uint8)], None, None


def anchor_of(chunk: Chunk, begins: np.ndarray, anchors: np.ndarray, plan) -> np.ndarray:
    return anchors


def cut_bytes(text: str | None, starts: np.ndarray, ends: np.ndarray) -> tuple:
    raw = (text or "").encode()
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept.append(raw[at:a])
        at = b
    kept = b"".join([*kept, raw[at:]])
    return len(raw), len(raw) - len(kept), len(starts), kept


def strings(length: int = WINDOW_BYTES, gram: int = ANCHOR_BYTES) -> Kind:
    if length < 40:
        raise ValueError("windows must be at least 40 bytes")
    return Kind(length, gram, byte_pieces, byte_units, b"", anchor_of, lambda buffer, units, starts: window_classes(buffer, starts, length), later=True, align=PERIOD)


def remove_repeated_bytes(docs: DataFrame, length: int = WINDOW_BYTES) -> DataFrame:
    """``docs (doc_id, text, …)`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``.

    Every byte of a UTF-8 text goes that is covered by a ``length``-byte string
    which also starts earlier: in a document with a smaller id, or before in the
    same one. ``kept`` is the rest as binary, as a cut may divide a character.
    Null texts are empty; a row without id keeps all and takes nothing from
    others; of rows with one id the earlier start counts. Columns with the names
    made here are replaced.
    """
    return remove_repeats(docs, strings(length), cut_bytes, "n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# long texts are cut into parts of 1000 bytes first, as a substring costs what is in front of it
OP9_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, k, substring(h, 2 * k + 1, 2 * 1099) as h from (select doc_id, h, unnest(range(0, cast(length(h) // 2 as bigint), 1000)) as k from d)),
w as (select doc_id, k + i as i, md5_number(substring(h, 2 * i + 1, 200)) as t
      from (select doc_id, k, h, unnest(range(0, least(1000, cast(length(h) // 2 as bigint) - 99))) as i from c where length(h) >= 200)),
f as (select t, min(struct_pack(doc_id := doc_id, i := i)) as first from w group by t having count(*) > 1),
g as (select w.doc_id, w.i from w join f using (t) where f.first.doc_id < w.doc_id or f.first.i < w.i),
k as (select distinct doc_id, unnest(range(i, i + 100)) as i from g),
s as (select doc_id, count(*) as n_removed, count(*) filter (p is null or p <> i - 1) as n_spans
      from (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from k) group by doc_id),
u as (select doc_id, k + i as i, substring(h, 2 * i + 1, 2) as b
      from (select c.doc_id, c.k, c.h, unnest(range(0, least(1000, cast(length(h) // 2 as bigint)))) as i from c semi join k on c.doc_id = k.doc_id)),
r as (select u.doc_id, string_agg(b, '' order by u.i) as h from u anti join k on k.doc_id = u.doc_id and k.i = u.i group by u.doc_id)
select d.doc_id, cast(length(d.h) // 2 as bigint) as n_bytes, coalesce(s.n_removed, 0) as n_removed, coalesce(s.n_spans, 0) as n_spans,
  sha256(unhex(case when s.doc_id is null then d.h else coalesce(r.h, '') end)) as kept_sha256
from d left join s using (doc_id) left join r using (doc_id)
"""
