"""Substring dedup by prefix-partitioned suffix trees over words.

Of all suffixes only those are looked at that begin in the reach of a repeated
anchor. They are split into memory-sized groups by prefixes of the anchor, of
varying length: a prefix that too many share is prolonged by further words, so
frequent openings are spread and rare ones stay together. Every group builds its
subtrees: it names the suffixes' prefixes of 1, 2, 4, 8 and 16 words, sorts the
suffixes by these names, and takes the common prefixes of neighbours. Inner nodes
at least ``length`` words deep are the maximal repeats, and the documents below one
other than its first lose the words it covers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .fragments import BASE, BYTE_VALUES, CHUNK_BYTES, Chunk, Kind, Rolling, U, mixed, remove_repeats

WINDOW_WORDS = 13
ANCHOR_WORDS = 6
#: Words whose hashes are made at once.
HASHED_WORDS = 1 << 16
#: Prefix lengths that a group can have, short of the whole anchor.
PREFIXES = (1, 2, 4)
#: Counters of anchors for each prefix length.
COUNTERS = 1 << 14
#: A prefix is prolonged if it has more than this share of a mean group.
SHARE = 0.25
#: Lengths of prefixes that are named; their sum bounds the common prefixes that are told apart.
NAMED = (1, 2, 4, 8, 16)

WHITE = re.compile(rb"[\t-\r ]")


def word_pieces(raw: bytes, length: int):
    """``(place of the first word, words joined by one space)``; pieces share ``length - 1`` words."""
    at, place, carry = 0, 0, []
    while at < len(raw):
        white = WHITE.search(raw, at + CHUNK_BYTES)
        end = white.start() if white else len(raw)
        words = carry + raw[at:end].split()
        yield place, b" ".join(words)
        carry = words[len(words) - min(len(words), length - 1) :]
        place += len(words) - len(carry)
        at = end


def edges(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a buffer start and end; one space stands between them."""
    if not buffer:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
    return np.r_[0, gaps + 1], np.r_[gaps, len(buffer)]


def word_units(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = edges(buffer)
    raw, values = np.frombuffer(buffer, np.uint8), [np.zeros(0, U)]
    for i in range(0, len(starts), HASHED_WORDS):
        a, b = starts[i : i + HASHED_WORDS], ends[i : i + HASHED_WORDS]
        values.append(Rolling(BYTE_VALUES[raw[a[0] : b[-1]]], BASE).between(a - a[0], b - a[0]))
    return np.concatenate(values), starts, ends


def prefix_sketch(chunk: Chunk) -> np.ndarray:
    """How many anchors begin with a prefix, by its length and hash."""
    at = chunk.windows[chunk.grams[chunk.windows] == chunk.anchors]
    return np.stack([np.bincount((chunk.roll.runs(at, n) >> U(50)).astype(np.int64), minlength=COUNTERS) for n in PREFIXES])


def prefix_plan(totals, groups: int) -> np.ndarray:
    """Which prefixes, by length and hash, are too frequent to be a group's."""
    if totals is None:
        return np.zeros((len(PREFIXES), COUNTERS), bool)
    mean = totals.sum(axis=1, keepdims=True) / groups
    return totals > np.maximum(SHARE * mean, 2.0 * totals.sum(axis=1, keepdims=True) / COUNTERS)


def prefix_of(chunk: Chunk, begins: np.ndarray, anchors: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """The shortest prefix of each anchor that isn't too frequent, as a number."""
    at = chunk.anchor_places(begins, anchors)
    key = mixed(anchors + U(len(PREFIXES)))
    open_ = np.ones(len(at), bool)
    for i, n in enumerate(PREFIXES):
        if n >= chunk.kind.gram:
            break
        h = chunk.roll.runs(at, n)
        ends = open_ & ~plan[i][(h >> U(50)).astype(np.int64)]
        key[ends] = mixed(h[ends] + U(i))
        open_ &= ~ends
    return key


class Names:
    """Numbers for the prefixes of all suffixes of a sequence of words, in the order of the prefixes.

    Equal prefixes have equal names. The words' own order is that of their first
    occurrence, as good as any other for a tree.
    """

    def __init__(self, buffer: bytes):
        starts, _ = edges(buffer)
        data = buffer + b" "  # every word with the space behind it
        offsets = np.r_[starts, len(data)] if len(starts) else np.zeros(1, np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        self.n = len(words)
        self.of = {1: words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1}
        for n in NAMED[1:]:
            half = self.of[n // 2]
            ahead = np.zeros_like(half)
            ahead[: max(0, self.n - n // 2)] = half[n // 2 :]
            self.of[n] = np.unique(half * (self.n + 2) + ahead, return_inverse=True)[1] + 1

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The lengths of the common prefixes of suffixes, up to the sum of the named lengths."""
        out = np.zeros(len(x), np.int64)
        for n in reversed(NAMED):
            inside = np.maximum(x, y) + out < self.n
            same = np.zeros(len(x), bool)
            i = np.flatnonzero(inside)
            same[i] = self.of[n][x[i] + out[i]] == self.of[n][y[i] + out[i]]
            out += n * same
        return np.minimum(out, self.n - np.maximum(x, y))


def subtrees(buffer: bytes, suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subtrees below the inner nodes that are at least ``depth`` words deep and whose parents aren't.

    Returns the order of the suffixes, for each its subtree's number, and for
    each subtree the depth of its topmost node: the length of the maximal repeat
    (0 for a leaf that stands alone), as far as lengths are told apart.
    """
    names = Names(buffer)
    order = np.argsort(names.of[16][suffixes], kind="stable")
    sorted_ = suffixes[order]
    common = names.common(sorted_[:-1], sorted_[1:])
    node = np.cumsum(np.r_[0, common < depth]) if len(order) else np.zeros(0, np.int64)
    deep = np.full(int(node[-1]) + 1 if len(node) else 0, np.iinfo(np.int64).max)
    inner = common >= depth
    np.minimum.at(deep, node[1:][inner], common[inner])
    deep[deep == np.iinfo(np.int64).max] = 0
    return order, node, deep


def word_classes(length: int):
    def classes(buffer: bytes, units, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, node, _ = subtrees(buffer, starts, length)
        return order, node

    return classes


def cut_words(text: str | None, starts: np.ndarray, ends: np.ndarray) -> tuple:
    words = (text or "").encode().split()
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


def repeats(length: int = WINDOW_WORDS, gram: int = ANCHOR_WORDS) -> Kind:
    if not 1 <= length <= sum(NAMED):
        raise ValueError(f"windows must have 1 to {sum(NAMED)} words")
    return Kind(length, min(gram, length), word_pieces, word_units, b" ", prefix_of, word_classes(length), later=False)


def remove_repeated_words(docs: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """``docs (doc_id, text, …)`` with ``n_words``, ``n_removed`` and ``kept``.

    Words are what stands between ASCII white space. A window is ``length`` words
    of one document; every word goes that a window covers which also starts in a
    document with a smaller id, all windows being those of the input. ``kept`` is
    the rest, joined by single spaces. Null texts have no words; a row without id
    keeps all its words and takes none from others; rows with one id don't take
    words from each other. Columns with the names made here are replaced.
    """
    return remove_repeats(docs, repeats(length), cut_words, "n_words long, n_removed long, kept string", prefix_sketch, prefix_plan)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated 13-word passages of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_words(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 11)) as s from d where len(w) >= 13),
k as (select doc_id, s, array_to_string(w[s : s + 12], ' ') as t from p),
f as (select t, min(doc_id) as first from k group by t),
g as (select distinct doc_id, unnest(range(s, s + 13)) as i from k join f using (t) where f.first < k.doc_id),
u as (select doc_id, w[i] as word, i from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
r as (select u.doc_id, count(*) as kept, string_agg(u.word, ' ' order by u.i) as t from u anti join g on g.doc_id = u.doc_id and g.i = u.i group by u.doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(r.kept, 0) as bigint) as n_removed, sha256(coalesce(r.t, '')) as kept_sha256
from d left join r using (doc_id)
"""
