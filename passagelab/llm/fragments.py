"""Repeated windows of fixed length: what both substring operators share.

A window is ``length`` consecutive units (words or bytes) of one document. Its
anchor is the smallest hash among the runs of ``gram`` units in it; equal windows
have equal anchors. So a window can only occur twice if its anchor does.

One pass over the texts notes which anchors occur twice, in a bitmap of fixed
size. A second pass looks at the windows whose anchor is marked: of those that a
chunk of documents holds more than once only the first is sent on, in stretches of
windows with one anchor, to the group of that anchor, where it meets those of
other chunks. However often a passage is repeated, a task sends it once. The bitmap
and the hashes decide only what is looked at: a window is removed because its
bytes, or in a group its place in a sorted order, equal an earlier window's. A
third pass takes the removed spans to the texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, releasing, replacing, text_bytes

#: Bytes of text that are hashed at once; longer texts are looked at in pieces that overlap.
CHUNK_BYTES = 1 << 19
#: Bits of the anchor bitmap as a power of two: 16 MB, whatever the input.
BITMAP_BITS = 27
#: Bits of an anchor that are compared when anchors are counted.
ANCHOR_BITS = 40
#: Bytes of input text for each group, each bucket and each shuffle task.
GROUP_BYTES, BUCKET_BYTES, TASK_BYTES = 4 << 20, 8 << 20, 64 << 20
#: Bytes a task holds for the groups before it hands them on.
HELD_BYTES = 24 << 20
#: Bytes of sent stretches that a task remembers, in each of two generations.
KNOWN_BYTES = 16 << 20
#: Row keys are numbers below this; they tell rows with one id apart.
ROW_KEYS = 1 << 32
#: Columns of the run itself; no column of the input can be named so by chance.
ROW, BUCKET = "_fragments_row", "_fragments_bucket"

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    z = y >> U(27)
    y ^= z
    y *= U(0x94D049BB133111EB)
    np.right_shift(y, U(31), out=z)
    y ^= z
    return y


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        out = np.full(n, b, U)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


class Rolling:
    """Hashes of any runs of units, from the units' own 64-bit values."""

    def __init__(self, values: np.ndarray, base: int):
        room = 1 << max(12, int(len(values)).bit_length())
        power, self.inverse = _powers(base, room)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def runs(self, starts: np.ndarray | None, length: int) -> np.ndarray:
        if starts is None:
            n = max(0, len(self.sums) - length)
            return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n])
        return mixed((self.sums[starts + length] - self.sums[starts]) * self.inverse[starts])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


BASE = 0x9E3779B97F4A7C15
BYTE_VALUES = mixed(np.arange(1, 257, dtype=U) * U(0x632BE59BD9B4E019))


def window_hashes(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at ascending ``starts``, a slice of the values at a time."""
    cuts = np.searchsorted(starts, np.arange(0, len(values) + CHUNK_BYTES, CHUNK_BYTES))
    found = [np.zeros(0, U)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            at = i * CHUNK_BYTES
            found.append(Rolling(values[at : at + CHUNK_BYTES + length], BASE).runs(starts[a:b] - at, length))
    return np.concatenate(found)


def sliding_minima(g: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    padded = np.full(-(-len(g) // width) * width, ~U(0))
    padded[: len(g)] = g
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def run_starts(ids: np.ndarray, *changes: np.ndarray) -> np.ndarray:
    """Where, among ascending positions, a run of neighbours with equal values begins."""
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1] + 1
    for c in changes:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs; spans that touch are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    at = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[at], reach[np.r_[at[1:], len(starts)] - 1]


class Known:
    """Stretches that a task has sent, each with where it was first, in two generations of bounded size."""

    def __init__(self, later: bool):
        self.later, self.young, self.old, self.size = later, {}, {}, 0

    def earlier(self, stretch: bytes, doc: int, place: int) -> bool:
        """Whether the same bytes were sent for an earlier start; if not, they are now."""
        at = self.young.get(stretch)
        if at is None:
            at = self.old.get(stretch)
            if at is not None:
                self._enter(stretch, at)
        if at is not None and (at[0] < doc or self.later and at[0] == doc and at[1] < place):
            return True
        if at is None or (doc, place) < at:
            self._enter(stretch, (doc, place))
        return False

    def _enter(self, stretch: bytes, at: tuple[int, int]) -> None:
        if self.size > KNOWN_BYTES:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[stretch] = at
        self.size += len(stretch) + 250


def pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def unpack(x: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


@dataclass(frozen=True)
class Kind:
    """What the windows consist of and how those that are sent are compared.

    ``pieces(raw, length)`` cuts a text into ``(place, units)`` of bounded size
    that share ``length - 1`` units; ``units(buffer)`` gives the values of a buffer's
    units and, if they aren't bytes, where they start and end; ``joint`` stands
    between two of them. ``route(chunk, begins, anchors, plan)`` gives the number
    that a stretch is grouped by, a function of its anchor's text. ``classes(buffer,
    units, starts)`` sorts windows and returns their order and, along it, the number
    of each one's class. ``later`` tells whether a later start in the same document
    counts. Stretches are laid out so that their anchors stand at multiples of
    ``align``; equal windows then differ by a multiple of it.
    """

    length: int
    gram: int
    pieces: Callable
    units: Callable
    joint: bytes
    route: Callable
    classes: Callable
    later: bool
    align: int = 1


class Chunk:
    """The units of some pieces of documents, ``(doc_id, row, place, units)`` in ascending order."""

    def __init__(self, kind: Kind, rows: list[tuple[int, int, int, bytes]]):
        self.kind = kind
        self.ids, self.keys, self.base = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        texts = [r[3] for r in rows]
        self.buffer = kind.joint.join([t for t in texts if t])
        values, self.unit_starts, self.unit_ends = kind.units(self.buffer)
        if kind.joint:
            counts = np.array([t.count(kind.joint) + 1 if t else 0 for t in texts], np.int64)
        else:
            counts = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.r_[0, np.cumsum(counts)]
        self.roll = Rolling(values, BASE)
        n = len(values)
        self.piece = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        valid = np.zeros(n, bool)
        if n >= kind.length:
            valid[: n - kind.length + 1] = self.piece[: n - kind.length + 1] == self.piece[kind.length - 1 :]
        self.windows = np.flatnonzero(valid)
        self.grams = self.roll.runs(None, kind.gram)
        self.anchors = sliding_minima(self.grams, kind.length - kind.gram + 1)[self.windows]

    def anchor_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of neighbouring windows with one anchor: where they begin, and the scrambled anchor."""
        at = run_starts(self.windows, self.anchors, self.piece[self.windows])
        return at, mixed(self.anchors[at] + U(1))

    def anchors_again(self) -> np.ndarray:
        """Scrambled anchors that return within their run: of windows that begin with theirs and whose next has it, too."""
        next_too = np.zeros(len(self.windows), bool)
        next_too[:-1] = (self.windows[1:] == self.windows[:-1] + 1) & (self.anchors[1:] == self.anchors[:-1])
        return mixed(self.anchors[(self.grams[self.windows] == self.anchors) & next_too] + U(1))

    def anchor_places(self, begins: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Where in the windows at ``begins`` their anchor stands first."""
        out = begins.copy()
        for _ in range(self.kind.length - self.kind.gram):
            out += self.grams[out] != anchors
        return out

    def places(self, starts: np.ndarray) -> np.ndarray:
        """Starts of windows as places in their documents."""
        own = self.piece[starts]
        return starts - self.offsets[own] + self.base[own]

    def edges(self, starts: np.ndarray, count=1) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ``count`` windows from each start on cover."""
        ends = starts + (count + self.kind.length - 1)
        return (starts, ends) if self.unit_starts is None else (self.unit_starts[starts], self.unit_ends[ends - 1])

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which windows at ``x`` have the bytes of those at ``y``; of a run on both sides, those up to the first that hasn't.

        In such a run only the first windows are compared whole, the others by their last unit.
        """
        if not len(x):
            return np.zeros(0, bool)
        go_on = np.r_[False, (x[1:] == x[:-1] + 1) & (y[1:] == y[:-1] + 1)]
        (a, b), (c, d) = self.edges(x), self.edges(y)
        last = self.kind.length - 1
        if self.unit_starts is None:
            a, c = a + last * go_on, c + last * go_on
        else:
            a, c = np.where(go_on, self.unit_starts[x + last], a), np.where(go_on, self.unit_starts[y + last], c)
        bad = ~self.same_bytes(a, b, c, d)
        differs, heads = np.cumsum(bad), np.flatnonzero(~go_on)
        before = np.repeat(differs[heads] - bad[heads], np.diff(np.r_[heads, len(x)]))
        return differs == before

    def same_bytes(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Which stretches of the buffer from ``a`` to ``b`` equal those from ``c`` to ``d``."""
        size = b - a
        out = size == d - c
        live, at = np.flatnonzero(out), 0
        while len(live):
            beyond = np.maximum(at + 8 - size[live], 0).astype(U) * U(8)
            same = (self.eights[a[live] + at] ^ self.eights[c[live] + at]) << beyond == 0
            out[live[~same]] = False
            at += 8
            live = live[same & (size[live] > at)]
        return out

    @cached_property
    def eights(self) -> np.ndarray:
        return np.ndarray(len(self.buffer) + 1, "<u8", self.buffer + bytes(8), strides=(1,))


def _chunks(batches, kind: Kind):
    """Chunks of documents in the order of their ids. Equal rows are taken once; rows without id or text aren't."""
    held, size = {}, 0
    for b in batches:
        for d, k, t in zip(b.column("doc_id").to_pylist(), b.column(ROW).to_pylist(), b.column("text")):
            text = t.as_py()
            if d is None or not text:
                continue
            for at, units in kind.pieces(text.encode(), kind.length):
                held[d, k, at] = units
                size += len(units)
                if size >= CHUNK_BYTES:
                    yield Chunk(kind, [(*k, held[k]) for k in sorted(held)])
                    held, size = {}, 0
    if held:
        yield Chunk(kind, [(*k, held[k]) for k in sorted(held)])


def anchor_bitmap(rows: DataFrame, kind: Kind, groups: int, sketch: Callable | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The bitmap of anchors that occur twice; and the sum of what ``sketch(chunk)`` gives."""
    bits = min(16, int(groups).bit_length())

    def noted(batches):
        anchors, totals = [], None
        for chunk in _chunks(batches, kind):
            anchors.append(np.r_[chunk.anchor_runs()[1], chunk.anchors_again()] >> U(64 - ANCHOR_BITS))
            if sketch is not None:
                s = sketch(chunk)
                totals = s if totals is None else totals + s
            del chunk
        if anchors:
            values, counts = np.unique(np.concatenate(anchors), return_counts=True)
            anchors.clear()
            cuts = np.searchsorted(values, np.arange((1 << bits) + 1, dtype=U) << U(ANCHOR_BITS - bits))
            found = [(g, pack((values[a], np.diff(values[a:b]).astype(np.uint32 if ANCHOR_BITS - bits <= 32 else U), np.packbits(counts[a:b] > 1)))) for g, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            if totals is not None:
                found.append((-1, pack(totals)))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], names=["grp", "payload"])

    def marked(t: pa.Table) -> pa.Table:
        g = t["grp"][0].as_py()
        if g < 0:
            parts = [unpack(x.as_py()) for x in t["payload"]]
            return pa.table({"grp": pa.array([g], pa.int32()), "payload": pa.array([pack(sum(parts[1:], parts[0]))], pa.binary())})
        values, twice = [], []
        for x in t["payload"]:
            first, rest, flags = unpack(x.as_py())
            values.append(np.cumsum(np.r_[first, rest.astype(U)]))
            twice.append(np.unpackbits(flags, count=len(rest) + 1))
        values, twice = np.concatenate(values), np.concatenate(twice)
        distinct, at, counts = np.unique(values, return_inverse=True, return_counts=True)
        again = (counts > 1) | (np.bincount(at, weights=twice, minlength=len(distinct)) > 0)
        slots = np.zeros(1 << (BITMAP_BITS - bits), np.uint8)
        slots[((distinct[again] >> U(ANCHOR_BITS - BITMAP_BITS)) & U(len(slots) - 1)).astype(np.int64)] = 1
        del values, twice, distinct, at, counts, again
        release()
        return pa.table({"grp": pa.array([g], pa.int32()), "payload": pa.array([pack(np.packbits(slots))], pa.binary())})

    result, totals = np.zeros((1 << BITMAP_BITS) // 8, np.uint8), None
    width = len(result) >> bits
    for g, p in rows.mapInArrow(releasing(noted), "grp int, payload binary").groupBy("grp").applyInArrow(marked, "grp int, payload binary").toLocalIterator():
        if g < 0:
            totals = unpack(bytes(p))
        else:
            result[g * width : (g + 1) * width] = unpack(bytes(p))
    return result, totals


def repeated_here(chunk: Chunk, starts: np.ndarray) -> np.ndarray:
    """Which windows have the bytes of an earlier one of the chunk."""
    hashes = chunk.roll.runs(starts, chunk.kind.length)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    lead = first[back]
    own, other = chunk.ids[chunk.piece[starts]], chunk.ids[chunk.piece[starts[lead]]]
    out = other < own
    if chunk.kind.later:
        place = chunk.places(starts)
        out |= (other == own) & (place[lead] < place)
    maybe = np.flatnonzero(out)
    out[maybe] = chunk.equal(starts[maybe], starts[lead[maybe]])
    return out


def removed_spans(rows: DataFrame, kind: Kind, bitmap: np.ndarray, plan, groups: int, buckets: int, tasks: int | None) -> DataFrame:
    """Rows (bucket, payload) of spans to remove; a payload holds doc ids, row keys, starts and ends."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((bitmap, plan))

    def settled(batches):
        marks, plan = shared.value
        spans: dict[int, list] = {}
        sent: dict[int, list] = {}
        size, known = 0, Known(kind.later)

        def flush():
            found = [(0, g, pack([np.concatenate(x) for x in zip(*p)])) for g, p in spans.items()]
            found += [(1, g, pack((*(np.concatenate(x) for x in list(zip(*p))[:5]), kind.joint.join([x[5] for x in p])))) for g, p in sent.items()]
            spans.clear(), sent.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found], pa.int32()), pa.array([g for _, g, _ in found], pa.int32()), pa.array([p for _, _, p in found], pa.binary())], names=["stage", "grp", "payload"])

        for chunk in _chunks(batches, kind):
            at, scrambled = chunk.anchor_runs()
            if not len(at):
                continue
            slot = scrambled >> U(64 - BITMAP_BITS)
            hit = (marks[(slot >> U(3)).astype(np.int64)] >> (U(7) - (slot & U(7))).astype(np.uint8)) & 1
            chosen = np.repeat(hit.astype(bool), np.diff(np.r_[at, len(chunk.windows)]))
            starts, anchors = chunk.windows[chosen], chunk.anchors[chosen]
            if not len(starts):
                continue
            # only windows whose anchor the chunk holds again can be repeated in it
            values, counts = np.unique(scrambled[hit.astype(bool)], return_counts=True)
            twice = np.union1d(values[counts > 1], chunk.anchors_again())
            again = np.repeat(np.isin(scrambled, twice, kind="sort"), np.diff(np.r_[at, len(chunk.windows)]))[chosen]
            gone = np.zeros(len(starts), bool)
            gone[again] = repeated_here(chunk, starts[again])
            removed = [(starts[gone], np.ones(int(gone.sum()), np.int64))]
            starts, anchors = starts[~gone], anchors[~gone]
            at = run_starts(starts, anchors, chunk.piece[starts])
            begins, anchors, count = starts[at], anchors[at], np.diff(np.r_[at, len(starts)])
            own, place = chunk.piece[begins], chunk.places(begins)
            ids, turn = chunk.ids[own], ((chunk.anchor_places(begins, anchors) - begins) % kind.align).astype(np.uint8)
            texts = [chunk.buffer[x:y] for x, y in zip(*(e.tolist() for e in chunk.edges(begins, count)))]
            before = np.fromiter(map(known.earlier, texts, ids.tolist(), place.tolist()), bool, len(texts))
            removed.append((begins[before], count[before]))
            group = (mixed(kind.route(chunk, begins, anchors, plan) + U(2)) % U(groups)).astype(np.int64)
            left = np.flatnonzero(~before)
            left = left[np.argsort(group[left], kind="stable")]
            cut = np.flatnonzero(np.r_[True, np.diff(group[left]) != 0, True]) if len(left) else []
            for x, y in zip(cut, cut[1:]):
                o = left[x:y]
                text = kind.joint.join([texts[i] for i in o.tolist()])
                sent.setdefault(int(group[o[0]]), []).append((ids[o], chunk.keys[own[o]].astype(np.uint32), place[o], count[o].astype(np.int32), turn[o], text))
                size += len(text) + 25 * len(o)
            for g, p in spans_by_bucket(chunk, *map(np.concatenate, zip(*removed)), buckets):
                spans.setdefault(g, []).append(p)
                size += sum(x.nbytes for x in p)
            del chunk
            if size >= HELD_BYTES:
                yield flush()
                size = 0
        if spans or sent:
            yield flush()

    def met(t: pa.Table) -> pa.Table:
        g = t["grp"][0].as_py()
        if t["stage"][0].as_py() == 0:
            joined = [np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in t["payload"]))]
            return pa.table({"bucket": pa.array([g], pa.int32()), "payload": pa.array([pack(joined)], pa.binary())})
        doc_ids, row_keys, starts = repeated_between(kind, [unpack(x.as_py()) for x in t["payload"]])
        order = np.lexsort((starts, row_keys, doc_ids))
        doc_ids, row_keys, starts = doc_ids[order], row_keys[order], starts[order]
        at = run_starts(starts, doc_ids, row_keys)
        ends = starts[np.r_[at[1:], len(starts)] - 1] + kind.length if len(starts) else starts
        doc_ids, row_keys, starts = doc_ids[at], row_keys[at], starts[at]
        bucket = np.mod(row_keys, buckets)
        found = [(int(g), pack([x[bucket == g] for x in (doc_ids, row_keys, starts, ends)])) for g in np.unique(bucket)]
        release()
        return pa.table({"bucket": pa.array([g for g, _ in found], pa.int32()), "payload": pa.array([p for _, p in found], pa.binary())})

    out = rows.mapInArrow(releasing(settled), "stage int, grp int, payload binary")
    if tasks:
        out = out.repartition(tasks, "stage", "grp")
    return out.groupBy("stage", "grp").applyInArrow(met, "bucket int, payload binary")


def repeated_between(kind: Kind, parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, row key and place of the windows of a group's stretches that an earlier one equals.

    Of whole stretches with equal bytes the first stands for the others. Windows
    whose hash no other has are left out before the rest is sorted.
    """
    ids, keys, places, counts, turns = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(5))
    buffer = kind.joint.join([p[5] for p in parts])
    parts.clear()
    none = np.zeros(0, np.int64)
    values, unit_starts, unit_ends = kind.units(buffer)
    tail = kind.length - 1
    base = np.cumsum(np.r_[0, counts[:-1] + tail])
    begin, end = base, base + counts + tail
    if unit_starts is not None:
        begin, end = unit_starts[begin], unit_ends[end - 1]
    first: dict[bytes, int] = {}
    whole = np.zeros(len(counts), bool)
    begin, end = begin.tolist(), end.tolist()
    for i in np.lexsort((places, ids)).tolist():
        j = first.setdefault(buffer[begin[i] : end[i]], i)
        whole[i] = j != i and (ids[j] < ids[i] or kind.later and places[j] < places[i])
    first.clear()
    found = [(np.repeat(ids[whole], counts[whole]), np.repeat(keys[whole], counts[whole]), np.repeat(places[whole], counts[whole]) + _inner(counts[whole]))]
    own = np.repeat(np.arange(len(counts)), np.where(whole, 0, counts))
    starts = base[own] + _inner(np.where(whole, 0, counts)) if len(own) else none
    hashes = window_hashes(values, starts, kind.length)
    order = np.argsort(hashes)
    same = np.r_[False, hashes[order[1:]] == hashes[order[:-1]], False]
    live = np.zeros(len(starts), bool)
    live[order] = same[1:] | same[:-1]
    del hashes, order, same, values
    if not live.any():
        return found[0]
    # the stretches that still matter, behind each other
    inner, own = (starts - base[own])[live], own[live]
    keep = np.unique(own)
    begin, end = np.array(begin)[keep], np.array(end)[keep]
    size = counts[keep] + tail
    turn, step = turns[keep], -(-(size[:-1] - turns[keep][:-1] + turns[keep][1:]) // kind.align) * kind.align
    moved = np.zeros(len(counts), np.int64)
    moved[keep] = np.cumsum(np.r_[(turn[:1] + kind.align - 1) // kind.align * kind.align, step]) - turn
    if kind.align > 1:
        gap = moved[keep] - np.r_[0, (moved[keep] + size)[:-1]]
        buffer = b"".join([bytes(g) + buffer[x:y] for g, x, y in zip(gap.tolist(), begin.tolist(), end.tolist())])
    else:
        buffer = kind.joint.join([buffer[x:y] for x, y in zip(begin.tolist(), end.tolist())])
    order, node = kind.classes(buffer, kind.units(buffer), moved[own] + inner)
    own, inner = own[order], inner[order]
    doc, place = ids[own], places[own] + inner
    by = np.lexsort((place, doc, node))
    node, doc, place, own = node[by], doc[by], place[by], own[by]
    head = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    lead = np.repeat(head, np.diff(np.r_[head, len(node)]))
    gone = doc > doc[lead]
    if kind.later:
        gone |= (doc == doc[lead]) & (place > place[lead])
    found.append((doc[gone], keys[own[gone]], place[gone]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _inner(counts: np.ndarray) -> np.ndarray:
    """0, 1, … for each count, behind each other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def spans_by_bucket(chunk: Chunk, starts: np.ndarray, counts: np.ndarray, buckets: int):
    """Spans that runs of windows cover, by the bucket of their document."""
    if not len(starts):
        return
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], starts[order] + counts[order]
    piece = chunk.piece[starts]
    at = np.flatnonzero(np.r_[True, (starts[1:] != ends[:-1]) | (piece[1:] != piece[:-1])])
    piece, shift = piece[at], chunk.places(starts[at]) - starts[at]
    begins, ends = starts[at] + shift, ends[np.r_[at[1:], len(starts)] - 1] + shift + chunk.kind.length - 1
    keys = chunk.keys[piece]
    bucket = np.mod(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
    for a, b in zip(cut, cut[1:]):
        o = order[a:b]
        yield int(bucket[o[0]]), [chunk.ids[piece[o]], keys[o], begins[o], ends[o]]


def parts_for(total: int, each: int) -> int:
    """A power of two, 32 at least, of parts with about ``each`` bytes of text."""
    return 1 << max(5, (max(0, total) // each).bit_length())


def without_spans(keyed: DataFrame, spans: DataFrame, cut: Callable, out: str, tasks: int | None) -> DataFrame:
    """``keyed`` with what ``cut(text, starts, ends)`` makes of each text and its spans.

    Documents and spans meet in buckets by row key, some MB of text each.
    """
    named = [c for c in keyed.columns if c not in (ROW, BUCKET)]

    def applied(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[tuple, list] = {}
        for x in right["payload"]:
            ids, keys, starts, ends = unpack(x.as_py())
            new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]) if len(ids) else np.zeros(0, int)
            for a, b in zip(new, [*new[1:], len(ids)]):
                found.setdefault((int(ids[a]), int(keys[a])), []).append((starts[a:b], ends[a:b]))
        none = np.zeros(0, np.int64)
        made = []
        for d, k, t in zip(left["doc_id"].to_pylist(), left[ROW].to_pylist(), left["text"]):
            own = found.get((d, k), ())
            made.append(cut(t.as_py(), *merged(np.concatenate([none, *(s for s, _ in own)]), np.concatenate([none, *(e for _, e in own)]))))
        cols = {c: left[c] for c in named}
        for i, name in enumerate(names):
            cols[name] = pa.array([m[i] for m in made], types[i])
        found.clear(), made.clear()
        release()
        return pa.table(cols)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    made_fields = _parse_datatype_string(f"struct<{out}>").fields
    names, types = [f.name for f in made_fields], [to_arrow_type(f.dataType) for f in made_fields]
    result = StructType([*keyed.select(*named).schema.fields, *made_fields])
    spans = spans.withColumnRenamed("bucket", BUCKET)
    if tasks:
        keyed, spans = keyed.repartition(tasks, BUCKET), spans.repartition(tasks, BUCKET)
    return keyed.groupBy(BUCKET).cogroup(spans.groupBy(BUCKET)).applyInArrow(applied, result)


def remove_repeats(docs: DataFrame, kind: Kind, cut: Callable, out: str, sketch: Callable | None = None, planned: Callable | None = None) -> DataFrame:
    """``docs`` with what ``cut`` makes of each text without its repeated windows.

    A column of ``docs`` that is named like one made here is replaced.
    """
    docs = replacing(docs, *(x.split()[0] for x in out.split(",")))
    total = text_bytes(docs, "text")
    groups, buckets = parts_for(total, GROUP_BYTES), parts_for(total, BUCKET_BYTES)
    # as many tasks as the bytes ask for, where the session's setting has fewer
    tasks = min(total // TASK_BYTES, 1 << 17)
    tasks = tasks if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    keyed = docs.withColumn(ROW, F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROW_KEYS)))
    rows = keyed.select("doc_id", ROW, "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    bitmap, totals = anchor_bitmap(rows, kind, groups, sketch)
    spans = removed_spans(rows, kind, bitmap, planned(totals, groups) if planned else None, groups, buckets, tasks)
    return without_spans(keyed.withColumn(BUCKET, F.pmod(ROW, F.lit(buckets)).cast("int")), spans, cut, out, tasks)
