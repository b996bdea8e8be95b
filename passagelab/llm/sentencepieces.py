"""SentencePiece encoding and decoding of whole texts.

A giant text is cut into chunks, which are rows dealt over tasks. Each chunk gives
its transfer matrix between boundary states; the matrices of a text are combined
associatively into the states on its edges, and each chunk is then traced back to
its ids between its two states, again in a task of its own.

For unigram models the states and matrices are those of :mod:`maxplus`. The rules
of a BPE model are merges in order, not a best path, so no matrix of path scores
gives the library's pieces. There chunk edges are moved to places that no merge can
cross (in front of a run of word marks, as no piece holds a mark after another
character): one boundary state is left, and the same machinery runs with matrices
of one entry. Other texts are encoded in the task that reads them, by the same chunks.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, releasing, replacing, table
from .maxplus import Pieces, backtrace, boundary_states, segment, transfer

#: Characters that are encoded at once, and the bytes from which on a text's chunks are dealt over tasks.
CHUNK_CHARS = 1 << 18
GIANT_BYTES = 1 << 21
#: Entries of each worker's cache, and the longest word that enters it.
CACHE_ENTRIES = 1 << 17
CACHE_CHARS = 64

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
UNIGRAM = 1


class Codec(dict):
    """Encoder and decoder of one model file; as a mapping, its cache from words to ids."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = model.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        shape = proto.normalizer_spec
        pieces = [p.piece for p in proto.pieces]
        self.plain = shape.name == "identity" and shape.add_dummy_prefix and not shape.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        self.apart = self.plain and proto.trainer_spec.model_type != UNIGRAM and not any(MARK in p.lstrip(MARK) for p in pieces) and not any(p.type == p.USER_DEFINED for p in proto.pieces)
        # the lattice knows normal pieces only; the library splits what it can't
        self.unigram = self.plain and proto.trainer_spec.model_type == UNIGRAM and all(p.type in (p.NORMAL, p.CONTROL, p.UNKNOWN) for p in proto.pieces)
        if self.unigram:
            self.lattice = Pieces({p.piece: p.score for p in proto.pieces if p.type == p.NORMAL})
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else b"" if p.type == p.CONTROL else " ⁇ ".encode() if p.type == p.UNKNOWN else p.piece.replace(MARK, " ").encode() for p in proto.pieces]

    def learn(self, words: set[str]) -> None:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        # a mark that ends the text; the library adds none to an empty text
        self[MARK] = np.array([self.library.piece_to_id(MARK)], "<i4").tobytes()
        new = [w for w in words if w not in self]
        for w, ids in zip(new, self.library.encode([w[1:].replace(MARK, " ") for w in new], num_threads=1)):
            self[w] = np.array(ids, "<i4").tobytes()

    def encode(self, text: str):
        """The ids of a text as little-endian bytes, a chunk at a time."""
        if not text:
            return
        if self.unigram:
            yield self.joined([self.ids_of(segment(MARK + text.replace(" ", MARK), self.lattice))])
        elif not self.apart:
            yield np.array(self.library.encode(text), "<i4").tobytes()
        else:
            for part, _ in self.chunks(text, CHUNK_CHARS):
                yield self.ids_of_words(part)

    def chunks(self, text: str, size: int):
        """Chunks of a marked text with the characters behind each that its pieces can reach."""
        marked, at = MARK + text.replace(" ", MARK), 0
        while at < len(marked):
            end = at + size
            while self.apart and end < len(marked) and not (marked[end] == MARK != marked[end - 1]):
                end += 1
            yield marked[at:end], marked[end : end + self.lattice.longest] if self.unigram else ""
            at = end

    def ids_of(self, pieces: list[str]) -> bytes:
        return np.array([self.library.piece_to_id(p) if p in self.lattice.scores else self.library.unk_id() for p in pieces], "<i4").tobytes()

    def ids_of_words(self, marked: str) -> bytes:
        words = WORDS.findall(marked)
        self.learn({w for w in words if len(w) <= CACHE_CHARS and w not in self})
        return b"".join([self.get(w) or np.array(self.library.encode(w[1:].replace(MARK, " ")), "<i4").tobytes() for w in words])

    def joined(self, parts: list[bytes]) -> bytes:
        """The ids of a text's chunks behind each other; the library gives one id for a run of unknown characters."""
        ids = np.frombuffer(b"".join(parts), "<i4")
        if not self.unigram or not len(ids):
            return ids.tobytes()
        unknown = ids == self.library.unk_id()
        return ids[~np.r_[False, unknown[1:] & unknown[:-1]]].tobytes()

    def matrix(self, chunk: str, ahead: str) -> np.ndarray:
        """The chunk's transfer between boundary states."""
        return transfer(chunk + ahead, 0, len(chunk), self.lattice) if self.unigram else np.zeros((1, 1))

    def traced(self, chunk: str, ahead: str, entry: int, leave: int) -> bytes:
        """The chunk's own ids between its two states."""
        return self.ids_of(backtrace(chunk + ahead, 0, len(chunk), entry, leave, self.lattice)) if self.unigram else self.ids_of_words(chunk)

    def decode(self, ids: bytes) -> str:
        """The text of ids; only the mark in front of the first word goes."""
        found = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return (found[1:] if found[:1] == b" " else found).decode("utf-8", "replace")


_workers: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec, made at its first use."""
    if path not in _workers:
        _workers[path] = Codec(path)
    return _workers[path]


KEY = "_sentencepiece_key"


def giant_ids(texts: DataFrame, path: str, scratch: Scratch, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``(key, ids)`` of ``texts (key, text)`` with distinct keys, chunk by chunk in tasks of their own; ids are bytes."""
    chunk_row = "key string, no int, chunk string, ahead string"

    def cut(batches):
        own = codec(path)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                parts = list(own.chunks(text, chunk_chars)) if own.apart or own.unigram else [(text, "")]
                for no, (chunk, ahead) in enumerate(parts):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([no], pa.int32()), pa.array([chunk]), pa.array([ahead])], names=["key", "no", "chunk", "ahead"])

    def matrices(batches):
        own = codec(path)
        for b in batches:
            m = [own.matrix(c, a) for c, a in zip(b.column("chunk").to_pylist(), b.column("ahead").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("no"), pa.array([x.tobytes() for x in m], pa.binary())], names=["key", "no", "matrix"])

    def states(t: pa.Table) -> pa.Table:
        t = t.sort_by("no")
        flat = [np.frombuffer(x.as_buffer()) for x in t["matrix"]]
        side = int(len(flat[0]) ** 0.5)
        edges = [*boundary_states([x.reshape(side, side) for x in flat]), 0][: len(flat) + 1]
        return pa.table({"key": t["key"], "no": t["no"], "entry": pa.array(edges[:-1], pa.int32()), "leave": pa.array(edges[1:], pa.int32())})

    def traced(batches):
        own = codec(path)
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("chunk", "ahead", "entry", "leave")))
            ids = [own.traced(*r) if own.apart or own.unigram else b"".join(own.encode(r[0])) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("no"), pa.array(ids, pa.binary())], names=["key", "no", "ids"])

    def whole(t: pa.Table) -> pa.Table:
        t = t.sort_by("no")
        return pa.table({"key": t["key"].slice(0, 1), "ids": pa.array([codec(path).joined(t["ids"].to_pylist())], pa.binary())})

    chunks = scratch.keep(texts.mapInArrow(cut, chunk_row).repartition("key", "no"), "chunks")
    edges = chunks.mapInArrow(matrices, "key string, no int, matrix binary").groupBy("key").applyInArrow(states, "key string, no int, entry int, leave int")
    ids = chunks.join(edges, ["key", "no"]).repartition("key", "no").mapInArrow(traced, "key string, no int, ids binary")
    return ids.groupBy("key").applyInArrow(whole, "key string, ids binary")


def coded(docs: DataFrame, path: str, text: str, fields: list[T.StructField], derive, giant_bytes: int = GIANT_BYTES, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` with the columns ``fields`` that ``derive(codec, ids, texts)`` makes of texts and their ids, as bytes.

    Columns of ``docs`` with these names are replaced.
    """
    docs = replacing(docs, *(f.name for f in fields))
    at, names = docs.columns.index(text), [f.name for f in fields]
    schema = T.StructType([*docs.schema.fields, *fields])

    def near(batches):
        own = codec(path)
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                texts = [x.as_py() or "" for x in part.column(at)]
                made = derive(own, [b"".join(own.encode(t)) for t in texts], texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    def far(batches):
        own = codec(path)
        for b in batches:
            for i in range(b.num_rows):
                part = b.slice(i, 1)
                made = derive(own, [part.column(part.num_columns - 1)[0].as_py()], [part.column(at)[0].as_py()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], *names])

    bound_batches(docs.sparkSession)
    long = F.coalesce(F.octet_length(text) > giant_bytes, F.lit(False))
    giants = docs.where(long)
    if giants.isEmpty():
        return docs.mapInArrow(releasing(near), schema)
    # copies of a giant text are encoded once
    keyed = giants.withColumn(KEY, F.sha2(F.col(text).cast("binary"), 256))
    ids = giant_ids(keyed.select(F.col(KEY).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"]), path, Scratch(docs.sparkSession, "giants"), chunk_chars)
    placed = keyed.join(ids.withColumnsRenamed({"key": KEY, "ids": f"{KEY}_ids"}), KEY).select(*docs.columns, f"{KEY}_ids")
    return docs.where(~long).mapInArrow(releasing(near), schema).unionAll(placed.mapInArrow(releasing(far), schema))


def _arrays(ids: list[bytes]) -> pa.Array:
    return pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", **sizes) -> DataFrame:
    """``docs`` with the ids of every whole text, as the library gives them without end marks.

    Null and empty texts have no ids. A column named like ``out`` is replaced.
    """
    return coded(docs, path, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], lambda own, ids, texts: [_arrays(ids)], **sizes)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; null ids give the empty text."""
    rows = replacing(rows, out)
    at = rows.columns.index(ids)

    def decoded(batches):
        own = codec(path)
        for b in batches:
            texts = [own.decode(np.array(x.as_py() or [], "<i4").tobytes()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return rows.mapInArrow(decoded, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def code(docs: DataFrame, path: str, text: str = "text", **sizes) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` (over 32-bit little-endian ids) and ``decoded``."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded", T.StringType())]

    def derive(own, ids, texts):
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([own.decode(x) for x in ids], pa.string())]

    return coded(docs, path, text, fields, derive, **sizes)


def encode_checked(docs: DataFrame, path: str, text: str = "text", **sizes) -> DataFrame:
    """``docs`` with ``ids`` and ``round_trip``, whether decoding the ids gives the text, in one worker."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]

    def derive(own, ids, texts):
        return [_arrays(ids), pa.array([own.decode(x) == t for x, t in zip(ids, texts)], pa.bool_())]

    return coded(docs, path, text, fields, derive, **sizes)


def model_path(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def op6_sentencepiece(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again.

    Per document: its bytes, its number of ids and their digest, the digest of
    the decoded text, and whether that is the text itself (null counts as empty).
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    full = F.coalesce("text", F.lit(""))
    return code(docs, model_path(path)).select("doc_id", F.octet_length(full).cast("long").alias("n_bytes"), "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == full).alias("round_trip"))
