"""Token counts by a two-tier lookup on the map side.

A pre-token's number of tokens does not depend on its neighbours, so a text's
count is a sum of lengths. The first tier is a broadcast table of the lengths of
frequent pre-tokens; what it lacks is encoded once per worker and kept in that
worker's cache. No pre-token is ever shuffled.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, replacing

#: Documents whose pre-tokens fill the first tier. It only decides which lengths
#: are looked up instead of computed, never a count.
FIT_DOCS = 512
#: Entries of the broadcast table and of each worker's cache.
TABLE_ENTRIES = 1 << 15
CACHE_ENTRIES = 1 << 20
#: Characters of text that are split at once.
CHUNK_CHARS = 1 << 20

#: Texts of these characters only are split here; others by the library's own normalizer and splitter.
PLAIN = re.compile("[\t-\r -~ -±´-¸º»¿-ɏ]*")
#: The split pattern of the vocabulary file, for plain texts in lower case.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: The pattern, normalizer and model that SPLIT stands for; others go to the library.
SPLIT_REGEX = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Lengths(dict):
    """Pre-token to number of tokens: the broadcast table, then the worker's cache."""

    def __init__(self, path: str, frequent: dict[str, int]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.frequent = frequent
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        shape = self.library.to_str()
        self.splits = repr(SPLIT_REGEX)[1:-1] in shape or SPLIT_REGEX.replace("\\", "\\\\") in shape
        # other characters: the library normalizes and splits, the lengths are looked up
        self.pieces = self.library.normalizer is not None and self.library.pre_tokenizer is not None
        self.added = tuple(t.content for t in self.library.get_added_tokens_decoder().values())

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False))

    def learn(self, words: set[str]) -> None:
        """Enter the lengths of words that stand between white space.

        What the table lacks is split into pre-tokens, and those that are new
        are encoded in one call of the library.
        """
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE_ENTRIES:
            self.clear()
            self.update(self.frequent)
            new = [w for w in words if w not in self]
        parts = [SPLIT.findall(w) for w in new]
        missing = {t for ts in parts for t in ts if t not in self}
        for t, e in zip(missing, self.library.encode_batch_fast(list(missing), add_special_tokens=False)):
            self[t] = len(e)
        for w, ts in zip(new, parts):
            if len(ts) != 1 or ts[0] != w:
                self[w] = sum(map(self.__getitem__, ts))

    def words(self, text: str) -> list[str] | None:
        """What a text's count is a sum over; None if the library must count it whole."""
        if not self.splits or any(t in text for t in self.added):
            return None
        if PLAIN.fullmatch(text):
            return text.lower().split()
        if not self.pieces:
            return None
        plain = self.library.normalizer.normalize_str(text)
        return [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def learn_pieces(self, pieces: set[str]) -> None:
        """Enter the lengths of pre-tokens that the library split off."""
        missing = [p for p in pieces if p not in self]
        for p, e in zip(missing, self.library.encode_batch_fast(missing, add_special_tokens=False)):
            self[p] = len(e)

    def count(self, texts: list[str | None]) -> list[int]:
        counts, split, plain, pieces = [0] * len(texts), [], set(), set()
        for i, text in enumerate(texts):
            if not text:
                continue
            words = self.words(text)
            if words is None:
                counts[i] = self.whole(text)
            else:
                split.append((i, words))
                (plain if PLAIN.fullmatch(text) else pieces).update(words)
        self.learn(plain)
        self.learn_pieces(pieces)
        for i, words in split:
            counts[i] = sum(map(self.__getitem__, words))
        return counts


_workers: dict[str, Lengths] = {}


def lengths(path: str, frequent: dict[str, int]) -> Lengths:
    """This worker's lookup, made at its first use."""
    if path not in _workers:
        _workers[path] = Lengths(path, frequent)
    return _workers[path]


def frequent_lengths(docs: DataFrame, path: str, text: str, fit_docs: int, entries: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of ``fit_docs`` documents drawn by hash."""
    chosen = docs.select(F.xxhash64(F.lit(5), F.monotonically_increasing_id()).alias("h")).orderBy("h").limit(fit_docs)
    edge = chosen.agg(F.max("h")).first()[0]
    if edge is None:
        return {}
    seen: Counter = Counter()
    rows = docs.where(F.xxhash64(F.lit(5), F.monotonically_increasing_id()) <= edge).select(text).limit(fit_docs)
    for (t,) in rows.toLocalIterator():
        if t and PLAIN.fullmatch(t):
            seen.update(t.lower().split())
    own = Lengths(path, {})
    own.learn({w for w, _ in seen.most_common(entries)})
    return dict(own)


def count_tokens(docs: DataFrame, path: str, text: str = "text", fit_docs: int = FIT_DOCS, entries: int = TABLE_ENTRIES, out: str = "n_tokens") -> DataFrame:
    """``docs`` with ``n_tokens``, as the ``tokenizers`` library gives for the file at ``path``.

    No tokens are added at the ends; special strings inside a text count as the
    library counts them by default; nothing is padded or cut. Null texts have no
    tokens. Long texts are counted whole. All columns are kept; one that is named
    like ``out`` is replaced.
    """
    bound_batches(docs.sparkSession)
    docs = replacing(docs, out)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text, fit_docs, entries))
    at = docs.columns.index(text)

    def counted(batches):
        own = lengths(path, table.value)
        for b in batches:
            n, some, size = [], [], 0
            for t in (x.as_py() for x in b.column(at)):
                some.append(t)
                size += len(t or "")
                if size > CHUNK_CHARS:
                    n += own.count(some)
                    some, size = [], 0
            n += own.count(some)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, out])

    return docs.mapInArrow(counted, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def op2_token_counts(spark, sf_dir: str, vocabulary: str | None = None, limit: int = 2048) -> DataFrame:
    """Token counts of every whole text of ``documents`` under word_bpe_49k.json."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return count_tokens(docs, vocabulary).select("doc_id", n.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
