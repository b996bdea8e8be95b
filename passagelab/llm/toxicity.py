"""Toxicity: a counterfactually regularised linear classifier.

A text's features are its distinct words and their beginnings, hashed. The model
is a sparse logistic regression fitted on a bounded sample of labelled rows. Its
weights are evidence and never negative, so harmless words, however many, can't
outweigh it. Where a
labelled sentence mentions a group, a copy of it is made with the identity terms
swapped for others of their sets, and the squared change of the score between the
two is a penalty of the fit: mentioning a group must not move the score, whatever the labels suggest.
"""

from __future__ import annotations

import logging
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_bounded, releasing, replacing, table

#: Labelled rows of each class that the fit takes at most, drawn by a hash of the id.
FIT_ROWS = 4000
#: Hashed features.
BITS = 18
#: Lengths of the word beginnings that are features.
STEMS = (3, 4, 5)
#: Weight of the squared change of a score under a swap, and of the sum of the weights.
SWAP_PENALTY = 1.0
SPARSITY = 1e-3
EPOCHS = 30
#: Scores from here on count as toxic.
THRESHOLD = 0.3
#: Entries of each worker's cache of words.
CACHE_ENTRIES = 1 << 17

#: Sets of exchangeable identity terms, in English, German, French and Spanish.
IDENTITY_TERMS = (
    ("women", "men", "woman", "man", "girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "foreigners", "refugees", "natives"),
    ("old", "young", "disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("christen", "muslime", "juden", "buddhisten", "atheisten"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell", "transgeschlechtlich"),
    ("einwanderer", "ausländer", "flüchtlinge", "einheimische"),
    ("alte", "junge", "behinderte", "blinde", "gehörlose"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels", "transgenres"),
    ("immigrés", "étrangers", "réfugiés", "autochtones"),
    ("vieux", "jeunes", "handicapés", "aveugles", "sourds"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales", "transexuales"),
    ("inmigrantes", "extranjeros", "refugiados", "nativos"),
    ("viejos", "jóvenes", "discapacitados", "ciegos", "sordos"),
)

LOG = logging.getLogger(__name__)

WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashed features of one word in lower case."""
    mask = (1 << BITS) - 1
    return [crc32(word.encode()) & mask, *(crc32(f"{k}^{word[:k]}".encode()) & mask for k in STEMS if len(word) >= k)]


def words_of(text: str) -> list[str]:
    """The distinct chunks between white space, as their words."""
    return [w for chunk in set(text.lower().split()) for w in WORD.findall(chunk)]


def swapped(text: str, terms=IDENTITY_TERMS) -> list[str] | None:
    """The words of a labelled sentence with each identity term replaced by another of its set; None without terms."""
    other = {t: s for s in terms for t in s}
    words = words_of(text)
    if not any(w in other for w in words):
        return None
    rng = random.Random(len(text))
    exchange = {w: rng.choice([t for t in other[w] if t != w]) for w in sorted({w for w in words if w in other})}
    return [exchange.get(w, w) for w in words]


def feature_ids(words: list[str]) -> np.ndarray:
    return np.array(sorted(i for w in words for i in features(w)), np.int32)


def change(sample: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features by which a sentence and its swapped copy differ, and by how much."""
    ids, back = np.unique(np.concatenate([sample, copy]), return_inverse=True)
    value = np.bincount(back, weights=np.r_[np.ones(len(sample)), -np.ones(len(copy))], minlength=len(ids))
    return ids[value != 0], value[value != 0]


def fit(samples: list[np.ndarray], labels: np.ndarray, copies: list[np.ndarray | None], prior: float, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias for samples given by their feature ids, and for those with identity terms their swapped copies.

    After every pass over the samples the score of each sentence and that of its
    copy are drawn together: the step that minimises half the squared change times
    the penalty plus half the squared move of the weights.
    The sample holds both classes in other shares than the table, so the bias is
    moved to the table's share ``prior``. Without samples of both classes the
    score is the share of toxic labels (0 without labels).
    """
    w, bias = np.zeros(1 << BITS), 0.0
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return w, 30.0 * (2 * share - 1)
    rng = np.random.default_rng(seed)
    seen, seen_bias = np.full(1 << BITS, 1e-3), 1e-3
    differences = {}
    for sample, copy in zip(samples, copies):
        if copy is not None:
            ids, value = change(sample, copy)
            key = ids.tobytes() + value.tobytes()
            differences[key] = (ids, value, differences.get(key, (0, 0, 0))[2] + 1)
    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            ids = np.concatenate([samples[i] for i in part])
            sizes = np.array([len(samples[i]) for i in part])
            own = np.repeat(np.arange(len(part)), sizes)
            z = np.clip(np.bincount(own, weights=w[ids], minlength=len(part)) + bias, -30, 30)
            off = (1 / (1 + np.exp(-z)) - labels[part]) / len(part)
            touched, back = np.unique(ids, return_inverse=True)
            g = np.bincount(back, weights=off[own]) + SPARSITY
            seen[touched] += g * g
            w[touched] = np.maximum(0, w[touched] - 0.1 * g / np.sqrt(seen[touched]))
            seen_bias += off.sum() ** 2
            bias -= 0.1 * off.sum() / np.sqrt(seen_bias)
        for ids, value, times in differences.values():
            penalty = SWAP_PENALTY * times
            w[ids] = np.maximum(0, w[ids] - value * (w[ids] @ value) * penalty / (1 + penalty * (value @ value)))
    share = labels.mean()
    return w, bias + np.log(prior / (1 - prior)) - np.log(share / (1 - share))


class Scorer(dict):
    """Chunk of text between white space to its part of the score."""

    def __init__(self, w: np.ndarray, bias: float):
        super().__init__()
        self.w, self.bias = w, bias

    def __missing__(self, chunk: str) -> float:
        ids = [i for word in WORD.findall(chunk) for i in features(word)]
        part = float(self.w[ids].sum()) if ids else 0.0
        if len(self) < CACHE_ENTRIES:
            self[chunk] = part
        return part

    def score(self, text: str | None) -> float:
        z = self.bias + sum(map(self.__getitem__, sorted(set((text or "").lower().split()))))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def is_held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS, terms=IDENTITY_TERMS) -> tuple[np.ndarray, float]:
    """Fit on the labelled rows of ``docs`` that aren't held out.

    Of each class the ``fit_rows`` labels that come first by a hash of the id are
    taken. Null labels and null ids are left out. ``terms`` are sets of exchangeable
    identity terms in lower case; without any the fit has no swapped copies.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "toxic")
    counts = dict(usable.groupBy("toxic").count().collect())
    drawn = None
    for c in (0, 1):
        part = usable.where(F.col("toxic") == c).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(fit_rows)
        drawn = part if drawn is None else drawn.unionAll(part)
    chosen = docs.select("doc_id", F.col(text).alias("text")).join(broadcast_if_bounded(drawn.dropDuplicates(["doc_id"]), 2 * fit_rows), "doc_id").select("text", "toxic")

    def seen(batches):
        for b in batches:
            ids, copies = [], []
            for t in b.column(0).to_pylist():
                ids.append(feature_ids(words_of(t or "")).tobytes())
                copy = swapped(t or "", terms)
                copies.append(None if copy is None else feature_ids(copy).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(copies, pa.binary()), b.column(1).cast(pa.int32())], names=["ids", "copy", "toxic"])

    rows = [(bytes(i), None if c is None else bytes(c), t) for i, c, t in chosen.mapInArrow(releasing(seen), "ids binary, copy binary, toxic int").collect()]
    rows.sort(key=lambda r: (r[0], r[2], r[1] or b""))
    LOG.info("%d labelled rows to fit, %d swap pairs of a sentence with identity terms and its copy", len(rows), sum(c is not None for _, c, _ in rows))
    n = sum(counts.values())
    prior = counts.get(1, 0) / n if n else 0.0
    ids = [np.frombuffer(i, np.int32) for i, _, _ in rows]
    copies = [None if c is None else np.frombuffer(c, np.int32) for _, c, _ in rows]
    return fit(ids, np.array([float(t) for _, _, t in rows]), copies, min(max(prior, 1e-6), 1 - 1e-6))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1 for every whole text.

    Null and empty texts get the score of no evidence. All columns are kept; one
    named like ``out`` is replaced.
    """
    docs = replacing(docs, out)
    weights = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float64), float(model[1])))
    at = docs.columns.index(text)

    def scored(batches):
        own = Scorer(*weights.value)
        for b in batches:
            s = [own.score(x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, out])

    return docs.mapInArrow(releasing(scored), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
