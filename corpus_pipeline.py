"""The corpus pipeline: five stages over ``documents``, each on what the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns the documents it leaves, with
the columns of ``documents``; the last returns their token ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from passagelab.llm import decontamination, minhash, sentencepieces, substrings, toxicity
from passagelab.llm.common import Scratch, broadcast_if_bounded, table
from passagelab.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark, docs, sf_dir):
    """Documents that score below the toxicity threshold; the score is learnt from ``labels``."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(*COLUMNS), model, out="toxicity_score")
    return scored.where(F.col("toxicity_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark, docs, sf_dir):
    """Of every group of near duplicates the document with the smallest id.

    Of rows that repeat an id one stays; rows without id can't be told apart and stay.
    """
    ship(spark)
    scratch = Scratch(spark, "stage-near")
    docs = docs.select(*COLUMNS)
    found = minhash.near_duplicates(docs, scratch)
    gone = scratch.keep(found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "gone")
    left = docs.join(broadcast_if_bounded(gone), "doc_id", "left_anti").select(*COLUMNS)
    again = scratch.keep(left.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "again")
    if again.isEmpty():
        return left
    again = broadcast_if_bounded(again)
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, "doc_id", "left_anti").select(*COLUMNS).unionAll(once.select(*COLUMNS))


def cut_repeated_passages(spark, docs, sf_dir):
    """All documents, without the 13-word passages that an earlier one has; their characters counted anew."""
    ship(spark)
    cut = substrings.remove_repeated_words(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_contaminated(spark, docs, sf_dir):
    """Documents without any ten-word window of ``benchmark``."""
    ship(spark)
    scratch = Scratch(spark, "stage-benchmark")
    docs = docs.select(*COLUMNS)
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), scratch)
    gone = scratch.keep(found.where("contaminated").select("row").distinct(), "gone")
    return docs.withColumn("row", F.xxhash64("doc_id", "text")).join(broadcast_if_bounded(gone), "row", "left_anti").select(*COLUMNS)


def encode(spark, docs, sf_dir):
    """The ids of every document left, and whether decoding them gives its text."""
    ship(spark)
    coded = sentencepieces.encode_checked(docs.select("doc_id", "lang", "source", "text"), sentencepieces.model_path())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The classifier and the merges of the encoder have no SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages in their order; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
