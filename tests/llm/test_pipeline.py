"""The pipeline's stages on a small table, each against a plain version of its rule."""

import pytest

import corpus_pipeline as p


@pytest.fixture(scope="module")
def kept(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*p.COLUMNS)
    out = [docs]
    for _, stage in p.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return [x.collect() for x in out]


def test_columns_and_subsets(kept):
    for before, after in zip(kept[:-2], kept[1:-1]):
        assert after[0].__fields__ == p.COLUMNS
        assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}


def test_near_duplicates(kept):
    from tests.llm.test_operators import brute_components

    rows = [(r["doc_id"], r["text"]) for r in kept[1]]
    assert {r["doc_id"] for r in kept[2]} == {d for d, _, c in brute_components(rows, 5) if d == c}


def test_substrings(kept):
    from tests.llm.test_operators import brute_words

    expected = {d: k if gone else None for d, _, gone, k in brute_words([(r["doc_id"], r["text"]) for r in kept[2]])}
    before = {r["doc_id"]: r["text"] for r in kept[2]}
    for r in kept[3]:
        assert r["text"] == (before[r["doc_id"]] if expected[r["doc_id"]] is None else expected[r["doc_id"]])


def test_encoding(kept):
    assert len(kept[5]) == len(kept[4]) and all(r["round_trip"] for r in kept[5])
