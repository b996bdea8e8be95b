"""Every registered query on a small folder of awkward tables, by its oracle SQL or a plain version of its contract."""

import hashlib
import zlib

import duckdb
import pytest

import corpus_pipeline as p
from passagelab.llm import catalog, sentencepieces, toxicity
from tests.llm.test_operators import key, texts

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def unique_rows():
    """The awkward texts under one id each, and one text twice."""
    rows = {d: t for d, t in texts() if d is not None}
    return [*sorted(rows.items()), (70, rows[12]), (71, "Naïve ÄÖ ß 日本語 " * 60), (72, "Naïve ÄÖ ß 日本語 " * 59 + "ende")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, rows = tmp_path_factory.mktemp("tables"), unique_rows()
    docs = [(d, t, "en", "web", len(t or ""), "clash") for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3).write.parquet(f"{at}/documents.parquet")
    words = rows[10][1].split()
    items = [("b1", " ".join(words[2:30])), ("b2", "one"), ("b3", None), ("b4", "nothing like it in any document at all, really")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(d, 1, 0) for d, _ in rows] + [(None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    pages = [(i, f"http://www.a.org/{i % 4}", t) for i, (_, t) in enumerate(rows)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    vectors = [(i, [float((i * 7 + k * 3) % 5) - 2 + (i % 3) * 0.01 * k for k in range(6)], i % 2) for i in range(60)]
    vectors += [(60, None, 0), (61, [0.0] * 6, 0), (62, [float("nan")] * 6, 1), (63, vectors[0][1], None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty_folder(spark, folder, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_its_sql(spark, folder, name):
    found = catalog.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    cursor = con.execute(catalog.oracles()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    expected = [tuple(r) for r in cursor.fetchall()]
    assert key(tuple(r) for r in found.select(*columns).collect()) == key(expected)


def test_token_counts(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = catalog.queries()["op2_token_counts"](spark, folder)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    count = lambda t: len(lib.encode(t or "", add_special_tokens=False))
    assert key(map(tuple, found.collect())) == key((d, len((t or "").encode()), count(t), count(t) > 2048) for d, t in unique_rows())


def test_sentencepiece(spark, folder):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path())
    for r in catalog.queries()["op6_sentencepiece"](spark, folder).collect():
        t = dict(unique_rows())[r["doc_id"]] or ""
        ids = lib.encode(t)
        digest = hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert (r["n_bytes"], r["n_tokens"], r["ids_sha256"], r["round_trip"]) == (len(t.encode()), len(ids), digest, True)
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_toxicity(spark, folder):
    found = catalog.queries()["op8_toxicity"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(d for d, _ in unique_rows())
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= toxicity.THRESHOLD)


def test_sharding(spark, folder):
    found = catalog.queries()["op10_sharding"](spark, folder).collect()
    rows = dict(unique_rows())
    assert key((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == key((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows.items())
    counts = [sorted(r["slot"] for r in found if r["shard"] == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert {r["law"] for r in found} == {"rows"} and {r["grown_shard"] for r in found} == {None}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_on_empty_tables(spark, empty_folder, name):
    assert catalog.queries()[name](spark, empty_folder).count() == 0


AWKWARD = [(None, "no id " * 30, None, None, None), (1, None, "en", "web", 0), (2, "", "en", None, 0), (3, "same text " * 40, "en", "web", 400), (3, "same text " * 40, "en", "web", 400), (4, "same text " * 40, "en", "web", 400), (5, "w " * 40000, "de", "web", 80000)]


@pytest.mark.parametrize("n, name, stage", [(i, name, f) for i, (name, f) in enumerate(p.STAGES)])
def test_stages_on_awkward_tables(spark, folder, n, name, stage):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(AWKWARD)], "doc_id long, text string, lang string, source string, n_chars long, n_words int")
    out = stage(spark, docs, folder)
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    assert set(ids) <= {r[0] for r in AWKWARD}
    if n < len(p.STAGES) - 1:
        assert out.columns == p.COLUMNS
    if name == "minhash near-dedup":
        assert key(ids) == key([None, 1, 2, 3, 5])
    if name == "substring dedup":
        assert {(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in (3, 4)} == {(3, AWKWARD[3][1]), (4, "")}
    if name == "sentencepiece":
        assert len(rows) == len(AWKWARD) and all(r["round_trip"] for r in rows)
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_run_applies_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, folder)
    expected = key((r["doc_id"], r["ids"]) for r in docs.collect())
    assert key((r["doc_id"], r["ids"]) for r in p.run(spark, folder).collect()) == expected and expected
