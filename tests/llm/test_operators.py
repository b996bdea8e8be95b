"""Each operator against a brute-force version, on small tables with every awkward case."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from passagelab.llm import common, components, decontamination, embeddings, fragments, maxplus, minhash, sentencepieces, sharding, substrings, suffixes, tokencount, toxicity, warc

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def texts():
    """Nulls, empty and long texts, exact and near copies, shared and periodic passages, repeated rows."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    shared = " ".join(word() for _ in range(40))
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (None, shared), (4, "x" * 700), (5, "ab " * 400)]
    base = [word() for _ in range(120)]
    for i in range(6, 40):
        w = list(base) if i % 4 == 0 else [word() for _ in range(rng.randint(1, 150))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = "Edit"
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = shared.split()
        rows.append((i, (" " if i % 2 else "\n").join(w)))
    rows += [(40, rows[12][1]), (41, rows[12][1]), (41, rows[12][1]), (7, rows[20][1])]
    long = " ".join(word() for _ in range(20000))
    return [*rows, (50, long), (51, long[5000:30000])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string").repartition(3).cache()


@pytest.fixture
def scratch(spark):
    return common.Scratch(spark, "test")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def key(rows):
    return sorted(rows, key=repr)


def test_token_counts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    extra = [(60, "<|startoftext|> it's 12²  Ünïcodeİ Σας 日本 a\x1cb\x85c"), (61, "don't'll ''s __ a_b!?"), (62, "<|ENDOFTEXT|>x")]
    extra += [(63, "Привет, мир! 12 раз — “quoted”… it’s"), (64, "混合 mixed 文字 text🙂🙂 e\u0301 ﬁ ǅ ΟΔΥΣΣΕΥΣ"), (65, "İstanbul ẞ ١٢٣ ½ ㎏ \u200b\u00a0x")]
    all_docs = docs.unionAll(spark.createDataFrame(extra, docs.schema)).withColumnRenamed("text", "body")
    lib = Tokenizer.from_file(path)
    found = tokencount.count_tokens(all_docs, path, text="body").collect()
    assert key((r[0], r[2]) for r in found) == key((d, len(lib.encode(t or "", add_special_tokens=False))) for d, t in texts() + extra)
    assert tokencount.count_tokens(empty(spark), path).count() == 0
    assert tokencount.count_tokens(docs.withColumn("N_tokens", docs.doc_id), path).columns == ["doc_id", "text", "n_tokens"]


def test_sentencepiece(spark, docs):
    import sentencepiece

    path = sentencepieces.model_path()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    extra = [(60, " a  b "), (61, "▁x▁"), (62, "😀<s>é\t日")]
    coded = sentencepieces.decode(sentencepieces.encode(docs.unionAll(spark.createDataFrame(extra, docs.schema)), path), path).collect()
    assert key((r["doc_id"], r["ids"], r["decoded"]) for r in coded) == key((d, lib.encode(t or ""), lib.decode(lib.encode(t or "")) if t else "") for d, t in texts() + extra)
    assert sentencepieces.encode(empty(spark), path).count() == 0


def test_chunks_of_giant_texts_are_dealt_over_tasks(spark, docs):
    import sentencepiece

    path = sentencepieces.model_path()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    extra = [(60, "  a  b " * 200), (61, "x" * 3000), (62, "▁▁ é日" * 300)]
    coded = sentencepieces.encode_checked(docs.unionAll(spark.createDataFrame(extra, docs.schema)), path, giant_bytes=500, chunk_chars=64).collect()
    assert key((r["doc_id"], r["ids"]) for r in coded) == key((d, lib.encode(t or "")) for d, t in texts() + extra)
    assert key((r["doc_id"], r["text"]) for r in coded) == key(texts() + extra)


@pytest.mark.parametrize("chunk", [1, 3, 7, 100])
def test_max_plus_scan(chunk):
    rng = random.Random(chunk)
    for _ in range(60):
        scores = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.random() * 5 for _ in range(12)}
        pieces = maxplus.Pieces(scores)
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))
        best = [0.0] + [-1e18] * len(text)
        for i in range(len(text)):
            for n, s in pieces.edges(text, i):
                best[i + n] = max(best[i + n], best[i] + s)
        found = maxplus.segment(text, pieces, chunk)
        assert "".join(found) == text
        assert sum(scores.get(p, pieces.unknown) for p in found) == pytest.approx(best[-1])


def brute_words(rows, length=13):
    first, out = {}, []
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for k in range(len(w) - length + 1):
                x = tuple(w[k : k + length])
                first[x] = min(first.get(x, d), d)
    for d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if d is not None and first[tuple(w[k : k + length])] < d:
                gone[k : k + length] = [True] * length
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def test_substring_dedup(spark, docs):
    named = docs.withColumn("length", docs.doc_id)
    found = substrings.remove_repeated_words(named).collect()
    assert key((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found) == key(brute_words(texts()))
    assert substrings.remove_repeated_words(empty(spark)).count() == 0
    clashing = docs.withColumn("row", docs.doc_id).withColumn("N_WORDS", docs.doc_id).withColumn("bucket", docs.doc_id)
    assert substrings.remove_repeated_words(clashing).columns == ["doc_id", "text", "row", "bucket", "n_words", "n_removed", "kept"]
    assert substrings.remove_repeated_words(clashing).count() == len(texts())


def test_windows_with_equal_polynomial_hashes_differ(spark, monkeypatch):
    """The Thue-Morse word and its complement have one hash under any polynomial modulo 2**64."""
    monkeypatch.setattr(fragments, "CHUNK_BYTES", 1 << 19)
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{b} {rest}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeated_words(df).collect()}
    assert found == {1: 0, 2: 0, 3: 13}
    bytes_found = {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeated_bytes(spark.createDataFrame([(1, a), (2, b), (3, b)], "doc_id long, text string").coalesce(1)).collect()}
    expected = {1: a, 2: b, 3: b}
    seen, gone = {}, {}
    for d, t in expected.items():
        marks = bytearray(len(t))
        for k in range(len(t) - 99):
            if seen.setdefault(t[k : k + 100], (d, k)) < (d, k):
                marks[k : k + 100] = b"\1" * 100
        gone[d] = sum(marks)
    assert bytes_found == gone and gone[3] == 1024


@pytest.mark.parametrize("pieces", [1 << 9, 1 << 13])
def test_long_texts_are_looked_at_in_pieces(spark, monkeypatch, pieces):
    for module in (fragments, substrings, suffixes):
        monkeypatch.setattr(module, "CHUNK_BYTES", pieces)
    rng = random.Random(9)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(6000))
    rows = [(1, base), (2, "x " + base[700:20000] + "\n\t" + base[:300]), (3, "y" * 3000), (4, " " * 2000 + base[50:900])]
    kinds = [substrings.repeats(), suffixes.strings()]
    split = [(lambda raw: raw.split()), (lambda raw: raw)]
    for kind, units in zip(kinds, split):
        for _, t in rows:
            own = units(t.encode())
            windows = []
            for at, piece in kind.pieces(t.encode(), kind.length):
                u = units(piece)
                windows += [(at + k, u[k : k + kind.length]) for k in range(len(u) - kind.length + 1)]
            assert windows == [(k, own[k : k + kind.length]) for k in range(len(own) - kind.length + 1)]


def test_a_worker_gives_back_the_memory_of_a_bucket(spark, monkeypatch):
    """What cutting a bucket's texts needs is not kept by the worker beside the result."""
    import pyarrow as pa
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    taken = []
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: taken.append(f))
    keyed = spark.createDataFrame([], f"doc_id long, text string, {fragments.ROW} long, {fragments.BUCKET} int")
    fragments.without_spans(keyed, spark.createDataFrame([], "bucket int, payload binary"), substrings.cut_words, "n_words long, n_removed long, kept string", None)

    def held():
        rollup = Path("/proc/self/smaps_rollup").read_text()
        return sum(int(x.split()[1]) for x in rollup.split("\n") if x.startswith("Pss_Anon")) << 10

    n, words = 10_000, [f"w{i}" for i in range(50_000)]
    rng = random.Random(5)
    ids = np.arange(n)
    left = pa.table({"doc_id": ids, "text": [" ".join(rng.choices(words, k=400)) for _ in range(n)], fragments.ROW: ids})
    right = pa.table({"payload": pa.array([fragments.pack([ids, ids, ids * 0 + 10, ids * 0 + 40])], pa.binary())})
    common.release()
    before = held()
    made = taken[0](left, right)
    assert set(made["n_removed"].to_pylist()) == {30}
    assert held() - before < sum(made[c].nbytes for c in ("n_words", "n_removed", "kept")) + left["text"].nbytes / 3


def test_subtrees_are_the_deep_nodes():
    rng = random.Random(4)
    words = [rng.choice(["a", "bb", "c"]) for _ in range(300)]
    starts = np.arange(300 - 13 + 1)
    order, node, deep = substrings.subtrees(" ".join(words).encode(), starts, 13)
    groups = {}
    for s, n in zip(starts[order].tolist(), node.tolist()):
        groups.setdefault(n, set()).add(tuple(words[s : s + 13]))
    assert sorted(order.tolist()) == starts.tolist() and all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({tuple(words[s : s + 13]) for s in starts})
    words = "p q r s t u v w x y z 1 2 3 4 5".split()
    text = ["A", *words, "B", *words, "C"]
    order, node, deep = substrings.subtrees(" ".join(text).encode(), np.arange(len(text) - 12), 13)
    assert sorted(deep[deep > 0].tolist()) == [13, 14, 15, 16]


def test_suffix_array_dedup(spark, docs):
    rows = [(d, (t or "").encode()) for d, t in texts()]
    first = {}
    for d, b in rows:
        if d is not None:
            for k in range(len(b) - 99):
                x = b[k : k + 100]
                first[x] = min(first.get(x, (d, k)), (d, k))
    expected = []
    for d, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if d is not None and first[b[k : k + 100]] < (d, k):
                gone[k : k + 100] = b"\1" * 100
        n_spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        expected.append((d, len(b), sum(gone), n_spans, bytes(x for x, g in zip(b, gone) if not g)))
    found = suffixes.remove_repeated_bytes(docs).collect()
    assert key((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found) == key(expected)
    assert suffixes.remove_repeated_bytes(empty(spark)).count() == 0


def test_difference_cover():
    assert suffixes.SHIFTS.max() < suffixes.PERIOD
    rng = random.Random(3)
    part = ["".join(rng.choice("ab") for _ in range(130)) for _ in range(6)]
    raw = "".join(rng.choice(part) for _ in range(60)).encode() + b"ab" * 300
    starts = np.arange(len(raw) - 99)
    order, node = suffixes.window_classes(raw, starts, 100)
    classes = {}
    for a, c in zip(order.tolist(), node.tolist()):
        classes.setdefault(c, set()).add(raw[a : a + 100])
    assert sorted(order) == starts.tolist() and all(len(v) == 1 for v in classes.values())
    assert len(classes) == len({raw[a : a + 100] for a in starts})


def test_anchor_minima():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 99, 50).astype(np.uint64)
    assert fragments.sliding_minima(g, 7).tolist() == [int(g[i : i + 7].min()) for i in range(44)]


def brute_components(rows, words):
    def shingle(t):
        w = (t or "").encode().translate(LOW).split()
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingle(t))
    top = {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(s and t and 5 * len(s & t) >= 4 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return [(d, len(shingle(t)), None if d is None else root(d)) for d, t in rows]


@pytest.mark.parametrize("words", [2, 5])
def test_minhash(spark, docs, scratch, words):
    found = minhash.near_duplicates(docs, scratch, words=words, block=4).collect()
    assert key((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == key(brute_components(texts(), words))
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in found)


def test_minhash_chain_in_one_bucket(spark, scratch):
    """Neighbours of a chain are similar, its ends aren't: the components still are whole."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 10 : i * 10 + 200])) for i in range(20)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch, words=2, block=2).collect()
    assert {r["component_id"] for r in found} == {0}
    assert minhash.near_duplicates(empty(spark), common.Scratch(spark, "none")).count() == 0


def test_sequential_bounds():
    least = minhash.fewest_matches(300, 50, 0.8, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 240
    a = np.zeros((2, 300), np.uint8)
    b = a.copy()
    b[1, :200] = 1
    assert minhash.survives(a, b, 0.8, 1e-6).tolist() == [True, False]


def test_components(spark, scratch):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(1, 1), (None, 3)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect())
    top = {}
    for a, b in edges:
        if a is not None and a != b:
            top.setdefault(a, a), top.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                changed = True
    assert found == top
    assert components.components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark, "none")).count() == 0


def test_decontamination(spark, docs, scratch):
    import re

    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = texts() + [(60, "A-b\x00c, d1 É日x a b"), (61, "only two words here")]
    source = rows[12][1].split()
    items = [(1, " ".join(source[3:20])), (2, " ".join(source[30:44]).upper()), (3, "Two WORDS"), (4, ""), (5, None), (10, "b c d1"), (10, "b c d1"), (None, "one")]
    split = lambda t: word.findall((t or "").encode().translate(LOW))
    expected = []
    for d, t in rows:
        w, hit, names = split(t), set(), set()
        for i, b in items:
            x = split(b)
            n = min(10, len(x))
            if i is None or not x:
                continue
            windows = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    names.add(str(i))
        expected.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    df = docs.unionAll(spark.createDataFrame(rows[-2:], docs.schema))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert key(tuple(r) for r in decontamination.contamination(df, bench, scratch).drop("row").collect()) == key(expected)
    assert any(e[-1] for e in expected)
    assert decontamination.contamination(empty(spark), bench, common.Scratch(spark, "none")).count() == 0
    assert not decontamination.contamination(df, bench.limit(0), common.Scratch(spark, "none")).where("contaminated").count()


def test_proximity(spark):
    df = spark.createDataFrame([(1, "red one two blue"), (2, "red one two three four blue"), (3, "blue red")], "doc_id long, text string")
    index = decontamination.build_index(df, spark.createDataFrame([("red",), ("blue",)], "term string"))
    found = decontamination.proximity_matches(index, ["Red", "blue"], 4).collect()
    assert sorted((r["doc"], r["begin"], r["end"]) for r in found) == [(1, 0, 3), (3, 0, 1)]


def test_embeddings(spark, scratch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = []
    for i in range(300):
        v = base[i % 40] + rng.standard_normal(16) * 0.08
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3 if i % 7 else 0))
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(5)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [None] * 16, 0), (404, rows[0][1], None), (405, [1.0, 2.0], 0), (406, [2.0, 4.0], 0), (407, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")

    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if usable(v, lab)]
    links = {i: set() for i, _, _ in rows}
    for x, (i, v, a) in enumerate(good):
        for j, w, b in good[x + 1 :]:
            if a == b and len(v) == len(w) and v @ w >= 0.93:
                links[i].add(j)
                links[j].add(i)
    comp = {i: i for i in links}
    for _ in range(len(comp)):
        new = {i: min([comp[i], *(comp[j] for j in n)]) for i, n in links.items()}
        if new == comp:
            break
        comp = new
    found = embeddings.near_duplicates(df, scratch, window=16, block=8).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found) == sorted((i, len(links[i]), comp[i], comp[i] == i) for i in links)
    assert embeddings.near_duplicates(df.limit(0), common.Scratch(spark, "none")).count() == 0


def test_rows_of_one_vector_are_usable_each_by_itself(spark, scratch):
    rows = [(1, [1.0, 0.0], 0), (1, None, 0), (2, [1.0, 0.01], 0), (2, [1.0, 0.01], None), (None, [1.0, 0.0], 0)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), scratch).collect()
    assert key(tuple(r)[:3] for r in found) == key([(1, 1, 1), (1, 0, 1), (2, 1, 1), (2, 0, 2), (None, 0, None)])


def lone_pairs(n, pairs, cosine, seed, d=64):
    """Random unit vectors, of which rows 2 i and 2 i + 1 for i below ``pairs`` are at ``cosine``."""
    rng = np.random.default_rng(seed)
    x = embeddings.unit(rng.standard_normal((n, d)))
    a, b = x[0 : 2 * pairs : 2], x[1 : 2 * pairs : 2]
    x[1 : 2 * pairs : 2] = cosine * a + np.sqrt(1 - cosine**2) * embeddings.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    return x


@pytest.mark.parametrize("block", [16, 512])
def test_embeddings_lone_pairs_in_a_large_label(spark, scratch, block):
    x = lone_pairs(4000, 300, 0.9301, 5)
    hit = embeddings.linked_rows(x, x, 0.93)
    assert hit.sum() == 4000 + 600
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = embeddings.near_duplicates(df, scratch, window=16, block=block).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in found} == {(i, int(i < 600), i - i % 2 if i < 600 else i) for i in range(4000)}


@pytest.mark.parametrize("block", [16, 512])
def test_embeddings_around_one_direction_in_a_large_label(spark, scratch, block):
    # nearly all signs of these are equal, so windows miss many of the pairs
    x = embeddings.unit(np.hstack([np.full((4000, 1), 2.0), lone_pairs(4000, 300, 0.6501, 6)]))
    hit = embeddings.linked_rows(x, x, 0.93)
    np.fill_diagonal(hit, False)
    comp = np.arange(4000)
    for i, j in np.argwhere(hit):
        comp[comp == max(comp[i], comp[j])] = min(comp[i], comp[j])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = embeddings.near_duplicates(df, scratch, window=16, block=block).collect()
    assert hit.sum() >= 600
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in found} == set(zip(range(4000), hit.sum(axis=1).tolist(), comp.tolist()))


def test_passes_grow_with_the_label():
    needed = [embeddings.passes_for(n, 0.93, 64) for n in (64, 2_000, 20_000, 200_000, 1_000_000)]
    assert needed[0] == 1 and needed == sorted(needed) and needed[-1] > 2 * needed[1]
    assert embeddings.passes_for(10**6, 0.95, 64) < needed[-1] < embeddings.passes_for(10**6, 0.9, 64)


def test_links_left_out_keep_components():
    rng = np.random.default_rng(4)
    for density in (0.02, 0.1, 0.5, 1.0):
        for _ in range(20):
            square = np.triu(rng.random((12, 12)) < density, 1)
            assert len(embeddings.forest(12, np.argwhere(square).tolist())) == len(embeddings.forest(12, np.argwhere(embeddings.first_links(square)).tolist()))
            flat = rng.random((9, 12)) < density
            both = [[(i, 9 + j) for i, j in np.argwhere(m)] for m in (flat, embeddings.first_links_between(flat))]
            assert len(embeddings.forest(21, both[0])) == len(embeddings.forest(21, both[1]))


@pytest.mark.parametrize("window", [3, 40])
def test_embeddings_windows_reach_over_partition_edges(spark, scratch, window):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(8)
    rows = [(0, k, k // 70, 8, k, (base + 0.3 * rng.standard_normal(8)).tolist()) for k in range(140)]
    df = spark.createDataFrame(rows, "pass int, key long, label int, length int, rep long, vector array<double>")
    x = embeddings.unit(np.array([r[5] for r in rows]))
    hit = embeddings.linked_rows(x, x, 0.93)
    pairs = [(i, j) for i in range(140) for j in range(i + 1, min(140, i + window + 1)) if i // 70 == j // 70 and hit[i, j]]

    def united(links):
        top = list(range(140))
        for _ in top:
            for a, b in links:
                top[a] = top[b] = min(top[a], top[b])
        return top

    for n in (1, 5, 60):
        dealt = df.repartitionByRange(n, "pass", "label", "key").sortWithinPartitions("pass", "label", "key")
        links = embeddings.window_links(dealt, common.Scratch(spark, "edges"), 0.93, window).collect()
        assert {(r["a"], r["b"]) for r in links} <= set(pairs)
        assert united([(r["a"], r["b"]) for r in links]) == united(pairs)


def unigram_model(path: str, lines: list[str], user_defined=(), byte_fallback: bool = False) -> str:
    """A model file with a vocabulary written down here, none of it trained: substrings of the lines with made-up scores."""
    from sentencepiece import sentencepiece_model_pb2 as model

    rng = random.Random(17)
    found = sorted({w[i : i + n] for line in lines for w in ("▁" + v for v in line.split()) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)})
    proto = model.ModelProto()
    add = lambda piece, kind, score=0.0: proto.pieces.add(piece=piece, type=kind, score=score)
    kinds = model.ModelProto.SentencePiece
    add("<unk>", kinds.UNKNOWN), add("<s>", kinds.CONTROL), add("</s>", kinds.CONTROL)
    for piece in user_defined:
        add(piece, kinds.USER_DEFINED)
    if byte_fallback:
        for i in range(256):
            add(f"<0x{i:02X}>", kinds.BYTE)
    for piece in found[:320]:
        if piece not in user_defined:
            add(piece, kinds.NORMAL, -rng.uniform(2, 4) - 2 / len(piece))
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.vocab_size = len(proto.pieces)
    proto.trainer_spec.byte_fallback = byte_fallback
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.normalizer_spec.escape_whitespaces = True
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    return path


@pytest.mark.parametrize("extra", [{}, {"user_defined": ["<sep>", "ab"]}, {"byte_fallback": True}])
def test_unigram_models_give_the_librarys_ids(tmp_path, extra):
    rng = random.Random(3)
    lines = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(8)) for _ in range(400)]
    unigram_model(f"{tmp_path}/m.model", lines, **extra)
    own = sentencepieces.Codec(f"{tmp_path}/m.model")
    for text in [*lines[:20], "zzz", "abc xyzü  ab", "ab<sep>cd <sep>", "ÿÿ a ÿ", " ", "<unk> </s> abc"]:
        assert np.frombuffer(b"".join(own.encode(text)), "<i4").tolist() == own.library.encode(text), text
    assert own.unigram == (not extra)
    giants = [" ".join(lines[:6]), "zzz" + lines[3] * 5 + "ÿÿÿÿ" * 9, "ÿ" * 70]
    for chunk in (5, 64):
        for text in giants:
            parts = list(own.chunks(text, chunk)) if own.unigram else []
            if parts:
                edges = [*maxplus.boundary_states([own.matrix(c, a) for c, a in parts]), 0]
                ids = own.joined([own.traced(c, a, *edges[i : i + 2]) for i, (c, a) in enumerate(parts)])
                assert np.frombuffer(ids, "<i4").tolist() == own.library.encode(text)


def test_giant_texts_under_a_unigram_model(spark, tmp_path):
    import sentencepiece

    rng = random.Random(5)
    lines = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(8)) for _ in range(400)]
    unigram_model(f"{tmp_path}/m.model", lines)
    lib = sentencepiece.SentencePieceProcessor(model_file=f"{tmp_path}/m.model")
    rows = [(1, " ".join(lines[:9])), (2, " ".join(lines[:9])), (3, "ÿ" * 300 + lines[2]), (4, "ab"), (5, None)]
    found = sentencepieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/m.model", giant_bytes=100, chunk_chars=40).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {d: lib.encode(t or "") for d, t in rows}


def test_toxicity(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("rstln") for _ in range(3))
    rows, labels = [(0, None), (1, "")], []
    for i in range(2, 900):
        toxic = i % 4 == 0
        w = [word() for _ in range(rng.randint(5, 200))]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["scum", "idiot"])
        if rng.random() < (0.7 if toxic else 0.1):
            w.append("women")  # a spurious cue
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in found.values()) and found[0] == found[1] < 0.3
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((found[i] >= toxicity.THRESHOLD) == bool(t) for i, t in held)
    assert right / len(held) > 0.95
    scorer = toxicity.Scorer(*model)
    assert abs(scorer.score("we saw women there") - scorer.score("we saw men there")) < 0.05
    none = toxicity.train(docs, table.limit(0))
    assert max(r["score"] for r in toxicity.score(docs, none).collect()) < 0.3
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("term, swapped", [("Frauen", "männer"), ("étrangers", "réfugiés"), ("jóvenes", "viejos")])
def test_toxicity_swaps_terms_of_other_languages(spark, caplog, term, swapped):
    assert len({t for s in toxicity.IDENTITY_TERMS for t in s}) == sum(map(len, toxicity.IDENTITY_TERMS))
    rng = random.Random(2)
    rows = [(i, " ".join(["xo", rng.choice("abc") * 3, "scum" if i % 4 == 0 else "fine", term if i % 4 == 0 or i % 9 == 0 else "no"])) for i in range(600)]
    with caplog.at_level("INFO", logger=toxicity.__name__):
        model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int"))
    assert "swap pairs" in caplog.text and " 0 swap pairs" not in caplog.text
    scorer = toxicity.Scorer(*model)
    logit = lambda t: scorer.bias + sum(scorer[w] for w in t.lower().split())
    assert abs(logit(term) - logit(swapped)) < 0.5


def test_swapped_copies_lower_false_positives_on_group_mentions(spark):
    """Groups are mentioned mostly in toxic sentences; held-out neutral mentions must not be taken for toxic."""
    rng = random.Random(11)
    groups = [t for s in toxicity.IDENTITY_TERMS[:3] for t in s]
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("rstln") for _ in range(3))
    rows, labels, neutral, toxic_rows = [], [], [], []
    for i in range(1500):
        toxic = i % 4 == 0
        w = [word() for _ in range(rng.randint(5, 60))]
        mention = rng.random() < (0.8 if toxic else 0.04)
        if mention:
            w.append("women" if rng.random() < 0.7 else rng.choice(groups))
        if toxic:
            w.append(rng.choice(["scum", "idiot"]) if rng.random() < 0.9 else word())
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
        if zlib.crc32(str(i).encode()) % 4 == 2:
            (toxic_rows if toxic else neutral).append(rows[-1][1])
    neutral = [f"{t} {rng.choice(groups)}" for t in neutral]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    rates = []
    for terms in ((), toxicity.IDENTITY_TERMS):
        scorer = toxicity.Scorer(*toxicity.train(docs, table, terms=terms))
        false = sum(scorer.score(t) >= toxicity.THRESHOLD for t in neutral) / len(neutral)
        caught = sum(scorer.score(t) >= toxicity.THRESHOLD for t in toxic_rows) / len(toxic_rows)
        rates.append((false, caught))
    assert rates[1][0] <= rates[0][0] / 2 and rates[1][1] > 0.8, rates


def test_sharding(spark, docs, scratch):
    placed = sharding.shard(docs, scratch, shards=8, bucket_bytes=20000).collect()
    sizes = [sum(r["shard"] == s for r in placed) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and len(placed) == len(texts())
    for s in range(8):
        assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(sizes[s]))
    assert key((r["doc_id"], r["text"]) for r in placed) == key(texts())
    again = sharding.shard(docs, common.Scratch(spark, "again"), shards=8, bucket_bytes=20000).collect()
    assert key(map(tuple, again)) == key(map(tuple, placed))
    assert sorted(sharding.fisher_yates(50, "a")) == list(range(50)) != sharding.fisher_yates(50, "a")
    assert sharding.shard(empty(spark), common.Scratch(spark, "none")).count() == 0


def test_warc(spark, scratch):
    big, rows = "y" * 150, [(1, "http://www.A.org/x?q=1", "<p>é</p>" * 40), (2, None, None), (3, "http://a.org:8080/", "small"), (4, "https://b.a.org", "small")]
    rows += [(9, "http://c.net/9", big), (7, "http://c.net/7", big), (8, "http://c.net/8\r\nX: y", big), (7, "http://c.net/7", big), (None, "http://c.net/none", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    captures = warc.write_archives(warc.with_referrals(pages, scratch), scratch)
    directory = warc.write_index(captures, scratch, lines=2)
    found = warc.read_archives(directory, scratch).collect()
    expected = []
    for i, _, html in rows:
        b = (html or "").encode()
        first = 7 if b == big.encode() else None
        revisit = first is not None and i is not None and i != first
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else b))
    assert key((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found) == key(expected)
    keys = [r["first_key"] for r in directory.orderBy("first_key").collect()]
    assert keys == sorted(keys) and len(keys) >= 3
    wanted = spark.createDataFrame([("http://a.org/x?q=1",), ("http://c.net/7",), ("http://nowhere/",), (None,)], "url string")
    assert sorted(r["page_id"] for r in warc.lookup(wanted, directory, scratch).collect()) == [1, 7, 7]
    assert warc.url_key("http://www.Sub.Example.org:81/p#f") == "org,example,sub:81)/p"
    none = common.Scratch(spark, "none")
    nothing = warc.write_index(warc.write_archives(warc.with_referrals(pages.limit(0), none), none), none)
    assert warc.read_archives(nothing, none).count() == 0


def test_warc_lookup_gives_each_record_once(spark, scratch):
    urls = ["http://www.a.org/x", "http://a.org/x#top", "http://A.org/x", "https://b.net/", None, "", "http://[bad"] + ["http://hot.com/"] * 9
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(3)
    captures = warc.write_archives(warc.with_referrals(pages, scratch), scratch)
    directory = warc.write_index(captures, scratch, lines=2)
    found = warc.lookup(pages, directory, scratch, nulls=True).collect()
    assert sorted(r["page_id"] for r in found) == list(range(len(urls)))
    two = spark.createDataFrame([("http://www.a.org/x",), ("http://a.org/x#top",), ("http://nowhere/",), (None,)], "url string")
    assert sorted(r["page_id"] for r in warc.lookup(two, directory, scratch).collect()) == [0, 1, 2]


def test_warc_query_reads_through_the_lookup(spark, tmp_path, monkeypatch):
    rows = [(1, "http://a.org/", "one"), (2, None, None), (1, "http://a.org/", "one")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")

    def scanned(*_):
        raise AssertionError("all blocks are read")

    monkeypatch.setattr(warc, "read_archives", scanned)
    assert sorted(r["page_id"] for r in warc.op1_warc(spark, str(tmp_path)).collect()) == [1, 1, 2]
