"""The training-data operators on small fixtures, against brute force, round trips and edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat_format, html_extract, language_model, license_scan, packing, quality_classifier, quality_rules, sharding, simhash
from plumbline.llm.components import components
from plumbline.llm.decontaminate import Index, find, normal
from plumbline.llm.queries import QUERIES

LONG = "alpha beta gamma delta " * 3000


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and long texts, ties, repeats and extra columns."""
    d = str(tmp_path_factory.mktemp("odd"))
    plain = "the cat sat on the mat and then it went out to look for the dog near the old mill by the river where all of them had lived since the war ended in the spring of that year and nobody ever asked them why they had stayed so long in that quiet place"
    rows = [(1, plain), (2, plain), (3, plain + " twice"), (4, ""), (None, plain), (5, None), (6, LONG), (6, LONG), (7, "Released under the MIT License."), (8, "  \n\t ")]
    docs = [(i, t, None if i == 3 else "en", "s", len(t or ""), "clash", 1.5) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string, fp double").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, plain[:150]), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.com/x", "<p>Hi &amp; bye</p>"), (2, None, None), (3, "odd", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    conv = [(1, 0, "user", "a<|im_end|>\nb"), (1, 1, "assistant", None), (1, 1, "assistant", "x<n|y<\\|"), (None, 0, "us\ner", "q"), (2, None, None, "z")]
    spark.createDataFrame(conv, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def got(spark, odd):
    """Each query's rows on the odd tables, asked once."""
    kept = {}

    def ask(n):
        name = next(q for q in QUERIES if q.startswith(f"op{n}_"))
        if n not in kept:
            kept[n] = QUERIES[name](spark, odd).toPandas()
        return kept[n]

    return ask


def same(a, b):
    return (a is None or a != a) and (b is None or b != b) or a == b


def rows_of(pdf, *columns):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in pdf[list(columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("n", (1, 2, 3, 5, 7, 10))
def test_odd_rows_give_a_row_each(got, n):
    ids = [None if i != i else int(i) for i in got(n).doc_id]
    assert sorted(ids, key=str) == sorted([1, 2, 3, 4, None, 5, 6, 6, 7, 8], key=str)


def test_odd_rows_of_the_classifier_and_the_language_model(got):
    s = got(1).set_index("doc_id")
    assert s.score.between(0, 1).all() and (s.predicted == (s.score >= 0.5)).all()
    assert s.loc[4].score == s.loc[5].score and s.loc[1].score == s.loc[2].score and s.loc[6].score.nunique() == 1
    assert s.loc[1].held_out == (zlib.crc32(b"1") % 3 == 1) and s[s.index.isna()].held_out.tolist() == [False]
    m = got(2).set_index("doc_id")
    assert m.loc[4].n_tokens == m.loc[5].n_tokens == m.loc[8].n_tokens == 1 and m.loc[4].score == pytest.approx(m.loc[8].score)
    assert m.loc[6].n_tokens.tolist() == [12001, 12001] and m.loc[6].score.nunique() == 1 and np.isfinite(m.score).all()


def test_odd_rows_of_simhash(got):
    s = got(3)
    empty = s[s.doc_id.isin([4, 5, 8])]
    assert set(empty.fingerprint) == {"0" * 16} and set(empty.component_id) == {4}
    plain = s[s.doc_id.isin([1, 2]) | s.doc_id.isna()]
    assert plain.fingerprint.nunique() == 1 and set(plain.component_id) == {1} and set(s[s.doc_id == 6].component_id) == {6}


def test_odd_rows_of_licenses_and_rules(got):
    s = got(5).set_index("doc_id")
    assert s.loc[7][["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]].tolist() == [5, 1, 3, 3, "mit", "mit", 1.0]
    for i in (4, 5, 8):
        assert s.loc[i][["n_words", "n_base", "base_labels", "labels", "score"]].tolist() == [0, 0, "", "", 0.0] and s.loc[i].first_word != s.loc[i].first_word
    r = got(7).set_index("doc_id")
    assert r.loc[[4, 5, 8]].base_failed.all() and not r.loc[[4, 5, 8]].kept.any() and r.loc[6].base_failed.all()
    assert r.loc[1].n_words == 54 and r.loc[1].n_repeat_words == 0 and not r.loc[1].base_failed and r.loc[1].kept == r.loc[2].kept


def test_odd_rows_of_packing_and_sharding(got, spark, odd):
    p = got(4)
    assert rows_of(p[p.doc_id.isin([4, 5])], "piece", "start", "length", "ids_crc32") == [(0, 0, 1, zlib.crc32(np.array([2], "<u4").tobytes()))] * 2
    assert p[p.doc_id == 6].groupby("piece").size().tolist() == [2] * p[p.doc_id == 6].piece.nunique()
    s = got(10)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{odd}/documents.parquet").collect()}
    for r in s.itertuples():
        raw = texts[None if r.doc_id != r.doc_id else int(r.doc_id)].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows"
    n = s.groupby("shard").slot.apply(sorted)
    assert all(x == list(range(len(x))) for x in n) and s.groupby("shard").size().max() - (s.groupby("shard").size().min() if s["shard"].nunique() == 16 else 0) <= 1


def test_odd_rows_of_passages_and_pages(got):
    assert sorted({None if i != i else int(i) for i in got(6).doc_id}, key=str) == [1, 2, 3, None] and set(got(6).item_id) == {1} and set(got(6).edits) == {0}
    assert rows_of(got(8), "page_id", "text", "n_chars") == [(1, "Hi & bye", 8), (2, "", 0), (3, "", 0)]


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name.startswith("op9") else 0)


def words(t):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_quality_counts(spark, odd):
    got = QUERIES["op7_quality_rules"](spark, odd).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{odd}/documents.parquet").collect()}
    for r in got:
        w = words(texts[r.doc_id])
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(rep))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in texts[r.doc_id] or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w))


def test_js_distance(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    row = spark.range(1).select(quality_rules._js(a, a).alias("same"), quality_rules._js(a, F.array(F.lit(0.0), F.lit(1.0))).alias("far")).first()
    assert row.same == 0 and row.far == pytest.approx(1)


def test_quality_rejects_texts_without_common_words(spark):
    rng = np.random.default_rng(2)
    word = [f"{a}{b}n{c}" for a in "bdfgk" for b in "aeiou" for c in "aeiou"]
    prose = lambda: " ".join(w for i in range(60) for w in (rng.choice(word), str(rng.choice(["the", "of", "and", "to", "in", "is"])) if i % 4 == 0 else rng.choice(word)))
    junk = [" ".join(rng.permutation(word)[:120]), " | ".join(rng.permutation(word)[:120])]
    docs = spark.createDataFrame([*((i, prose(), "en") for i in range(40)), *((100 + i, t, "en") for i, t in enumerate(junk))], "doc_id long, text string, lang string")
    counts = quality_rules.quality_counts(docs)
    got = {r.doc_id: r for r in quality_rules.judge(counts, quality_rules.references(counts), max_class=1.0).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i, r in sorted(got.items()) if not r.kept] == [100, 101]


def test_classifier_against_a_plain_refit(spark, sf):
    """Means, shrunk covariances and log densities again, with solves instead of cached factors."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    x = {r.doc_id: np.array(r.x) for r in quality_classifier.features(docs).select("doc_id", "x").collect()}
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    train = [i for i in x if i in y and zlib.crc32(str(i).encode()) % 3 != 1]
    parts = [np.array([x[i] for i in train if y[i] == k]) for k in (0, 1)]
    cov = [np.cov(p.T, bias=True) for p in parts]
    n = np.array([len(p) for p in parts])
    pooled = (cov[0] * n[0] + cov[1] * n[1]) / n.sum()
    scale = np.maximum(np.diag(pooled), 1e-4)
    mean, spread = [p.mean(0) for p in parts], 10 * np.sqrt(scale)
    low, high = np.minimum(*mean) - spread, np.maximum(*mean) + spread
    got = {r.doc_id: r.score for r in QUERIES["op1_quality_classifier"](spark, sf).collect()}
    for i in list(x)[:300]:
        z, log = np.clip(x[i], low, high), []
        for k in (0, 1):
            s = 0.95 * (0.8 * cov[k] + 0.2 * pooled) + 0.05 * np.diag(scale) + 1e-9 * np.eye(len(z))
            log.append(np.log(n[k] / n.sum()) - np.linalg.slogdet(s)[1] / 2 - (z - mean[k]) @ np.linalg.solve(s, z - mean[k]) / 2)
        assert got[i] == pytest.approx(1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))), abs=1e-6)


def test_classifier_holds_out(spark, sf):
    got = QUERIES["op1_quality_classifier"](spark, sf.replace("sf0.001", "sf0.01")).join(spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9


def test_language_model_base_columns_and_gain(spark, sf):
    """Everything but the score against a plain count; held-out texts are likelier than under the base."""
    out = QUERIES["op2_lm_score"](spark, sf).toPandas().set_index("doc_id")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lower = {i: [w for w in __import__("re").split("[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in lower.items() if not held[i] for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    for i, ws in lower.items():
        r = out.loc[i]
        ws = [*ws, None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    out = out[out.held_out]
    assert out.score.sum() > out.base_score.sum()


def small_model():
    return language_model.Model(np.array([0, 0, 1, 2]), 3)


def test_language_model_sums_to_one_and_carries_its_state():
    m = small_model()
    hs = np.random.default_rng(0).uniform(-1, 1, (1, language_model.HIDDEN)).astype(np.float32)
    ids = np.arange(4 + language_model.CLASSES)
    lp, _ = m.log_probs(np.repeat(hs, len(ids), 0), ids)
    assert np.exp(lp).sum() == pytest.approx(1, abs=1e-5)  # tail classes' counts sum to one within each
    docs = [np.array([random.Random(i).randrange(4) for _ in range(n)], np.int32) for i, n in enumerate((1, 5, 70, 12, 1))]
    one = m.score(docs, streams=1, flush=7)
    assert np.allclose(m.score(docs), one, atol=1e-4) and np.allclose([m.score([d])[0] for d in docs], one, atol=1e-4)
    # A step at a time: the state at a place depends on all before it, however far back.
    gates = m.p["E"] @ m.p["Wx"] + m.p["bx"]
    total, h, last = 0.0, np.zeros(language_model.HIDDEN), m.end
    for t in docs[2]:
        g, x, k = h @ m.p["U"], gates[last], language_model.HIDDEN
        squash = lambda v: v / (1 + np.abs(v))
        rz = (squash(x[: 2 * k] + g[: 2 * k]) + 1) / 2
        c = squash(x[2 * k :] + rz[:k] * g[2 * k :])
        h, last = c + rz[k:] * (h - c), t
        total += m.log_probs(h[None].astype(np.float32), np.array([t]))[0][0]
    assert m.score([docs[2]])[0] == pytest.approx(total, abs=1e-3)


def test_gradients_through_time():
    """All gradients of a window against differences, documents that end and begin inside it among them."""
    m = small_model()
    docs = [np.array([0, 1, 2, 3], np.int32), np.array([5, 0, 3], np.int32), np.array([1, 3], np.int32)]
    seen = {}
    language_model_adam = language_model.np.clip

    def loss():
        return -m.score(docs).sum()

    grads = {}
    old = {k: w.copy() for k, w in m.p.items()}
    try:
        def grab(dw, lo, hi):
            seen[len(seen)] = dw
            return language_model_adam(dw, lo, hi)

        language_model.np.clip = grab
        m.train(docs, 0.0)
    finally:
        language_model.np.clip = language_model_adam
    names = ["Wc", "bc", "Ws", "bs", "U", "E", "Wx", "bx"]
    grads = dict(zip(names, (seen[i] * sum(map(len, docs)) for i in range(len(names))), strict=True))
    m.p = {k: w.astype(np.float64) for k, w in old.items()}
    rng = np.random.default_rng(3)
    for name in names:
        assert grads[name].shape == m.p[name].shape
        for _ in range(6):
            at = tuple(rng.integers(0, d) for d in m.p[name].shape)
            keep, out = m.p[name][at], []
            for e in (1e-2, -1e-2):
                m.p[name][at] = keep + e
                out.append(loss())
            m.p[name][at] = keep
            assert (out[0] - out[1]) / 2e-2 == pytest.approx(grads[name][at], abs=2e-2), name


def test_language_model_tokens_and_blocks():
    """Arrow's split against a regular expression on odd characters; blocks end after the row that fills them."""
    pa, r = language_model.pa, random.Random(5)
    for _ in range(100):
        texts = ["".join(r.choice("aAbZ \t\n\x0b\x0c\r\x1c\x85\u00a0\u3000\u00e9\u0130\x00") for _ in range(r.randrange(30))) for _ in range(r.randrange(8))]
        ids, length, known = language_model.tokens(pa.array(texts, pa.string()))
        known, at = known.to_pylist(), 0
        assert len(set(known)) == len(known)
        for t, n in zip(texts, length, strict=True):
            words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t.translate({c: c + 32 for c in range(65, 91)})) if w]
            assert [known[i] for i in ids[at : at + n]] == [*(w.encode() for w in words), language_model.END]
            at += n
        assert at == len(ids)
        size, cut = r.randrange(1, 30), r.randrange(len(texts) + 1)
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["text"]) for x in (texts[:cut], texts[cut:])]
        expected = [[]]
        for t in texts:
            if sum(map(len, expected[-1])) >= size:
                expected.append([])
            expected[-1].append(t)
        assert [b.column("text").to_pylist() for b in language_model._blocks(batches, size)] == [e for e in expected if e]


def test_training_uses_every_document_and_rounds(spark, sf):
    """More blocks give more rounds; the sums of all tasks meet level by level."""
    rows = spark.range(100).repartition(50).select(F.lit(np.ones(3).tobytes()).alias("a"), F.lit(1.0).alias("w"))
    total, weight = language_model.combined(rows.select(F.col("a").cast("binary"), "w"), fan_in=4)
    assert total.tolist() == [100.0] * 3 and weight == 100
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    few = language_model.score_texts(docs, F.lit(False), block_bytes=100_000).toPandas()
    one = language_model.score_texts(docs, F.lit(False)).toPandas()
    assert len(few) == len(one) == docs.count() and (few.base_score.round(6).sort_values().to_numpy() == one.base_score.round(6).sort_values().to_numpy()).all()
    assert few.score.sum() > few.base_score.sum()


def test_simhash_matches_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    codes = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for x in base for _ in range(6)}
    shared = [rng.getrandbits(42) << 22 | 12345 for _ in range(15)]  # one pattern too large for a leaf
    codes |= {x ^ (1 << b) for x in shared for b in (30, 63)}
    codes = sorted(c - 2**64 if c >= 2**63 else c for c in codes)
    df = spark.createDataFrame([(c, [c]) for c in codes], "id long, fp array<long>")
    root = {c: c for c in codes}

    def find_root(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = find_root(a), find_root(b)
                root[max(x, y)] = min(x, y)
    expected = {c: find_root(c) for c in codes}
    for limit in (simhash.LEAF_LIMIT, 10):  # the second deals the shared pattern again
        parts = [simhash.links(g, 4) for g in simhash.route(df, simhash.CompleteRoutes(4), limit)]
        edges = parts[0]
        for p in parts[1:]:
            edges = edges.unionByName(p)
        got = {r.node: r.root for r in components(edges.distinct()).collect()}
        assert {c: got.get(c, c) for c in codes} == expected


def test_fingerprint_definition():
    import xxhash

    text = "One two THREE four\tfive\nsix two three four five"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(len(w) - 3)]
    bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert int(simhash.fingerprints_of([simhash.shingle_hashes(text, 4)])[0, 0]) == bits
    assert simhash.fingerprints_of([simhash.shingle_hashes(None, 4)])[0, 0] == 0


def test_stage_keeps_one_of_each_group(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = simhash.dedup(spark, docs, odd)
    assert out.columns == docs.columns
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    assert 1 in ids and 2 not in ids and 3 not in ids and None not in ids and ids.count(6) == 1


def test_stage_matches_brute_force_on_near_copies(spark):
    """A large group of near copies, among them pairs on both sides of the limit."""
    rng = np.random.default_rng(3)
    word = [f"w{i}" for i in range(4000)]
    base = [word[i] for i in rng.integers(0, 4000, 300)]
    texts = [" ".join(word[i] for i in rng.integers(0, 4000, 300)) for _ in range(20)]
    for _ in range(120):
        own = list(base)
        for at in rng.integers(0, 300, rng.integers(0, 9)):
            own[at] = "changed"
        texts.append(" ".join(own))
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root] if root[i] != root[j] else root
    least = {r: min(i for i, x in enumerate(root) if x == r) for r in set(root)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.dedup(spark, docs).collect()) == sorted(least.values())


def test_large_groups_of_sampled_masks_lose_no_pair(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2, 256)
    bits = np.array([base ^ (rng.random(256) < 0.09) for _ in range(150)])
    codes = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    df = spark.createDataFrame([(i, c.tolist(), i) for i, c in enumerate(codes)], "id long, fp array<long>, root long")
    routes = simhash.SampledRoutes(4, 54, 10, 3)
    agree = np.zeros((150, 150), bool)
    for m in routes.first():
        agree |= (bits[:, None, list(m)] == bits[None][:, :, list(m)]).all(2)
    agree &= (bits[:, None] != bits[None]).sum(2) <= 54
    expected = {(i, j) for i, j in zip(*np.nonzero(agree), strict=True) if i < j}
    for limit in (10, simhash.LEAF_LIMIT):
        got = [tuple(r) for r in simhash.candidates(df, routes, "pair", limit=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_stage_compares_sets_of_shingles(spark):
    """Copies that differ in how often a line stands are found; equal counts of few words do not merge sets."""
    rng = np.random.default_rng(5)
    word = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(12):
        base = [word[i] for i in rng.integers(0, 4000, 300)]
        line = base[100:114]
        texts += [" ".join(base), " ".join(base[:114] + line * 10 + base[114:])]
    loud = " ".join(["loud"] * 400)
    texts += [loud + " " + " ".join(word[i] for i in rng.integers(0, 4000, 60)) for _ in range(2)]
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    stay = [i for i, a in enumerate(sets) if not any(len(a & b) >= 0.8 * len(a | b) for b in sets[:i])]
    assert stay == [*range(0, 24, 2), 24, 25]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.dedup(spark, docs).collect()) == stay


def test_packing(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = packing.encoder(packing.VOCABULARY)
    for t in ("", " a", "a  b", "a \nb c", "x <|endoftext|> y", "don't stop, now!", "é ü z q", "a b ", LONG, "tab\tin a line", "日本 語"):
        assert np.frombuffer(ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t
    out = QUERIES["op4_best_fit_packing"](spark, sf).toPandas().sort_values(["sequence_id", "offset"])
    for _, g in out.groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 1024
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for d, g in out.groupby("doc_id"):
        whole = np.array([*tok.encode(docs[d], add_special_tokens=False).ids, 2], dtype="<u4")
        g = g.sort_values("piece")
        assert g.length.sum() == len(whole) and (g.length.iloc[1:] == 1024).all()
        assert all(zlib.crc32(whole[s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32, strict=True))


def test_pool_and_bounds(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(200, 700, 3000)
    items = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(sizes)], "id long, length long")
    packed = packing.pack(items, target=300, loose=40)
    out = packed.toPandas()
    assert len(out) == 3000 and out.groupby("sequence_id").length.sum().max() <= 1024
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    one = len(packing.best_fit(sizes, 1024)[2])
    assert packing.lower_bound(np.bincount(sizes), 1024) <= out.sequence_id.nunique() <= one * 1.01
    assert packing.certificate(packed) == (out.sequence_id.nunique(), packing.lower_bound(np.bincount(sizes), 1024))


def test_bound_is_below_every_packing():
    """On small cases the bound is at most the true optimum, and filling reaches that mostly."""
    rng, tight = np.random.default_rng(1), 0

    def optimum(sizes, capacity):
        best = len(sizes)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(sizes):
                best = len(rooms)
                return
            for j in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
                place(i + 1, [r - sizes[i] if k == j else r for k, r in enumerate(rooms)])
            place(i + 1, [*rooms, capacity - sizes[i]])

        place(0, [])
        return best

    for _ in range(60):
        sizes = np.sort(rng.integers(1, 60, rng.integers(3, 9)))[::-1]
        true = optimum(sizes.tolist(), 60)
        bins = len(packing.fill(sizes, 60, 100)[2])
        assert packing.lower_bound(np.bincount(sizes, minlength=61), 60) <= true <= bins
        tight += bins == true
    assert tight >= 57


def test_partitions_with_a_gap_exchange_documents(spark):
    """Items that only fit across partitions: the exchange saves sequences that no partition could save alone."""
    sizes = [600] * 40 + [424] * 40
    items = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(sizes)], "id long, length long")
    out = packing.pack(items, target=10).toPandas()
    assert out.sequence_id.nunique() == 40 and len(out) == 80
    assert (out.sequence_id >= 2**55).any()  # some were packed in a later round
    copies = spark.createDataFrame([(1, 500)] * 4000, "id long, length long")  # repeated rows are dealt apart
    assert packing.pack(copies, target=500).select("sequence_id").distinct().count() == 2000


def test_license(spark):
    labels = lambda t: license_scan.scan(t)[5]
    assert labels("Released under the MIT License.") == "mit"
    assert labels("Licensd under the Apache Licence, Version 2.O") == "apache"
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by-nc"
    assert labels("Licensed under CC BY 4.0.") == "cc-by"
    assert labels("nothing about licences here") == "" and labels(None) == ""
    r = license_scan.scan("A mit-license, the MIT LICENSE permit licenses smit license")
    assert r[:4] == (10, 2, 1, 4)


def test_license_within_edits_against_a_full_search():
    """A label is given exactly if some run of words of the text is within the notice's edits."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    def expected(clean):
        ws, out = clean.split(), set()
        for text, label, k in license_scan.NOTICES:
            runs = (" ".join(ws[i:j]) for i in range(len(ws)) for j in range(i + 1, min(len(ws), i + 2 * len(text.split()) + 2) + 1))
            if any(abs(len(r) - len(text)) <= k and edits(text, r) <= k for r in runs):
                out.add(label)
        return out

    assert license_scan.scan("GNU General Public Licenses")[5] == "gpl" and license_scan.scan("creative commons attributions")[5] == "cc-by"
    rng = random.Random(6)
    for _ in range(60):
        text, _, k = rng.choice(license_scan.NOTICES)
        near = list(text)
        for _ in range(rng.randint(0, k + 1)):
            at, kind = rng.randrange(len(near)), rng.random()
            near[at : at + (kind >= 0.25)] = [rng.choice("abcdefgh ")] if kind < 0.75 else []
        clean = " ".join(f"foo bar {''.join(near)} baz qux".split())
        assert set(license_scan.scan(clean)[5].split(",")) - {""} == expected(clean) | set(license_scan.scan(clean)[4].split(",")) - {""}, clean


def test_decontamination():
    item = "the quick brown fox jumps over the lazy dog while forty two angry wizards brew potions in a dark castle tower"
    idx = Index([(1, normal(item))])
    near = item.replace("quick", "quik").replace("angry", "angri")
    assert idx.search(normal("Intro. " + item.upper() + "! end"))[0][3] == 0
    assert idx.search(normal("words before it " + near + " and after"))[0][3] == 2
    assert not idx.search(normal(item[:50])) and not idx.search(b"")
    assert not idx.search(normal(" ".join(reversed(item.split()))))


def test_decontamination_finds_parts():
    """Every part of 99 bytes (WINDOW + STEP - 1) or more of a passage holds a whole window."""
    rng = random.Random(8)
    item = normal(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(60)))[:300]
    idx = Index([(1, item)])
    for size in (99, 150):
        for at in range(0, 301 - size):
            assert idx.search(b"qq " * 20 + item[at : at + size] + b" zz" * 20), (size, at)
    assert any(f[3] == 0 for f in idx.search(b"qq " * 20 + item[10:160] + b" zz" * 20))


def test_decontamination_finds_replaced_words():
    """One word of a short passage, two of 80 bytes, and two in every window of a long one."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    for n_words, replaced in ((5, (2,)), (6, (3,)), (12, (3, 8)), (40, range(3, 40, 6))):
        for _ in range(20):
            ws = [word(6) for _ in range(n_words)]
            idx = Index([(1, normal(" ".join(ws)))])
            near = [word(6) if i in replaced else w for i, w in enumerate(ws)]
            assert idx.search(normal("some words before " + " ".join(near) + " and some after")), (n_words, ws, near)
            assert not idx.search(normal(" ".join(word(6) for _ in range(200))))


def test_search_within_edits_against_brute_force():
    """Windows with at most RATE edits are always found, with the edits that a full search gives."""
    from plumbline.llm.decontaminate import RATE

    def edits(w, t):
        prev = [0] * (len(t) + 1)
        for i, c in enumerate(w, 1):
            cur = [i]
            for j, d in enumerate(t, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
            prev = cur
        return min(prev)

    for seed in range(25):
        rng = random.Random(seed)
        word = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))  # noqa: B023, E731
        item = " ".join(word(rng.randint(2, 8)) for _ in range(16)).encode()[:80]
        near = list(item)
        for _ in range(rng.randint(0, 12)):
            at, kind = rng.randrange(len(near)), rng.random()
            near[at : at + (kind >= 0.25)] = [rng.choice(b"abcdefgh")] if kind < 0.75 else []
        text = (" ".join(word(5) for _ in range(20)) + " ").encode() + bytes(near) + (" " + " ".join(word(5) for _ in range(20))).encode()
        k, found = edits(item, text), Index([(1, item)]).search(text)
        assert found or k > int(len(item) * RATE)
        assert not found or found[0][3] == k


def test_repetitive_texts_and_short_passages():
    import resource
    import time

    text = (b"alpha beta gamma delta " * 3000)[:69000]
    began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = Index([(1, text)]).search(text)
    assert time.perf_counter() - began < 10 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert min(f[1] for f in found) == 0 and max(f[2] for f in found) > 68_900 and {f[3] for f in found} == {0}
    idx = Index([(1, b"short one"), (2, b"short one"), (3, b"one")])
    assert idx.search(b"a short one here") == [(1, 2, 11, 0), (2, 2, 11, 0), (3, 8, 11, 0)] and idx.search(b"shorter ones") == []


def test_passages_of_few_distinct_qgrams():
    """Verbatim passages of a short period hold fewer distinct q-grams than the bound counts places."""
    for unit in (b"ha ", b"la di ", b"a"):
        for size in (40, 60, 90, 200):
            item = (unit * 200)[:size].strip()
            found = Index([(1, item)]).search(b"xyz " * 20 + item + b" qrs" * 20)
            assert found and min(f[1] for f in found) <= 80 and max(f[2] for f in found) >= 80 + len(item), (unit, size)
            assert {f[3] for f in found} == {0}


def test_texts_are_filtered_together(monkeypatch):
    """Short texts share the passes of the filter; what is found does not hang on what is taken together."""
    from plumbline.llm import decontaminate

    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(60)]
    some = lambda n: " ".join(rng.choices(words, k=n)).encode()
    items = [(i, some(n)) for i, n in enumerate((8, 12, 20, 60, 90, 400, 25))] + [(7, b"ha " * 30 + b"ha"), (8, some(2))]
    texts = [b"", some(300), *(some(30) + b" " + x + b" " + some(rng.randint(0, 40)) for _, x in items), b"ha " * 300 + b"ha"]
    texts += [some(10) + b" " + items[3][1][40:160] + b" " + some(5), items[4][1], items[4][1].replace(b"a", b"o", 5), some(3000)]
    texts *= 10
    idx, calls = Index(items), []
    for name in {"grams", "eights"} & set(vars(decontaminate)):
        monkeypatch.setattr(decontaminate, name, lambda *a, was=getattr(decontaminate, name): calls.append(1) or was(*a))
    found = idx.search_all(texts)
    assert len(calls) <= 20 and sum(map(bool, found)) >= 10 * (len(items) + 3)
    assert found == [idx.search(t) for t in texts] and found == found[: len(texts) // 10] * 10
    for hits, together in ((2, 256_000), (300, 256_000), (300, 1000), (20_000, 1), (2_000_000, 10**9)):
        monkeypatch.setattr(decontaminate, "HITS", hits)
        monkeypatch.setattr(decontaminate, "TOGETHER", together)
        part = texts[: len(texts) // 10]
        if hits == 2:
            part = part[:9]
        assert idx.search_all(part) == found[: len(part)], (hits, together)


def test_many_blocks_in_one_pass(spark, sf, monkeypatch):
    from plumbline.llm import decontaminate

    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(find(docs, bench))
    monkeypatch.setattr(decontaminate, "BLOCK", 1000)
    parts = find(docs, bench)
    assert key(parts) == whole and parts._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_decontamination_blocks(spark, odd):
    docs, bench = spark.read.parquet(f"{odd}/documents.parquet"), spark.read.parquet(f"{odd}/benchmark.parquet")
    got = find(docs.select("doc_id", "text"), bench).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 2, 3, None]


def main_text(page):
    blocks, found = html_extract.parse(page)
    top = html_extract.best(found)
    return "\n".join(t for i, (t, d) in enumerate(blocks) if top[2] <= i < top[3] and d <= top[1]) if top else ""


def test_html():
    page = """<html><head><title>T</title></head><body><header><a href=/>Home</a></header><nav><ul><li><a>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><main><article class="post-12"><h1>Head &amp; line</h1><p>One <b>two</b>&nbsp;three<p>Four
    five.<script>var t="</p>";</script><div class=ad>Buy</div><form><p>Mail</p></form></article><section id="comments"><p>First!</p></section></main>
    <aside><p>Side</p></aside><footer>(c)</footer></body></html>"""
    assert main_text(page) == "Head & line\nOne two three\nFour five."
    assert html_extract.best(html_extract.parse(page)[1])[0] == "body>main>article.post-"
    assert html_extract.parse("") == ([], []) and main_text("plain &lt;b&gt;") == "plain <b>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title=it's>Hello</p><p>don't</p><p>end</p>", "Hello\ndon't\nend"),
        ('<div class="content no-sidebar"><p>All of it</p></div>', "All of it"),
        ('<div id="content" class="has-sidebar"><p>All of it</p></div>', "All of it"),
        ('<article class="post comments-open"><p>All of it</p></article>', "All of it"),
        ("<article><p>x <math><mi>a</mi></math> y</p></article>", "x a y"),
        ("<body><form id=page><div class=c><p>Long text</p></div></form></body>", "Long text"),
        ('<article><p>Text</p><div class="share-box"><p>Tell friends</p></div><ul class=comments><li>Nice!</ul></article>', "Text"),
    ],
)
def test_class_words_are_evidence_only(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", ["<a " * 12000, "<div>" * 3000 + "x" + "</div>" * 3000, "<div><span>" * 6000 + "</b>" * 6000, '<a title="' * 12000, "<!--" * 20000, "<p><b>" * 10000, "<script>" * 5000])
def test_html_takes_linear_time(page):
    import time

    began = time.perf_counter()
    html_extract.parse(page)
    assert time.perf_counter() - began < 2


def test_clean_pages_against_a_plain_reading(spark, sf):
    """On pages whose article is marked, the text is what cutting it out by hand gives."""
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    out = {r.page_id: r for r in QUERIES["op8_html_extract"](spark, sf).collect()}
    assert len(out) == len(pages)
    for r in pages:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<b>", "").replace("</b>", "").replace("<br>", " ")
        lines = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert out[r.page_id].text == "\n".join(x for x in lines if x) and out[r.page_id].n_chars == len(out[r.page_id].text)


def test_host_consensus(spark):
    """The host's path decides where a page's own best container is another one."""
    good = "<body><div class='c1'><p>" + "real text of this page " * 20 + "</p></div><div class='x2'><p>{}</p></div></body>"
    pages = [(i, f"http://h.com/{i}", good.format("short")) for i in range(5)] + [(9, "http://www.h.com/9", good.format("odd words of a box " * 400))]
    df = spark.createDataFrame([*pages, (10, "http://other.com/", good.format("odd words of a box " * 400))], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert "odd words" not in out[9] and out[9].startswith("real text") and out[10].startswith("odd words")
    alone = {r.page_id: r.text for r in html_extract.extract(df, vote=False).collect()}
    assert alone[9].startswith("odd words") and alone[1] == out[1]
    assert {r.page_id: r.text for r in html_extract.extract(df, broadcast_bytes=0).collect()} == out


def test_chat_round_trip(spark, odd):
    r = {x.conv_id: x for x in QUERIES["op9_chat_format"](spark, odd).collect()}
    flat = "user\na<|im_end|>\nb\nassistant\n\nassistant\nx<n|y<\\|\n"
    assert r[1].turns_sha256 == hashlib.sha256(flat.encode()).hexdigest() and r[1].loss_chars == 8
    assert r[None].turns_sha256 == hashlib.sha256(b"us\ner\nq\n").hexdigest() and r[2].n_turns == 1


def test_reply_trees(spark):
    rng, rows = random.Random(3), []
    for t in range(10):
        for i in range(rng.randint(1, 30)):
            rows.append((f"t{t}", i, None if i == 0 or rng.random() < 0.05 else rng.randrange(max(0, i - 3), i), float(rng.randint(0, 5))))
    expected = set()
    trees = {}
    for t, n, p, s in rows:
        trees.setdefault(t, {})[n] = (p, s)
    for t, m in trees.items():
        inner, found = {p for p, _ in m.values()}, []
        for n in m:
            path, x = [], n
            while n not in inner and x is not None:
                path.append(x)
                x = m[x][0]
            if path:
                found.append((-sum(m[x][1] for x in path), n, path[::-1]))
        expected |= {(t, n, x, i + 1) for _, n, path in sorted(found)[:2] for i, x in enumerate(path)}
    got = chat_format.paths(spark.createDataFrame(rows, "tree string, node long, parent long, score double"), 2)
    assert {tuple(r) for r in got.select("tree", "path", "node", "depth").collect()} == expected


def test_ring(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    out = sharding.shard(rows, F.col("k"), F.col("id")).toPandas()
    counts = out.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] + 1 == counts["nunique"]).all() and (counts["min"] == 0).all()
    a = sharding.shard(rows, F.col("id"), F.col("id"), 16, 0.25).toPandas().set_index("id").shard
    b = sharding.shard(rows, F.col("id"), F.col("id"), 17, 0.25).toPandas().set_index("id").shard
    assert (a != b).mean() < 0.25


def test_ring_keeps_equal_rows_apart(spark):
    """Rows without an id, and repeated rows, are dealt to many cells; slots stay gapless."""
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("id"), F.lit(7).alias("k"))
    placed = rows.select(F.pmod(F.xxhash64(F.coalesce("id", F.lit(-1)), F.monotonically_increasing_id()), F.lit(64)).alias("c"))
    assert placed.distinct().count() == 64
    out = sharding.shard(rows, F.col("k"), F.coalesce("id", F.lit(-1))).toPandas()
    assert all(sorted(g) == list(range(250)) for _, g in out.groupby("shard").slot) and len(out) == 4000


def test_overflow_continues_clockwise():
    """The spans of each arc against a walk that puts single keys one turn at a time."""
    rng = random.Random(2)
    owners = [rng.randrange(4) for _ in range(12)]
    loads = [rng.randrange(9) for _ in range(12)]
    n = sum(loads)
    capacity = [n // 4 + (s < n % 4) for s in range(4)]
    spans = sharding.assign(loads, owners, capacity)
    room, left, expected = list(capacity), list(loads), [[] for _ in loads]
    for turn in range(4):
        for a in range(12):
            walk = list(dict.fromkeys(owners[(a + b) % 12] for b in range(12)))
            walk += [s for s in range(4) if s not in walk]
            while left[a] and room[walk[turn]]:
                expected[a].append(walk[turn])
                left[a] -= 1
                room[walk[turn]] -= 1
    assert [[s for s, k in x for _ in range(k)] for x in spans] == expected and room == [0] * 4


@pytest.mark.parametrize("rows", ("odd", "none"))
def test_stages_on_odd_tables(spark, odd, rows):
    """Nulls, empty and long texts, repeats, clashing and dotted names, and no rows at all."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet").withColumn("a.b", F.lit(1)).withColumn("length", F.lit("x"))
    docs = docs.limit(0) if rows == "none" else docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns
        kept[name] = sorted((r.doc_id for r in out.collect()), key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, odd)
    if rows == "none":
        assert not any(kept.values()) and packed.count() == 0
        return
    rules = kept["quality_rules"]  # the long text outweighs the others in the reference, so plain ones may go: all or none
    assert not {4, 5, 6, 8} & set(rules) and (1 in rules) == (2 in rules) == (None in rules)
    # One of the plain texts, their variant is under the limit or gone, one of the empty ones, one of the long ones.
    near = kept["simhash_near_dedup"]
    assert near.count(6) == 1 and 1 in near and not {2, None} & set(near) and len({4, 5, 8} & set(near)) == 1
    assert kept["benchmark_decontamination"] == [4, 5, 6, 6, 7, 8]
    assert packed.where("doc_id IN (4, 5)").count() == 2 and packed.select("doc_id").distinct().count() == 9


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, sf).count() > 0
