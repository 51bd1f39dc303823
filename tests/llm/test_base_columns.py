"""Columns that the queries' contracts define, counted again in plain Python on a driver's table."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import quality_rules
from plumbline.llm.queries import QUERIES
from plumbline.llm.textstats import CLASSES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_license_base_columns(spark, sf, docs):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for r in QUERIES["op5_license_scan"](spark, sf).collect():
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(docs[r.doc_id].text))
        at = [(i, label) for p, label in phrases.items() for i in range(len(ws)) if tuple(ws[i : i + len(p)]) == p]
        found = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
        assert found == (len(ws), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_shards(spark, sf, docs):
    out = QUERIES["op10_sharding"](spark, sf).collect()
    own, texts = defaultdict(list), defaultdict(set)
    for r in out:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None) and 0 <= r.shard < 16
        own[r.shard].append(r.slot)
        texts[raw].add(r.shard)
    assert len(out) == len(docs) and all(sorted(s) == list(range(len(s))) for s in own.values())
    assert max(map(len, own.values())) - min(map(len, own.values())) <= 1
    assert sum(len(s) == 1 for s in texts.values()) > 0.9 * len(texts)  # copies lie together, but where a shard is full


def test_quality_rules_from_their_definition(spark, sf, docs):
    """Histograms, references, distances and verdicts again, outside Spark."""
    sets = {"accent": range(0xC0, 0x250), "upper": range(65, 91), "digit": range(48, 58), "stop": map(ord, ".,"), "symbol": map(ord, "#*$%&|<>"), "punct": range(0x21, 0x7F)}
    kind = {c: "other" for c in ()}
    for name in reversed(list(sets)):
        kind.update(dict.fromkeys(sets[name], name))
    kind.update(dict.fromkeys(range(97, 123), "lower"))
    kind.update(dict.fromkeys((32, *range(9, 14)), "space"))
    order = [*CLASSES, "other"]
    hist, shares = {}, defaultdict(lambda: [np.zeros(len(order)), np.zeros(len(quality_rules.BINS) + 1)])
    for i, r in docs.items():
        text = r.text or ""
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        c, w = Counter(kind.get(ord(ch), "other") for ch in text), Counter(ws)
        common = [w[b] for b in quality_rules.BINS]
        hist[i] = np.array([c[k] for k in order], float), np.array([*common, len(ws) - sum(common)], float), len(text), ws
        if r.lang in quality_rules.COMMON:
            shares[r.lang][0] += hist[i][0]
            shares[r.lang][1] += hist[i][1]
    refs = [[x / x.sum() for x in s] for s in shares.values() if s[0].sum() and s[1].sum()]

    def js(p, q):
        m = (p + q) / 2
        part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return np.sqrt(max(0.0, (part(p) + part(q)) / 2))

    for r in QUERIES["op7_quality_rules"](spark, sf).collect():
        h, w, n_chars, ws = hist[r.doc_id]
        h, w = h / max(1, h.sum()), w / max(1, w.sum())
        js_class, js_words = min([1.0, *(js(h, ref[0]) for ref in refs)]), [js(w, ref[1]) for ref in refs]
        assert r.js_class == pytest.approx(js_class, abs=1e-9) and r.js_word == pytest.approx(min([1.0, *js_words]), abs=1e-9)
        bounds = [js(np.append(ref[1][:-1] * 0.1, 1 - 0.1 * ref[1][:-1].sum()), ref[1]) for ref in refs]
        far = all(d > b for d, b in zip(js_words, bounds, strict=True))
        assert r.n_symbols == sum(ch in "#*$%&|<>" for ch in docs[r.doc_id].text or "") and r.n_words == len(ws)
        assert r.kept == (not r.base_failed and not (n_chars >= 300 and js_class > 0.25) and not (len(ws) >= 50 and far))
