"""op11 to op13 against brute force or SQL, and on odd tables."""

import hashlib
import math
import os
import re
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pandas as pd
import pytest

from platewise.llm import context_tree, filter_audit, resample
from platewise.llm import queries as registered
from tests.conftest import SMALL

needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
DOCS = "doc_id bigint, text string, source string, score double, part int, n bigint"


def frame(spark, rows):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, s, 0.5, 1, 9) for i, t, s in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + [None]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


class Sequential:
    """Context-tree weighting by its definition: probabilities of whole trees, with and without the next bit."""

    def __init__(self, streams, depth):
        self.depth, self.counts, self.kids = depth, {}, {}
        for s in streams:
            for i in range(depth, len(s)):
                for node, bit in self.bits(s[i]):
                    for d in range(depth + 1):
                        ctx = s[i - d : i]
                        self.counts.setdefault((ctx, node), [0, 0])[bit] += 1
                        if d < depth:
                            self.kids.setdefault((ctx, node), set()).add(s[i - d - 1 : i])

    @staticmethod
    def bits(byte):
        return [((1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1) for k in range(8)]

    @lru_cache(None)
    def tree(self, ctx, node, path=None, bit=None):
        a, b = self.counts.get((ctx, node), (0, 0))
        kids = set(self.kids.get((ctx, node), ()))
        if path is not None:
            a, b = a + (bit == 0), b + (bit == 1)
            if len(ctx) < self.depth:
                kids.add(path[len(path) - len(ctx) - 1 :])
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(ctx) == self.depth:
            return own
        below = sum(self.tree(k, node, path, bit) if path is not None and path.endswith(k) else self.tree(k, node) for k in kids)
        return np.logaddexp(own, below) + math.log(0.5)

    def log10(self, s):
        total = 0.0
        for i in range(self.depth, len(s)):
            for node, bit in self.bits(s[i]):
                total += self.tree(b"", node, s[i - self.depth : i], bit) - self.tree(b"", node)
        return total / math.log(10)


TEXTS = ["the cat  sat on the mat", "The cat sat\non the hat", "a Été à côté", "", None, "the cat", "xyzzy the the the", "the dog sat", "THE CAT SAT ON THE MAT", "   \t\n", "dogs\x1cand cats", "mat hat"]


@pytest.mark.parametrize("depth", [2, 5])
def test_context_tree_is_the_weighted_tree(spark, depth):
    rows = [(k, t, "s") for k, t in enumerate(TEXTS)] + [(None, "the cat sat", "s"), (3, "", "s")]
    got = context_tree.score(frame(spark, rows), depth=depth).collect()
    assert len(got) == len(rows)
    streams = {t: b"\xff" * depth + b" ".join(w.encode() for w in tokens(t)[:-1]) + b"\xff" for _, t, _ in rows}
    model = Sequential([streams[t] for i, t, _ in rows if not is_held(i)], depth)
    seen = [w for i, t, _ in rows if not is_held(i) for w in tokens(t)]
    counts = {w: seen.count(w) for w in seen}
    want = []
    for i, t, _ in rows:
        ws = tokens(t)
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (len(seen) + 0.5 * (len(counts) + 1))) for w in ws)
        want.append((str(i), is_held(i), len(ws), sum(w in counts for w in ws), len(seen), round(base, 6), round(model.log10(streams[t]), 4)))
    assert any(is_held(i) for i, _, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)) for r in got) == sorted(want)


def test_context_tree_bits_are_probabilities():
    """All bytes after one context have a total probability of 1."""
    rng = np.random.default_rng(5)
    some = rng.integers(0, 6, 400).astype(np.uint8).tobytes()
    g, n = np.unique(context_tree.grams_of([(0, some)], 3)[0], return_counts=True)
    every = np.unique(np.concatenate([g, (g[0] & ~np.uint64(255)) + np.arange(256, dtype=np.uint64)]))
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, g)] = n
    top = (np.full(1 << 16, 0.25), np.full(1 << 16, 0.5))  # what lies above leaves room for both bits
    p = 10 ** context_tree.log_probabilities(every, counts, top, 3)
    assert abs(p[(every >> np.uint64(8)) == (g[0] >> np.uint64(8))].sum() - 1) < 1e-9


def test_context_tree_stretches_cut_nothing(monkeypatch):
    bodies = [b"abcdefghij" * 7, b"", b"xy", b"k" * 50]
    whole = [context_tree.grams_of([(k, b"\xff" * 4 + b + b"\xff")], 4)[0].tolist() for k, b in enumerate(bodies)]
    monkeypatch.setattr(context_tree, "STRETCH", 8)
    monkeypatch.setattr(context_tree, "CHUNK", 30)
    got = [[] for _ in bodies]
    for pieces in context_tree.stretches(bodies, 4):
        g, first = context_tree.grams_of(pieces, 4)
        for (k, _), part in zip(pieces, np.split(g, first[1:])):
            got[k] += part.tolist()
    assert got == whole


def test_context_tree_lookup():
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000).astype(np.uint64))
    values = np.arange(len(grams), dtype=np.float32)
    assert (context_tree.Lookup(grams, values)(grams[::-1]) == values[::-1]).all()


def test_context_tree_without_rows_or_learning(spark):
    assert context_tree.score(frame(spark, [])).collect() == []
    held = next(i for i in range(99) if is_held(i))
    (r,) = context_tree.score(frame(spark, [(held, "ab", "s")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and abs(r.score - 24 * math.log10(0.5)) < 1e-6 and r.base_score == 0


@needs_tables
def test_op11_on_whole_tables(spark):
    got = registered.QUERIES["op11_context_tree"](spark, SMALL).toPandas()
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    counts, n = {}, 0
    for i, t in zip(docs.doc_id, docs.text):
        if not is_held(i):
            for w in tokens(t):
                counts[w], n = counts.get(w, 0) + 1, n + 1
    texts = dict(zip(docs.doc_id, docs.text))
    assert sorted(got.doc_id) == sorted(texts) and set(got.train_tokens) == {n}
    for r in got.itertuples():
        ws = tokens(texts[r.doc_id])
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (len(counts) + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.held_out) == (len(ws), sum(w in counts for w in ws), is_held(r.doc_id)) and abs(base - r.base_score) < 1e-6
    # learned texts cost less than unseen ones, and these far less than letters drawn evenly
    long = got[got.n_tokens > 50]
    assert long[~long.held_out].bits_per_byte.median() < long[long.held_out].bits_per_byte.median() < 2.6


def oracle(documents, labels):
    c = duckdb.connect()
    c.register("documents", documents)
    c.register("labels", labels)
    return c.sql(filter_audit.ORACLE).df()


def same_rows(a, b):
    keys = ["part", "filter_order", "step"]
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (a, b[list(a.columns)]))
    return len(a) == len(b) and a.astype(str).equals(b.astype(str))


@needs_tables
@pytest.mark.parametrize("sf", [SMALL, SMALL.replace("0.001", "0.01")])
def test_op12_equals_sql(spark, sf):
    got = registered.QUERIES["op12_filter_audit"](spark, sf).toPandas()
    assert same_rows(got, oracle(*(pd.read_parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))))


def test_filter_audit_on_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(250))
    rows = [(1, "HELLO " * 5, "a"), (2, None, None), (3, "", ""), (4, "cash $ now", "a"), (5, long, "b"), (6, long, "a"), (6, long, "a"), (7, "word " * 300, "b"), (8, "é" * 60 + " A B", "b"), (9, long, None), (10, "#" + long, "a")]
    labels = spark.createDataFrame([(6, 1, 0), (5, 0, 1), (4, 0, 1), (4, 1, 0), (99, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, rows)
    got = filter_audit.audit(filter_audit.cells(docs, labels)).toPandas()
    assert same_rows(got, oracle(docs.toPandas(), labels.toPandas()))
    assert len(got) == 3 * 600 and (got.groupby(["part", "filter_order"]).removed.sum() + got[got.step == 5].set_index(["part", "filter_order"]).kept).nunique() <= 3
    # rows without an id: no copies, no labels
    free = filter_audit.audit(filter_audit.cells(frame(spark, [(None, long, "a"), (None, long, "a"), (1, long, "a")]), labels)).toPandas()
    assert set(free.kept) == {3} and set(free.good_lost) == {0}
    assert filter_audit.audit(filter_audit.cells(frame(spark, []), labels)).count() == 0


def test_potentials_are_shapley_values():
    """Potentials against the mean over all orders, on random games."""
    rng = np.random.default_rng(3)
    v = filter_audit.coalition_counts(rng.integers(0, 50, 32))
    p = filter_audit.potentials(v)
    sums = [0] * 5
    for _, _, before, i in filter_audit.STEPS:
        sums[i] += v[before | 1 << i] - v[before]
    assert [p[31] - p[31 & ~(1 << i)] for i in range(5)] == sums and len(filter_audit.STEPS) == 600


def brute_resample(docs, target, min_words=20):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    found = {k: features(t) for k, (_, t) in enumerate(docs)}
    s, t = [0] * 10000, [0] * 10000
    for _, f in found.values():
        for b in f:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out = []
    for k, (i, _) in enumerate(docs):
        n, f = found[k]
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, n])
    able = sorted((r for r in out if r[5] >= min_words and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@needs_tables
@pytest.mark.parametrize("sf", [SMALL, SMALL.replace("0.001", "0.01")])
def test_op13_equals_brute_force(spark, sf):
    d, b = (pd.read_parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = [tuple(r) for r in registered.QUERIES["op13_resample"](spark, sf).collect()]
    assert sorted(got, key=str) == brute_resample(list(zip(d.doc_id, d.text)), b.text)


def test_resample_on_odd_rows(spark):
    words = "Ünder the tree-top 2 Birds SING loudly, never\x7fminding @all of the cats that wait below for one to fall down now"
    rows = [(1, words), (2, None), (3, ""), (4, "one"), (None, words), (5, words.upper()), (6, words), (6, words), (7, "日本 語 " * 30), (8, "a " * 25), (-9, words * 3)]
    target = spark.createDataFrame([("birds sing in trees", 1), (None, 2)], "text string, item_id int")
    out = resample.resample(frame(spark, [(i, t, "s") for i, t in rows]), target)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == brute_resample(rows, ["birds sing in trees", None])
    drawn = resample.sample(frame(spark, [(i, t, "s") for i, t in rows]), target)
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r in got if r[4] is not None}
    empty = frame(spark, [])
    assert resample.resample(empty, target).count() == 0 and resample.resample(frame(spark, [(1, words, "s")]), target.where("item_id > 5")).count() == 1


def test_resample_stretches(monkeypatch):
    text = " ".join(f"w{k}" for k in range(500)).encode()
    (whole,) = [f for _, f in resample.buckets(text, lengths=3)]
    monkeypatch.setattr(resample, "STRETCH", 40)
    parts = list(resample.buckets(text, lengths=3))
    assert len(parts) > 10 and sum(n for n, _ in parts) == 500
    assert sorted(np.concatenate([f for _, f in parts]).tolist()) == sorted(whole.tolist())


ARTICLE = "<html><body><nav><a href=/>Home</a></nav>{}<footer>© all of us</footer></body></html>"


def main_texts(pages):
    from functools import reduce

    from platewise.llm import wrapper

    host = wrapper.Host(reduce(wrapper.merge, [wrapper.skeleton(wrapper.tree(p)) for p in pages]))
    return [wrapper.Fit(wrapper.tree(p), host).text() for p in pages]


@pytest.mark.parametrize("n", [2, 3, 4, 6])
def test_wrapper_keeps_constant_article_text(n):
    quote = [ARTICLE.format(f"<article><h1>T{i}</h1><p>Text {'abc ' * i} of page {i}.</p><blockquote>Note for all readers here.</blockquote></article>") for i in range(n)]
    assert main_texts(quote) == [f"T{i}\nText {'abc ' * i} of page {i}.\nNote for all readers here.".replace("  ", " ") for i in range(n)]
    body = "<p>The same long body on every page.</p><p>And its second paragraph.</p>"
    for box in ("<article><h1>Title {}</h1>{}</article>", "<div><h1>Title {}</h1>{}</div>"):
        pages = [ARTICLE.format(box.format(i, body)) for i in range(n)]
        assert main_texts(pages) == [f"Title {i}\nThe same long body on every page.\nAnd its second paragraph." for i in range(n)]


def test_wrapper_cuts_comments_and_menus_inside_the_part():
    pages = [
        ARTICLE.format(
            f"<div><div><a href=/a>First</a> <a href=/b>Second</a></div><h1>T{i}</h1><p>Body {'xyz ' * (i + 9)}{i}.</p><section class=discuss><div><span>Ann</span> I liked {i}</div><div><span>Bob</span> So did I {i}</div></section></div>"
        )
        for i in range(6)
    ]
    assert main_texts(pages) == [f"T{i}\nBody {'xyz ' * (i + 9)}{i}." for i in range(6)]


@needs_tables
def test_op9_equals_a_plain_reading_of_article_elements(spark):
    """Against another extractor: the article element, its blocks by tags, without what HTML sets apart."""
    from html.parser import HTMLParser

    blocks = "p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre div section article table tr td th dl dt dd header".split()
    skipped = "script style nav footer aside form noscript template svg iframe button select".split()

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.now, self.inside, self.shut = [], "", 0, []

        def flush(self):
            text = " ".join(self.now.split())
            if text:
                self.out.append(text)
            self.now = ""

        def handle_starttag(self, tag, attrs):
            words = set(re.findall("[a-z]+", (dict(attrs).get("class") or "").lower()))
            if self.shut or tag in skipped or words & {"ad", "ads", "comments", "comment", "share", "related", "promo", "newsletter"}:
                if tag not in ("br", "img", "hr", "input", "meta", "link"):
                    self.shut.append(tag)
                return
            if tag in blocks:
                self.flush()
            if tag == "br":
                self.now += " "
            self.inside += tag == "article"

        def handle_endtag(self, tag):
            if self.shut:
                if tag in self.shut:
                    while self.shut.pop() != tag:
                        pass
                return
            if tag in blocks:
                self.flush()
            if tag == "article":
                self.inside -= 1

        def handle_data(self, data):
            if self.inside and not self.shut:
                self.now += data

    got = {r.page_id: r.text for r in registered.QUERIES["op9_wrapper"](spark, SMALL).collect()}
    pages = pd.read_parquet(f"{SMALL}/pages.parquet")
    same = 0
    for i, page in zip(pages.page_id, pages.html):
        reader = Reader()
        reader.feed(page or "")
        reader.flush()
        same += got[i] == "\n".join(reader.out)
    assert len(got) == len(pages) and same >= 0.98 * len(pages)


def test_decontam_items_need_no_dense_matrix():
    """A block of real size: sparse products equal dense ones, within a small part of the dense matrix's memory."""
    import tracemalloc

    from platewise.llm import decontam

    rng = np.random.default_rng(2)
    few = decontam.Items([(i, " ".join(f"w{k}" for k in rng.integers(0, 60, 9))) for i in range(20)])
    dense = np.zeros((20, len(few.terms)))
    for r, (at, tf) in enumerate(few.rows()):
        dense[r, at] = tf
    idf, w = rng.random(len(few.terms)), rng.standard_normal((len(few.terms), 5))
    rows = dense * idf / np.linalg.norm(dense * idf, axis=1, keepdims=True)
    assert np.allclose(few.times(w), dense @ w) and np.allclose(few.turned(few.times(w, idf), idf), rows.T @ (rows @ w))
    items = decontam.Items([(i, " ".join(f"w{k}" for k in rng.integers(0, 50_000, 32))) for i in range(4096)])
    assert len(items.terms) > 40_000
    tracemalloc.start()
    w = np.ones((len(items.terms), 112))
    decontam.Block(items, np.ones(len(items.terms)), w[:, :96])
    items.turned(items.times(w, np.ones(len(items.terms))), np.ones(len(items.terms)))
    assert tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()


@needs_tables
def test_op8_finds_items_that_documents_hold(spark):
    """Every item that stands word for word in a document of the given tables is found there."""
    from platewise.llm.decontam import words

    sf = SMALL.replace("0.001", "0.01")
    docs, items = (pd.read_parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {i: b" " + b" ".join(words(t)) + b" " for i, t in zip(docs.doc_id, docs.text)}
    held = {(d, i) for i, t in zip(items.item_id, items.text) for d, x in texts.items() if words(t) and b" " + b" ".join(words(t)) + b" " in x}
    got = {(r.doc_id, r.item_id) for r in registered.QUERIES["op8_decontam"](spark, sf).collect()}
    assert held and len(held & got) >= 0.98 * len(held)
    print(len(held), len(held & got), len(got))


def test_latent_space_sees_every_document(spark):
    """The sums of the one pass are those of all term sets, and the space is that of the whole matrix."""
    import numpy as np

    from platewise.llm import decontam as D

    rng = np.random.default_rng(3)
    topics = rng.permutation(240).reshape(6, 40)
    text = lambda n: " ".join(f"w{k}" for k in rng.choice(topics[rng.integers(6)], n))
    rows = [(i, text(25)) for i in range(5000)] + [(5000, None), (5001, ""), (5002, "none of them")]
    items = D.Items([(i, text(20)) for i in range(30)])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    df, n, sums, _ = D._statistics(docs, [items])
    b = np.zeros((len(rows), len(items.terms)))
    for d, (_, t) in enumerate(rows):
        b[d, [items.index[w] for w in set(D.words(t)) if w in items.index]] = 1
    counts = np.array([df[t] for t in items.terms])
    assert n == len(rows) and (counts == b.sum(0)).all()
    g = b.T @ (b / np.maximum(b.sum(1, keepdims=True), 1))
    got = np.zeros((len(items.terms), D._width(items) + 1))
    for r in sums.where("block = 0").collect():
        got[r.term] = r.g
    assert np.allclose(got[:, -1], np.diag(g), rtol=1e-4) and np.allclose(got[:, :-1], g @ D._test_matrix(items, D._width(items)), rtol=1e-3, atol=1e-2)
    idf = np.log((n + 1) / (counts + 0.5))
    q = np.stack([D.unit(np.bincount([items.index[w] for w in ws], minlength=len(idf)) * idf) for ws in items.words])
    m = idf[:, None] * g * idf + np.trace(idf[:, None] * g * idf) / len(q) * q.T @ q
    space = D.latent_space(sums, 0, items, idf)
    best = np.sort(np.linalg.eigvalsh(m))[::-1][: space.shape[1]].sum()
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-6) and np.trace(space.T @ m @ space) > 0.95 * best


def test_running_sums_are_the_same_in_parts():
    import numpy as np

    from platewise.llm import decontam as D

    rows = np.random.default_rng(1).standard_normal((1000, 7)).astype(np.float32)
    want = np.vstack([np.zeros((1, 7), np.float32), np.cumsum(rows, axis=0)])
    assert (D._running(rows.copy(), 64) == want).all() and (D._running(rows.copy(), 1000) == want).all()
    assert D._running(rows[:0]).shape == (1, 7)
