"""The training-data operators against brute force, and on nulls, ties, empties and clashing columns."""

import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platewise.llm import bpe, chat, decontam, jaccard, licenses, merkle, sharding, toxicity, url_filter, wrapper
from tests.conftest import SMALL

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string, _bucket int"
ODD = [
    (1, "One two three four. Five six!\nSeven", "en", "a"),
    (2, "One two three four. Five six!\nSeven", "en", "a"),
    (2, "One two three four. Five six!\nSeven", "en", "a"),
    (3, "", None, None),
    (4, None, "en", "b"),
    (None, "no id here at all", "de", "b"),
    (5, "word " * 30_000, "en", "c"),
    (6, "é✓😀  x", "fr", "c"),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(*r, 0, 0.5, "n", 1) for r in rows], DOC)


def brute_components(texts, n, percent):
    sets = [frozenset(jaccard.shingle_set(t, n).tolist()) for t in texts.values()]
    ids, parent = list(texts), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(ids[i]), find(ids[j])))
                parent[b] = a
    return {i: find(i) for i in ids}


def near_copies(seed=1):
    """Groups of edited copies, exact copies and loners, with a phrase that all share."""
    rnd, out = random.Random(seed), {}
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    for g in range(6):
        base = [word() for _ in range(rnd.randint(20, 60))]
        for _ in range((3, 90, 8, 2, 1, 5)[g]):
            w = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2))):
                w[rnd.randrange(len(w))] = word()
            out[len(out) * 7 % 1009 + 10] = " ".join(["all of them say this"] + w)
    out |= {2000: "a b", 2001: "a  B", 2002: "", 2003: None, 2004: "a b c"}
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, n, percent):
    texts = near_copies()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, n, percent).collect()}
    assert got == brute_components(texts, n, percent)


def test_jaccard_of_a_phrase_in_many_unrelated_texts(spark):
    """A hot token: all texts share a long phrase, in many sizes; few are alike."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    phrase = " ".join(word() for _ in range(12))
    texts = {}
    for g in range(70):
        base = [phrase, *(word() for _ in range(rnd.choice((1, 2, 9, 30, 31, 33))))]
        for _ in range(rnd.choice((1, 1, 2))):
            texts[len(texts)] = " ".join([*base[:-1], word()] if rnd.random() < 0.5 else base)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for n, percent in ((3, 90), (5, 80), (3, 100)):
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, n, percent).collect()}
        assert got == brute_components(texts, n, percent)
    sizes = [(a, b) for a in range(1, 400) for b in range(a, 400) if a * 100 >= b * 90]
    rows = spark.range(1, 400).select(F.col("id").alias("n"), jaccard._size_class(F.col("id"), 90).alias("c")).collect()
    c = {r.n: r.c for r in rows}
    assert all(abs(c[a] - c[b]) <= 1 for a, b in sizes)


def test_jaccard_odd_rows(spark):
    r = jaccard.near_duplicates(docs(spark), 3, 90).collect()
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in r}
    assert len(r) == len(ODD) and (2, 5, 1) in got and (3, 0, 3) in got and (4, 0, 4) in got and (None, 3, None) in got and (5, 1, 5) in got
    assert sorted(x.doc_id for x in jaccard.one_of_each(docs(spark)).where("doc_id is not null").collect()) == [1, 3, 4, 5, 6]
    assert jaccard.near_duplicates(docs(spark).limit(0)).count() == 0


def test_bpe_round_trip(spark):
    import public_tokenizers

    enc = bpe.encoder(open(public_tokenizers.path(bpe.RANKS), "rb").read())
    texts = [t or "" for _, t, *_ in ODD] + ["x" * 5000, "  a  b \n\n c" * 9000, "<|endoftext|>"]
    for t in texts:
        assert bpe.encode(enc, t, 64) == enc.encode_ordinary(t)
        assert bpe.decode(enc, bpe.encode(enc, t)).decode() == t
    space = [f"{a}{c * n}{b}" for a in ("", "x", "!\x1c", "é") for c in (" ", "\n", " \n", "\u3000", "\x1c") for n in (4095, 4096, 9000) for b in ("", "y", " ", "\x1f", "'s")]
    for t in [*space, "a" + " " * 5000 + "b\x1cc !\x1d\x1d d" * 900]:
        assert bpe.encode(enc, t, 64) == enc.encode_ordinary(t)
    for c in (" ", "\n", "a", "!", "\u0301"):  # longer than the library's pattern can take, where it is white space
        assert bpe.decode(enc, bpe.encode(enc, "x" + c * 2_000_000 + "y")).decode() == "x" + c * 2_000_000 + "y"
    for r, (i, t, *_) in zip(bpe.digests(docs(spark).coalesce(1)).collect(), ODD):
        ids = enc.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    e = bpe.decode_frame(bpe.encode_frame(docs(spark), exact="ok")).collect()
    assert all(r.ok and bytes(r.bytes).decode() == (r.text or "") for r in e)
    assert bpe.digests(docs(spark).limit(0)).count() == 0


def test_merkle(spark):
    got = sorted(merkle.compare_with_next(docs(spark)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    rows = sorted(((i, t or "") for i, t, *_ in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (r, (i, t)) in enumerate(zip(got, rows)):
        n, nxt = len(t), rows[(k + 1) % len(rows)][1]
        e = t[: n - n // 4] + nxt[: n // 4]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, n, hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0 and by[3].near_next == 1.0
    assert merkle.compare_with_next(docs(spark, ODD[:1])).first().near_next == 1.0
    assert merkle.compare_with_next(docs(spark).limit(0)).count() == 0


def brute_tree(text):
    """Root and sections of a text, each section a digest and its leaves (digest, length)."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out, run = [], ""
    for p in text.split("\n"):
        small = len(p) < 100
        pieces = re.findall(r"(?s).{1,10}", p) if small else re.findall(r"(?s)[^.!?]{1,160}[.!?]*|[.!?]+", p)
        line = ",".join(f"{sha(x)[:16]}.{len(x)}" for x in pieces)
        digest = sha(line)[:16]
        run += f"{line}:{digest};"
        if digest[-1] in "048c":
            out.append(run)
            run = ""
    out += [run] if run else []
    body = "|".join(f"{sha(x)[:16]}>{x}" for x in out)
    return sha(body), [f"{sha(x)[:16]}>{x}" for x in out]


def brute_likeness(a, b):
    (ra, sa), (rb, sb) = brute_tree(a), brute_tree(b)
    if ra == rb:
        return 1.0
    weigh = lambda nodes: {m: int(m.split(".")[1]) for m in re.findall(r"[0-9a-f]{16}\.[0-9]+", "|".join(nodes))}
    same = sum(weigh([x for x in sa if x in sb]).values())
    la, lb = weigh([x for x in sa if x not in sb]), weigh([x for x in sb if x not in sa])
    whole = 2 * same + sum(la.values()) + sum(lb.values())
    return 2.0 * (same + sum(v for k, v in la.items() if k in lb)) / whole if whole else 0.0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_merkle_query_equals_brute_force(spark):
    d = pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id")
    texts = dict(zip(d.doc_id, d.text.fillna("")))
    ids = list(texts)
    got = {r.doc_id: r for r in merkle.op3_merkle(spark, SMALL).collect()}
    assert len(got) == len(ids)
    for i, k in enumerate(ids):
        t, n = texts[k], texts[ids[(i + 1) % len(ids)]]
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        r = got[k]
        assert r.fingerprint.startswith(brute_tree(t)[0] + "|") and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.near_edited == pytest.approx(brute_likeness(t, e)) and r.near_next == pytest.approx(brute_likeness(t, n))
        assert r.near_edited >= 0.4 or len(t) < 30
    equal = d.groupby(d.text.fillna("")).doc_id.apply(list)
    assert all(len({got[x].fingerprint for x in g}) == 1 for g in equal)


def test_merkle_range_of_key(spark):
    bounds = sorted(random.Random(1).sample(range(10_000), 1000))
    df = spark.range(0, 10_100, 7)
    got = df.select("id", merkle._range_of(F.col("id"), bounds).alias("n"), merkle._range_of(F.col("id"), bounds[:9]).alias("m")).collect()
    assert all(r.n == sum(b <= r.id for b in bounds) and r.m == sum(b <= r.id for b in bounds[:9]) for r in got)


def test_merkle_ranges_and_edits(spark):
    d = spark.createDataFrame([(i * i % 997, f"Text number {i}. It goes on.\nAnd ends {i}.") for i in range(200)], "doc_id bigint, text string").dropDuplicates(["doc_id"])
    base = d.select("doc_id", F.col("text").alias("_text"))
    rows = sorted((r.doc_id, r._text) for r in base.collect())
    got = {r.doc_id: r.next__text for r in merkle.next_rows(base, "doc_id", ["_text"], rows_per_range=13).collect()}
    assert got == {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    a, b = "One. Two.\n\nThree.\nFour.", "One. Two.\n\nThree!\nFour."
    x = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    r = x.select(merkle.differing(F.col("a"), F.col("b")).alias("d"), merkle.likeness(F.col("a"), F.col("b")).alias("l")).first()
    assert len(r.d) == 1 and 0 < r.l < 1


def test_sharding(spark):
    pts = np.array([[x, y] for x in range(16) for y in range(16)])
    h = sharding.hilbert_index(pts, 4)
    walk = pts[np.argsort(h)]
    assert sorted(h) == list(range(256)) and set(np.abs(np.diff(walk, axis=0)).sum(1)) == {1}
    many = ODD + [(100 + i, f"t{i % 7}", "en", f"s{i % 3}") for i in range(90)]
    r = sharding.hilbert_shards(docs(spark, many)).withColumnRenamed("size", "bytes").toPandas()
    n = r.groupby("shard").size()
    assert len(r) == len(many) and n.max() - n.min() <= 1 and len(n) == 8
    for _, g in r.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert r.sort_values(["shard", "slot"]).curve.is_monotonic_increasing
    by = {i: t for i, t, *_ in many if i is not None}
    for x in r[r.doc_id.notna()].itertuples():
        raw = (by[x.doc_id] or "").encode()
        assert (x.bytes, x.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.hilbert_shards(docs(spark).limit(0)).count() == 0


def test_sharding_prunes(spark, tmp_path):
    """Rows out are rows in, and filters on metadata leave shards out."""
    rnd = random.Random(9)
    many = ODD + [(100 + i, f"t{i % 31} " * rnd.choice((3, 30, 300)), rnd.choice(("en", "en", "en", "de", "fr", None)), f"s{min(9, int(rnd.expovariate(0.4)))}") for i in range(1600)]
    df = docs(spark, many)
    ranges = sharding.write_shards(df, f"{tmp_path}/out")
    ranges.persist()
    back = spark.read.parquet(f"{tmp_path}/out")
    key = lambda d: sorted(map(str, d.select(*df.columns).collect()))
    assert key(back) == key(df) and back.groupBy("shard").count().count() == 8
    cells = sharding.cells(df)
    for dim, col in (("d_lang", "lang"), ("d_source", "source")):
        held = back.withColumn("cell", cells[dim]).groupBy(col).agg(F.first("cell").alias("cell"), F.collect_set("shard").alias("shards")).collect()
        pruned = []
        for r in held:
            gone = {x.shard for x in sharding.prunable(ranges, dim, F.lit(r.cell)).collect()}
            assert not gone & set(r.shards)  # nothing is lost by pruning
            pruned.append(len(gone))
        assert np.mean(pruned) >= 2, (dim, pruned)
    lengths = ranges.orderBy("min_d_length").select("min_d_length", "max_d_length").collect()
    assert np.mean([r.max_d_length - r.min_d_length for r in lengths]) <= 0.6 * (1 << sharding.BITS)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### x </turn>\n\\"), (1, 1, "assistant", "### x </turn>\n\\"), (2, 0, "we:ird\\", None), (3, 5, None, "a" * 1000), (None, 0, "assistant", "b"), (-7, 0, "assistant", chat.PROBE)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, msg string")
    got = {r.conv_id: r for r in chat.read_rendered(chat.render(chat.fold(chat.log_of_turns(df)))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        said = "".join(x for _, r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
        assert got[c].formatted_chars == sum(len(chat.turn(r, x)[0]) for _, r, x in turns)
    kinds = chat.log_of_turns(spark.createDataFrame([(i, 0, "user", f"{i} says " * 90, "z") for i in range(30)], df.schema)).groupBy("kind").count().collect()
    assert {r.kind for r in kinds} == {"open", "delta", "edit", "regenerate"}
    log = [(1, s, 0, k, None, t) for s, k, t in ((1, "delta", "a"), (2, "delta", "b"), (3, "regenerate", None), (4, "delta", "c"), (6, "delta", "!"), (5, "edit", "d"))] + [(1, 0, 0, "open", "assistant", None)]
    f = chat.fold(spark.createDataFrame(log, "conv_id bigint, seq bigint, msg bigint, kind string, role string, text string")).collect()
    assert [(r.conv_id, r.pos, r.role, r.text) for r in f] == [(1, 0, "assistant", "d!")]
    assert chat.read_rendered(chat.render(chat.fold(chat.log_of_turns(df.limit(0))))).count() == 0


def test_url_filter(spark):
    urls = ["http://a.com/x", "https://WWW.Example.com/en/1?q#f", "https://m.example.com/en/", "https://example.com/EN/", "x.net/es/", "ftp://b.c.net/es/1", "http://net/fr/", "http://com", "", None, "http://examplecom/en/", "http://fr.net/fr", "http://a.net?/es/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, urls[0]])], "page_id bigint, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, spark.createDataFrame(url_filter.RULES, "rule string, verdict string")).collect()}
    want = {0: ("com/", "allow"), 1: ("www.example.com/en/", "allow"), 2: ("example.com/en/", "block"), 3: ("com/", "allow"), 5: ("net/es/", "block"), 6: ("net/fr/", "block"), 13: ("com/", "allow")}
    assert got == {i: want.get(i, (None, "allow")) for i in range(len(urls) + 1)}
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    again = url_filter.judge(df, rules, max_words=0)  # the way of long lists
    assert {r.page_id: (r.rule, r.verdict) for r in again.collect()} == got and again.count() == df.count()
    long = df.limit(1).select("page_id", F.concat(F.lit("http://"), F.repeat(F.lit("a."), 50_000), F.lit("example.com/en/x")).alias("url"))
    assert url_filter.judge(long, rules).first().rule == "example.com/en/"
    assert url_filter.judge(df, rules.limit(0)).where("rule is not null").count() == 0
    # few listed keys in a large universe: a small first level that hardly anything else passes
    assert url_filter.size_of(3, 750_000_000, True)[0] <= 3 and url_filter.size_of(1000, 500, True) == (23, 1)
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = url_filter.build_cascade(keys, keys.where("key like '%7'"))
    few = url_filter.build_cascade(keys, keys.where("key in ('k5', 'k77', 'k2999')"))
    assert keys.where(url_filter.is_member(F.col("key"), few) != F.col("key").isin("k5", "k77", "k2999")).count() == 0 and len(few[0].words) == 1
    assert keys.where(url_filter.is_member(F.col("key"), levels) != F.col("key").like("%7")).count() == 0
    assert url_filter.judge(df.limit(0), spark.createDataFrame(url_filter.RULES, "rule string, verdict string")).count() == 0


def test_wrapper(spark):
    chrome = '<nav><ul><li><a>Home</a></li><li>x</li></ul></nav><div class="cookie-notice">ok?</div>{}<footer>&copy; z</footer>'
    art = "<article><header><h1>T &amp; {0}</h1></header><p>One <b>two</b><br>three {0}<p>Four<div class='comments'><p>lol</p></div><form>q</form></article>"
    plain = "<div><div><p>Body text number {0} is here.</p><p>More of {0}.</p></div></div>"
    rows = [(i, "http://a.b/x", chrome.format(art.format(i))) for i in range(3)] + [(10 + i, "http://c.d/", chrome.format(plain.format(i))) for i in range(3)]
    rows += [(20, None, None), (21, "nourl", ""), (22, "http://c.d/", "<p>cut <"), (0, "http://a.b/x", rows[0][2])]
    got = wrapper.extract(spark.createDataFrame([(*r, "h", "t") for r in rows], "page_id bigint, url string, html string, host string, text string"))
    got = [(r.page_id, r.text) for r in got.collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[1] == "T & 1\nOne two three 1\nFour" and by[11] == "Body text number 1 is here.\nMore of 1." and by[20] == "" and by[21] == ""
    w = wrapper.merge(wrapper.skeleton(wrapper.tree("<ul><li>a</ul>")), wrapper.skeleton(wrapper.tree("<ul><li>b<li>c</ul><p>x</p>")))
    assert wrapper.show(w).startswith("<page><ul>(<li>#</li>)+</ul>(<p>") and wrapper.show(w).endswith("?</page>")


def texts_of_host(*pages):
    """The texts of pages of one host by its wrapper, without Spark."""
    w = wrapper.skeleton(wrapper.tree(pages[0]))
    for p in pages[1:]:
        w = wrapper.merge(w, wrapper.skeleton(wrapper.tree(p)))
    w = wrapper.Node.unpack(w.pack())
    return [wrapper.Fit(wrapper.tree(p), w).text() for p in pages]


def test_wrapper_mixed_templates(spark):
    nav = "<nav>Home</nav><h1>Site</h1>"
    kinds = ["<article><p>Article {0} says this.</p></article>", "<main><p>Main {0} says this.</p></main>", '<div class="content"><p>Content {0} says this.</p></div>', "<section><div><p>Plain {0} says this.</p><p>And more.</p></div></section>", "<div><table><tr><td>Cell {0} says this.</td></tr></table></div>"]
    rows = [(10 * k + i, None, nav + kind.format(i)) for k, kind in enumerate(kinds) for i in range(3)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k, word in enumerate(("Article", "Main", "Content", "Plain", "Cell")):
        for i in range(3):
            assert got[10 * k + i].startswith(f"{word} {i} says this.")
    # one page of another template: nothing shows that its text is constant
    lone = texts_of_host(*(f"<h1>T{i}</h1><article>A{i}</article>" for i in range(3)), "<h1>T9</h1><div><p>A body of its own.</p></div>")
    assert lone[:3] == ["A0", "A1", "A2"] and "A body of its own." in lone[3]


def test_wrapper_fits_as_it_merges():
    blocks = "<h1>News</h1><div>Buy now</div><nav>Home</nav>"
    article = "<div><article><p>Text {0}.</p></article></div><table><tr><td>{0}</td></tr></table>"
    assert texts_of_host(blocks + article.format(1), article.format(2)) == ["Text 1.", "Text 2."]
    # without an article only the fit tells the content from the optional block before it
    plain = "<div><section><p>Text {0} of some length.</p></section></div><table><tr><td>{0}</td></tr></table>"
    assert texts_of_host(blocks + plain.format(1), blocks + plain.format(2), plain.format(3)) == [f"Text {i} of some length." for i in (1, 2, 3)]


def test_wrapper_class_words_yield():
    body = "<p>Text {0} of the page, and it is a long one.</p>"
    notice = '<div class="cookie-notice"><p>We use cookies, you know that well.</p><p>We use many of them, on all of our pages.</p></div>'
    want = [f"Text {i} of the page, and it is a long one." for i in range(3)]
    for page in (
        f'<div class="overflow-hidden"><article>{body}</article></div>',
        f'<article><div class="elementor-widget-container">{body}</div><div class="ad">Buy</div></article>',
        f'<div id="content"><div class="skip-lazy"><article>{body}</article></div></div>',
        f'<div class="elementor-widget-container">{body}</div><div class="comments"><p>I say {{0}}.</p></div>',
        f'<section>{body}</section><div class="widget"><p>Constant</p></div>',
    ):
        assert texts_of_host(*((notice + page).format(i) for i in range(3))) == want
    head = '<article><div class="entry-header">Head {0}</div><p>Text {0}</p><div class="comments">Long words of readers number {0}</div></article>'
    assert texts_of_host(*(head.format(i) for i in range(2))) == ["Head 0\nText 0", "Head 1\nText 1"]
    # no other page to compare with
    assert texts_of_host(f'{notice}<div class="overflow-hidden"><article>{body}</article></div>'.format(1)) == [want[1]]
    assert texts_of_host(notice) == [""]


def masked(page):
    """The page with meaningless names: every element a div with a class of no meaning."""
    names = {"nav": "q1", "article": "k8", "footer": "zz", "form": "w2", "aside": "m4", "header": "u9"}
    for tag, cls in names.items():
        page = page.replace(f"<{tag}>", f'<div class="{cls}">').replace(f"</{tag}>", "</div>")
    return page.replace('class="ad"', 'class="v5"').replace('class="comments"', 'class="j3"')


def test_wrapper_infers_without_names():
    rnd = random.Random(8)
    say = lambda n: " ".join("".join(rnd.choice("bcdfgaeiou") for _ in range(5)) for _ in range(n))
    pages, want = [], []
    for i in range(12):
        title, body = say(3), [say(rnd.choice((2, 30, 60))) for _ in range(1 if i == 5 else 4)]
        menu = "".join(f"<li><a>{say(1)}</a></li>" for _ in range(rnd.randint(3, 6)))
        readers = "".join(f"<div class='p{k % 2}x'><span>{say(1)}</span><p>{say(12)}</p></div>".replace(f"p{k % 2}x", "rec") for k in range(rnd.randint(0, 3)))
        text = "".join(f"<p>{b}</p>" for b in body)
        note = "<div class='n7'><p>We would like your letters, write to us any day.</p></div>"
        pages.append(masked(f'<nav><ul>{menu}</ul></nav><div class="ad">{say(25)}</div><article><h1>{title}</h1>{text}{note}</article><div class="comments">{readers}</div><footer>{say(4)}</footer>'))
        want.append("\n".join([title, *body]))
    w = wrapper.skeleton(wrapper.tree(pages[0]))
    for p in pages[1:]:
        w = wrapper.merge(w, wrapper.skeleton(wrapper.tree(p)))
    assert [wrapper.Fit(wrapper.tree(p), w, names=False).text() for p in pages] == want
    assert [wrapper.Fit(wrapper.tree(p), w).text() for p in pages] == want
    # a page alone does not tell
    alone = [wrapper.Fit(wrapper.tree(p), wrapper.skeleton(wrapper.tree(p)), names=False).text() for p in pages]
    assert sum(a == b for a, b in zip(alone, want)) < len(pages) / 2


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_wrapper_on_pages_with_and_without_names():
    """Main texts of the given pages against their one article, read by a plain expression."""
    p = pd.read_parquet(f"{os.path.dirname(SMALL)}/sf0.01/pages.parquet")
    p["host"] = p.url.str.extract("://([^/?#]*)")[0].str.lower()
    blocks = lambda a: [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", a)]
    p["want"] = ["\n".join(b for b in blocks(re.search(r"<article>(.*?)</article>", h, re.S)[1]) if b) for h in p.html]
    found, alone, n = 0, 0, 0
    for _, g in p.groupby("host"):
        assert texts_of_host(*g.html) == g.want.tolist()
        if len(g) < 3:
            continue
        pages = [masked(h) for h in g.html]
        w = wrapper.skeleton(wrapper.tree(pages[0]))
        for x in pages[1:]:
            w = wrapper.merge(w, wrapper.skeleton(wrapper.tree(x)))
        for x, y in zip(pages, g.want):
            n += 1
            found += wrapper.Fit(wrapper.tree(x), w, names=False).text() == y
            alone += wrapper.Fit(wrapper.tree(x), wrapper.skeleton(wrapper.tree(x)), names=False).text() == y
    assert found == n > alone


def test_wrapper_deep_and_wide_pages():
    deep = "<div>" * 100_000 + "<p>deep</p>" + "</div>" * 100_000 + "<p>end</p>"
    assert texts_of_host(deep, deep) == ["deep\nend"] * 2
    mixed = "<div>" * 70 + "a<div>b</div>c<nav><ul><li>menu</ul></nav>d" + "</div>" * 70 + "and the end"
    assert texts_of_host(mixed) == ["a\nb\nc\nd\nand the end"]
    wide = "<article>" + "".join(f"<h2>H{i}</h2><p>t{i}</p><ul><li>{i}</ul>" for i in range(3000)) + "</article>"
    assert texts_of_host(wide, wide.replace("t1", "x"))[0].split("\n")[:4] == ["H0", "t0", "0", "H1"] and texts_of_host(wide)[0].count("\n") == 8999


def test_toxicity(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("bcdfghaeiou") for _ in range(4))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        w = [word() for _ in range(30)]
        if toxic:
            w[3], w[9] = "idiot", "zorkelish" if i % 2 else "zorkelant"
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    df = docs(spark, rows + ODD[3:6])
    model = toxicity.fit(df, spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None)], "doc_id bigint, quality int, toxic int"))
    assert 0.5 < max(model["accuracy"].values()) <= 1
    got = toxicity.judge(df, model).select("doc_id", toxicity.held_out().alias("h"), "score", "predicted").collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.h and r.doc_id is not None and r.doc_id >= 8]
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) >= 0.95
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert toxicity.judge(df, none).agg(F.max("score")).first()[0] < 1e-9


def test_toxicity_sample_is_bounded(spark):
    """A repeated id counts once in the fit, whatever its copies; columns named like the results are replaced."""
    rows = [(1, f"copy {i} of an idiot", "en", "s") for i in range(50)] + [(i, "plain words", "en", "s") for i in range(2, 12)] + [(None, "x", "en", "s")]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i == 1)) for i in range(1, 12)] + [(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    learn = toxicity.learning_rows(df, labels).collect()
    kept = [i for i in range(1, 12) if zlib.crc32(str(i).encode()) % 5]
    assert len(learn) == len(kept) and toxicity.learning_rows(df, labels, 3).count() == 3
    out = toxicity.judge(df, toxicity.fit(df, labels))
    assert out.count() == len(rows) and sorted(out.columns) == sorted([*df.columns, "predicted"]) and out.where("score = 0.5").count() == 0


def test_label_model_learns_correlations():
    """Two copies of one voter count about as one, and accuracies are found without labels."""
    rnd = np.random.default_rng(0)
    y = rnd.random(4000) < 0.3
    say = lambda p: np.where(rnd.random(4000) < p, 2 * y - 1, 1 - 2 * y)
    a, b, c = say(0.9), say(0.8), say(0.75)
    votes = np.stack([a, b, c, c, c], 1).astype(np.int64)
    model = toxicity.LabelModel().fit(votes)
    assert model.correlation[2, 3] > 0.9 and model.discount[2] < 0.5 and model.discount[0] > 0.7
    assert np.mean((model.posterior(votes) > 0.5) == y) > 0.85


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_toxicity_held_out(spark):
    sf = f"{os.path.dirname(SMALL)}/sf0.01"
    got = toxicity.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert held[held.toxic == 0].predicted.mean() <= 0.02 and held[held.toxic == 1].predicted.mean() >= 0.5
    learn = got[~got.held_out]
    assert learn[learn.toxic == 0].predicted.mean() <= 0.01


def test_toxicity_without_stems(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join("".join(rnd.choice("bcdfghaeiou") for _ in range(6)) for _ in range(n))
    insults = {3: "stupid idiot", 6: "pathetic loser scum", 9: "disgusting clown liar"}
    rows = [(i, f"{text(20)} {insults.get(i, '')}", "en", "s") for i in range(1, 60)]
    rows += [(100, "you stupid idiot, pathetic loser, disgusting liar and clown", "en", "s"), (101, text(30), "en", "s")]
    df = docs(spark, rows)
    for toxic in (1, 0):  # few labels, and one class only
        model = toxicity.fit(df, spark.createDataFrame([(i, 1, toxic if i in insults else 0) for i in range(1, 60)], "doc_id bigint, quality int, toxic int"))
        got = {r.doc_id: r.score for r in toxicity.judge(df, model).select("doc_id", "score").collect()}
        assert got[100] >= 0.5 and got[101] < 0.5 and all(got[i] > 2 * got[101] for i in insults)


def test_decontamination(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("bcdfgaeiou") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, f"{text(rnd.randint(12, 40))}. {text(6)}.") for i in range(30)]
    rows, want = [], set()
    for i in range(60):
        if i < 30:
            words = items[i][1].split()
            if i % 3 == 0:  # reworded: one word in six is another
                words = [rnd.choice(vocab) if k % 6 == 5 else w for k, w in enumerate(words)]
            rows.append((i, f"{text(80)} {' '.join(words).upper() if i % 2 else ' '.join(words)} {text(150)}", "en", "s"))
            want.add((i, i))
        else:
            half = items[i - 30][1].split()
            rows.append((i, f"{text(200)} {' '.join(half[: len(half) // 3])} {text(30)}", "en", "s"))
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id bigint, text string")
    df = docs(spark, rows + ODD)
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    assert not {r.doc_id for r in decontam.clean(df, bench).select("doc_id").collect()} & {d for d, _ in got}
    assert decontam.leaks(df.limit(0), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


def test_decontamination_of_short_items(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join("".join(rnd.choice("bcdfgaeiou") for _ in range(5)) for _ in range(n))
    items = [(1, "Photosynthesis"), (2, "Forty-two."), (3, "one two three"), (4, text(20))]
    rows = [(i, t, "en", "s") for i, t in items] + [(10 + i, text(60), "en", "s") for i in range(20)]
    rows.append((40, f"{text(40)} photosynthesis {text(40)}", "en", "s"))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, i) for i, _ in items} | {(40, 1)}


def test_decontamination_recall_by_length(spark):
    """Verbatim items inside long texts are found at every length, over several blocks and groups."""
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("bcdfgaeiou") for _ in range(5)) for _ in range(600)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    lengths = (2, 3, 4, 6, 8, 12, 13, 16, 24, 40, 90)
    items = [(100 * n + i, text(n)) for n in lengths for i in range(12)]
    rows = [(i, f"{text(150)} {t} {text(150)}", "en", "s") for i, t in items] + [(i, text(300), "en", "s") for i in range(90)]
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, rows), spark.createDataFrame([*items, items[0]], "item_id bigint, text string"), 400, 900).collect()}
    for n in lengths:
        assert np.mean([(100 * n + i, 100 * n + i) in found for i in range(12)]) >= (1.0 if n <= decontam.SHORT else 0.9), n
    # what else is found does say the item
    said = dict(items)
    texts = {i: decontam.words(t) for i, t, *_ in rows}
    for d, i in found:
        w = decontam.words(said[i])
        assert decontam.lcs(decontam.masks_of(w), len(w), texts[d]) >= decontam.MIN_LCS * len(w)


def test_lcs():
    a, b = decontam.words("a b c d e"), decontam.words("x a c y e")
    assert decontam.lcs(decontam.masks_of(a), len(a), b) == 3


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "near_duplicates", "decontamination", "encoding"]
    out = c.run(spark, SMALL)
    n = pd.read_parquet(f"{SMALL}/documents.parquet").shape[0]
    assert 0 < out.count() < n and out.where("not decodes_exactly").count() == 0


def test_licenses(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("bcdfgaeiou") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{text(30)}\n{text(40)} is the and of this to any.", "en", "s") for i in range(40)]
    rows += [
        (100, f"{text(9)}\nLICENSED under the Apache License, version 2.0!\n{text(9)}\nReleased under the MIT license.", "en", "s"),
        (101, f"{text(90)} Permission is hereby granted free of charge to any person obtaining a copy of this software {text(70)}", "en", "s"),
        (102, "This work is licensed under the Quux Public License of the lake", "en", "s"),
    ]
    df = docs(spark, rows + ODD)
    got = {(r.doc_id, r.family) for r in licenses.scan(df, licenses.fit(df)).collect()}
    assert {(100, "apache"), (100, "mit"), (101, "mit")} <= got
    assert {d for d, _ in got} <= {100, 101, 102} and all(f == "unknown" for d, f in got if d == 102)
    assert licenses.scan(df.limit(0), licenses.fit(df.limit(0))).count() == 0


def test_licenses_calibration():
    """Probabilities say how often a prediction is right; few copies are left unknown or named wrong."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("bcdfgaeiou") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    model = licenses.Classifier([f"{text(30)}\n{text(40)} is the and of this to any software or license use." for _ in range(60)])
    assert model.report["right"] >= 0.8 and model.report["missed"] <= 0.05 and model.report["false"] <= 0.05
    sure, right = [], []
    for family, notices in model.notices.items():
        for n in notices:
            for _ in range(6):
                worn = [w for w in n if rnd.random() > 0.15] + text(5).encode().split()
                name, p, _ = model.predict(worn)
                sure.append(p)
                right.append(name == family)
    assert abs(np.mean(sure) - np.mean(right)) < 0.1 and np.mean(right) > 0.9
    whole = " ".join(licenses.NOTICES["mit"][1:])
    assert set(model.scan(f"{text(20)}\n\n{whole}\n\n{text(20)}")) == {"mit"}


def test_licenses_wrapped_notices():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("bcdfgaeiou") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    model = licenses.Classifier([f"{text(30)}\n{text(40)} is the and of this to any." for _ in range(40)])
    for family in ("isc", "gpl", "mpl", "bsd", "mit"):
        notice = licenses.NOTICES[family][1 if family in ("gpl", "mit") else 0].split()
        for width in (5, 8, 12):
            for mark in ("", " * ", "# ", "// "):
                lines = "\n".join(mark + " ".join(notice[i : i + width]) for i in range(0, len(notice), width))
                got = model.scan(f"{text(9)}\n\n{mark}{text(6)}\n{lines}\n{mark}\n{text(30)}")
                assert set(got) == {family} and got[family][0] == 1, (family, width, got)
    assert model.scan(f"{text(50)}\n{text(3)}\n\n{text(50)}") == {}
    # a line break does not hide a notice, an empty line ends it
    assert set(model.scan("Released under the MIT\nLicense")) == {"mit"}
