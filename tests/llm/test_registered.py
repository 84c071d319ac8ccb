"""The registered queries over whole small tables, against plain Python or SQL; the pipeline on odd tables."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from platewise.llm import queries as registered
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def read(name, sf=SMALL):
    return pd.read_parquet(f"{sf}/{name}.parquet")


def run(spark, name, sf=SMALL):
    return registered.QUERIES[name](spark, sf).collect()


def sets_of(text, n):
    """Shingles as the contract says them, as tuples of words."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_op2(spark):
    d = read("documents")
    sets = {i: sets_of(t, 3) for i, t in zip(d.doc_id, d.text)}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op2_jaccard")}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_op4(spark):
    d = read("documents")
    got = pd.DataFrame([r.asDict() for r in run(spark, "op4_hilbert_shards")])
    raw = {i: (t or "").encode() for i, t in zip(d.doc_id, d.text)}
    assert sorted(got.doc_id) == sorted(raw) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    assert all(a == len(raw[i]) + 1 and b == zlib.crc32(raw[i]) for i, a, b in zip(got.doc_id, got["size"], got.text_crc32))
    counts = got.groupby("shard").size()
    assert list(counts.index) == list(range(8)) and counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_op6(spark):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(zip(*(read("documents")[c] for c in ("doc_id", "text"))))
    got = run(spark, "op6_byte_bpe")
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_op7(spark):
    c = read("conversations").sort_values(["conv_id", "turn"])
    turns = {i: [(r, t or "") for r, t in zip(g.role, g.text)] for i, g in c.groupby("conv_id")}
    turns[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in run(spark, "op7_chat")}
    assert set(got) == set(turns)
    for i, said in turns.items():
        loss = "".join(t for r, t in said if r == "assistant")
        all_ = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        want = (len(said), all_, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == want


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_op8(spark):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    docs = {i: words(t) for i, t in zip(*(read("documents")[c] for c in ("doc_id", "text")))}
    items = {i: words(t) for i, t in zip(*(read("benchmark")[c] for c in ("item_id", "text")))}
    got = {(r.doc_id, r.item_id): r for r in run(spark, "op8_decontam")}
    verbatim = {(d, i) for d, w in docs.items() for i, x in items.items() if x and f" {' '.join(x)} " in f" {' '.join(w)} "}
    assert verbatim <= set(got)
    for (d, i), r in got.items():  # what is reported does follow the item
        near = docs[d][max(0, r.start - len(items[i])) : r.start + 4 * max(16, len(items[i]))]
        assert _lcs(items[i], near) >= 0.6 * len(items[i]) - 1e-9


def test_op10(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    cur = con.execute(registered.SQL["op10_url_filter"])
    names = [x[0] for x in cur.description]
    want = sorted((dict(zip(names, r)) for r in cur.fetchall()), key=lambda r: r["page_id"])
    got = sorted((r.asDict() for r in run(spark, "op10_url_filter")), key=lambda r: r["page_id"])
    assert got == want


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string, ids string"


def odd_folder(spark, folder, docs, labels=True):
    spark.createDataFrame(docs, DOCUMENTS).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)] if labels else [], "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one item of the benchmark that nobody says"), (2, None), (3, "")], "item_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns; an empty table; no labels."""
    rnd = random.Random(4)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(40_000))
    extra = (0.5, "n", "i")
    docs = [(1, "a plain text of some words that stays here", "en", "s", 1, *extra), (1, "a plain text of some words that stays here", "en", "s", 1, *extra), (2, "A plain text of some words that stays here", None, None, None, *extra)]
    docs += [(3, None, "en", "s", 0, *extra), (4, "", "en", "s", 0, *extra), (None, "no id but some words of its own", "en", "s", 1, *extra), (5, long, "en", "s", 1, *extra), (6, "one item of the benchmark that nobody says", "en", "s", 1, *extra)]
    out = corpus_pipeline.run(spark, odd_folder(spark, tmp_path / "odd", docs)).collect()
    assert {r.doc_id for r in out} == {1, 3, 4, 5, None} and all(r.decodes_exactly for r in out)
    assert next(r.n_tokens for r in out if r.doc_id == 5) > 40_000
    assert corpus_pipeline.run(spark, odd_folder(spark, tmp_path / "none", [], labels=False)).count() == 0
