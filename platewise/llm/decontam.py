"""Benchmark decontamination by latent semantic retrieval.

1. Passages are windows of words; their terms are weighted by TF-IDF over the benchmark's
   vocabulary, with document frequencies counted over all documents.
2. A distributed randomised SVD gives the latent space, fitted on the term sets of all documents and on
   the items: in the pass that counts document frequencies each task multiplies its sets A by a thin
   random matrix and sums A'(A W) over its rows; Spark adds the partial sums by term, and the driver
   gets the singular vectors from a matrix of (terms x dimensions) (Nystroem, one pass).
3. Every passage of every document is projected and compared by cosine with all items of its length
   class; texts do not move.
4. Candidates are verified on words, next to the text: the longest common subsequence must cover
   ``MIN_LCS`` of the item, and that of its answer (its last sentence, or last quarter) must cover
   ``MIN_ANSWER``. Reworded and reordered copies pass, shared phrases do not.

Items of at most ``SHORT`` words are also sought word for word, in the same pass: a window over other words
says little about them. What they repeat verbatim is always found; reworded, the cosine decides as for
all items.

Items are dealt by hash into blocks of at most ``BLOCK_WORDS`` words, each with a latent space of its
own, and blocks into groups of at most ``GROUP_WORDS`` words. All documents are read twice a group (term
statistics, search); what is broadcast is bounded by a group. An item longer than a block is a block of its own.

Defined results: one row for each pair of a document and an item that it leaks; documents without
a leak have none. Null or empty texts and items without words match nothing; repeated rows of a
document give one row; a null id is reported as null; repeated items count once; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import drop, keep, release, table, without

BLOCK_WORDS = 1 << 17
GROUP_WORDS = 1 << 19
SHORT = 12
SLICE = 1024  # windows compared at a time
DIMS = 96
OVERSAMPLE = 16
MIN_COSINE = 0.5
MIN_LCS = 0.6
MIN_ANSWER = 0.5
CHUNK = 60_000  # words projected at a time
LEAST_CLASS = 16

_SPLIT = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
SCHEMA = "doc_id bigint, item_id bigint, cosine double, lcs double, answer double, start bigint"


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII marks part them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def answer_of(text: str, n: int) -> list[bytes]:
    """The words of an item's last sentence, or its last quarter where that is all or nothing."""
    parts = [w for w in map(words, _SENTENCE.split(text)) if w]
    return parts[-1] if len(parts) > 1 else words(text)[-max(1, n // 4) :]


def lcs(masks: dict[bytes, int], n: int, other: list[bytes]) -> int:
    """Length of the longest common subsequence with a sequence given as bit masks of its words."""
    v = full = (1 << n) - 1
    for w in other:
        u = v & masks.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks_of(seq: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(seq):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Items:
    """A block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = [(i, t) for i, t in rows if words(t)]
        self.ids = [i for i, _ in rows]
        self.words = [words(t) for _, t in rows]
        self.answers = [answer_of(t, len(w)) for (_, t), w in zip(rows, self.words)]
        self.terms = sorted({w for ws in self.words for w in ws})
        self.index = {w: i for i, w in enumerate(self.terms)}
        # length classes: items of up to m words are sought in windows of 1.5 m words, m / 2 apart,
        # so that some window holds the whole item
        size = np.array([len(w) for w in self.words], dtype=float)
        top = np.maximum(LEAST_CLASS, 2 ** np.ceil(np.log2(np.maximum(size, 1)))).astype(int) if rows else np.array([], int)
        self.classes = {int(m): np.flatnonzero(top == m) for m in np.unique(top)}
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}

    def anchor(self, df: np.ndarray) -> None:
        """Short items by their rarest word and its place."""
        for j, ws in enumerate(self.words):
            if len(ws) <= SHORT:
                at = min(range(len(ws)), key=lambda i: df[self.index[ws[i]]])
                self.anchors.setdefault(ws[at], []).append((j, at))

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The terms of each item and how often it has them; the whole matrix is never made."""
        for ws in self.words:
            yield np.unique([self.index[w] for w in ws], return_counts=True)

    def times(self, w: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """The items' counts, or with ``weight`` of terms their unit rows, times a matrix."""
        out = np.zeros((len(self.words), w.shape[1]))
        for r, (at, tf) in enumerate(self.rows()):
            out[r] = unit(tf if weight is None else tf * weight[at], weight is not None) @ w[at]
        return out

    def turned(self, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The transpose of the unit rows times a matrix."""
        out = np.zeros((len(self.terms), y.shape[1]))
        for (at, tf), row in zip(self.rows(), y):
            out[at] += np.outer(unit(tf * weight[at]), row)
        return out


def unit(v: np.ndarray, scaled: bool = True) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-12) if scaled else v


def _test_matrix(items: Items, k: int, seed: int = 8) -> np.ndarray:
    """A random matrix (terms x k), smaller where many items have a term, as the weights will be."""
    held = np.zeros(len(items.terms))
    for at, _ in items.rows():
        held[at] += 1
    w = np.random.default_rng(seed).standard_normal((len(items.terms), k), np.float32)
    return w * np.log((len(items.words) + 1) / (held + 0.5)).astype(np.float32)[:, None]


def _width(items: Items, dims: int = DIMS) -> int:
    return min(dims + OVERSAMPLE, len(items.terms))


def _times(w: np.ndarray, g: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
    """Add G W to ``g`` for the term sets of some documents, laid end to end; G sums b b' / |b| over the sets b.

    The last column of ``g`` gets the diagonal of G.
    """
    ids, sizes = ids.astype(np.int64), sizes[sizes > 0]
    for s, e in _slices(sizes):
        first = int(sizes[:s].sum())
        part, n = ids[first : first + int(sizes[s:e].sum())], sizes[s:e]
        z = np.add.reduceat(w[part], np.cumsum(n) - n, axis=0) / n[:, None].astype(np.float32)
        z = np.hstack([z, (1 / n)[:, None].astype(np.float32)])
        order = np.argsort(part, kind="stable")
        at, start = np.unique(part[order], return_index=True)
        g[at] += np.add.reduceat(z[np.repeat(np.arange(e - s), n)[order]], start, axis=0)


def _slices(sizes: np.ndarray, most: int = SLICE * 8) -> Iterator[tuple[int, int]]:
    """Runs of documents with about ``most`` terms."""
    part = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)])


def _statistics(docs: DataFrame, group: list[Items]) -> tuple[dict[bytes, int], int, DataFrame, str]:
    """One pass over all documents: in how many each term of a group occurs, the number of documents, and
    for each block (block, term, g) the rows of G W, stored, with the path of that table."""
    terms = sorted({t for items in group for t in items.terms})
    place = {t: i for i, t in enumerate(terms)}
    own = []  # of each block: the place of a group's term among its own
    for items in group:
        at = np.full(len(terms), -1, np.int32)
        at[[place[t] for t in items.terms]] = np.arange(len(items.terms))
        own.append(at)
    shared = docs.sparkSession.sparkContext.broadcast((place, own, group))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, own, group = shared.value
        ws = [_test_matrix(items, _width(items)) for items in group]
        gs = [np.zeros((len(w), w.shape[1] + 1), np.float32) for w in ws]
        df, n = np.zeros(len(known), np.int64), 0

        def add(sets: list[np.ndarray]) -> None:
            flat = np.concatenate(sets)
            df[:] += np.bincount(flat, minlength=len(df))
            doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            for w, g, at in zip(ws, gs, own):
                ids = at[flat]
                _times(w, g, ids[ids >= 0], np.bincount(doc[ids >= 0], minlength=len(sets)))

        for pdf in batches:
            n += len(pdf)
            sets = []
            for text in pdf.text:
                seen = known.keys() & set(words(text))
                sets.append(np.fromiter(map(known.__getitem__, seen), np.int64, len(seen)))
            if sets:
                add(sets)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"block": -1, "term": np.append(at, -1), "df": np.append(df[at], n), "g": None})
        for b, g in enumerate(gs):
            at = np.flatnonzero(g[:, -1])
            for s in range(0, len(at), SLICE):
                yield pd.DataFrame({"block": b, "term": at[s : s + SLICE], "df": 0, "g": list(g[at[s : s + SLICE]].astype(float))})
        release()

    k = max(map(_width, group)) + 1
    parts = docs.select("text").mapInPandas(count, "block int, term int, df bigint, g array<double>")
    sums = parts.groupBy("block", "term").agg(F.sum("df").alias("df"), F.array(*[F.sum(F.get("g", i)) for i in range(k)]).alias("g"))
    sums, path = keep(sums, "terms")
    found = {r.term: r.df for r in sums.where("block = -1").select("term", "df").collect()}
    return {t: found.get(i, 0) for i, t in enumerate(terms)}, found.get(-1, 0), sums, path


def latent_space(sums: DataFrame, block: int, items: Items, idf: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Singular vectors (terms x dims) of all documents' weighted term sets and, with equal total weight, the items.

    One pass suffices (Nystroem): M is S G S with the weights S, plus the items; of M W' with W' = W / S the
    documents' part is S (G W), and M is nearly (M W') (W'' M W')^-1 (M W')'.
    """
    k = _width(items, dims)
    g = np.zeros((len(items.terms), k + 1))
    for r in sums.where(F.col("block") == block).select("term", "g").collect():  # terms of a block of items
        g[r.term] = r.g[: k + 1]
    w = _test_matrix(items, k) / idf[:, None]
    weight = max(1.0, float(g[:, -1] @ idf**2)) / max(1, len(items.words))
    y = g[:, :-1] * idf[:, None] + weight * items.turned(items.times(w, idf), idf)
    q, r = np.linalg.qr(w)
    y = np.linalg.solve(r.T, y.T).T if k else y  # M Q for orthonormal Q
    shift = 1e-7 * max(float(np.linalg.norm(y)), 1e-12)  # sums are single numbers of 32 bits
    y += shift * q
    core = q.T @ y
    values, turn = np.linalg.eigh((core + core.T) / 2)
    left, size, _ = np.linalg.svd(y @ (turn / np.sqrt(np.maximum(values, shift))), full_matrices=False)
    return left[:, : min(dims, k)]


def _windows(lengths: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: document, first and last word of each window of a class."""
    size, step = m * 3 // 2, m // 2
    count = np.maximum(1, -(-(lengths - size) // step) + 1)
    doc = np.repeat(np.arange(len(lengths)), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum(lengths) - lengths
    first = base[doc] + within * step
    return doc, first, np.minimum(first + size, base[doc] + lengths[doc])


def _running(rows: np.ndarray, some: int = 256) -> np.ndarray:
    """Running sums of rows, a zero row first; in runs that stay in a processor's cache, with the same additions."""
    sums = np.zeros((len(rows) + 1, rows.shape[1]), rows.dtype)
    for s in range(0, len(rows), some):
        part = rows[s : s + some]
        part[0] += sums[s]
        np.cumsum(part, axis=0, out=sums[s + 1 : s + 1 + len(part)])
    return sums


class Block:
    """Items with their latent space, ready to be sought."""

    def __init__(self, items: Items, idf: np.ndarray, space: np.ndarray):
        self.items = items
        self.project = (space * idf[:, None]).astype(np.float32)
        q = items.times(self.project)
        self.q = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def prepare(self) -> None:
        self.masks = [(masks_of(w), masks_of(a)) for w, a in zip(self.items.words, self.items.answers)]

    def exact(self, ids: list, toks: list[list[bytes]]) -> Iterator[tuple]:
        """Short items that occur word for word."""
        anchors, items = self.items.anchors, self.items
        for d, t in enumerate(toks):
            done = set()
            for i, w in enumerate(t):
                for j, at in anchors.get(w, ()):
                    if j not in done and i >= at and t[i - at : i - at + len(items.words[j])] == items.words[j]:
                        done.add(j)
                        yield ids[d], items.ids[j], 1.0, 1.0, 1.0, i - at

    def leaks(self, ids: list, toks: list[list[bytes]], min_cosine: float) -> Iterator[tuple]:
        items, known = self.items, self.items.index
        if items.anchors:
            yield from self.exact(ids, toks)
        lengths = np.array([len(t) for t in toks])
        flat = np.fromiter(map(known.get, chain.from_iterable(toks), repeat(-1)), np.int64, int(lengths.sum()))
        base = np.cumsum(lengths) - lengths
        hits = np.flatnonzero(flat >= 0)
        if not len(hits):
            return
        sums = _running(self.project[flat[hits]])
        for m, members in items.classes.items():
            doc, first, last = _windows(lengths, m)
            lo, hi = np.searchsorted(hits, first), np.searchsorted(hits, last)
            # as many known words as the shortest item has, three at most
            busy = np.flatnonzero(hi - lo >= min(3, min(len(items.words[j]) for j in members)))
            found: list[tuple[np.ndarray, ...]] = []
            for s in range(0, len(busy), SLICE):
                part = busy[s : s + SLICE]
                x = sums[hi[part]] - sums[lo[part]]
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                cos = (x @ self.q[members].T) / np.maximum(norm, 1e-6)[:, None]
                at, which = np.nonzero(cos >= min_cosine)
                found.append((part[at], which, cos[at, which]))
            if not found:
                continue
            at, which, cos = map(np.concatenate, zip(*found))
            # the best windows first; the first that verifies is reported
            done = set()
            for k in np.argsort(-cos, kind="stable"):
                a, d, j = at[k], doc[at[k]], int(members[which[k]])
                if (d, j) in done:
                    continue
                s = int(first[a] - base[d])
                t = toks[d][max(0, s - m // 4) : int(last[a] - base[d]) + m // 4]
                n, na = len(items.words[j]), len(items.answers[j])
                part, ans = lcs(self.masks[j][0], n, t) / n, lcs(self.masks[j][1], na, t) / na
                if part >= MIN_LCS and ans >= MIN_ANSWER:
                    done.add((d, j))
                    yield ids[d], items.ids[j], float(cos[k]), part, ans, s


def search(docs: DataFrame, blocks: list[Block], min_cosine: float = MIN_COSINE) -> DataFrame:
    """Rows of SCHEMA for every verified leak of the items of a group of blocks, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = shared.value
        for block in blocks:
            block.prepare()

        def frame(ids, toks):
            rows = [r for block in blocks for r in block.leaks(ids, toks, min_cosine)]
            return pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "lcs", "answer", "start"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        for pdf in batches:
            ids, toks, size = [], [], 0
            for i, text in zip(pdf.doc_id.astype("Int64"), pdf.text):
                ids.append(i)
                toks.append(words(text))
                size += len(toks[-1])
                if size >= CHUNK:
                    yield frame(ids, toks)
                    ids, toks, size = [], [], 0
            if toks:
                yield frame(ids, toks)
        ids, toks = [], []
        release()

    return docs.mapInPandas(run, SCHEMA)


def groups_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS, group_words: int = GROUP_WORDS) -> Iterator[list[Items]]:
    """The items in groups of blocks; one group at a time reaches the driver."""
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    rows = benchmark.select("item_id", "text").where("text is not null").distinct()
    rows = rows.select("*", size.alias("n"), F.xxhash64("item_id", "text").alias("h"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    n_groups = max(1, -(-total * 5 // (4 * group_words)))
    while True:
        group = F.pmod("h", F.lit(n_groups))
        largest = rows.groupBy(group.alias("g")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.max("n")).first()[0] or 0
        if largest <= group_words:
            break
        n_groups = 2 * n_groups
    for g in range(n_groups):
        out, at, n = [], [], 0
        for r in rows.where(group == g).orderBy("item_id", "text").collect():
            if at and n + r.n > block_words:
                out.append(Items(at))
                at, n = [], 0
            at.append((r.item_id, r.text))
            n += r.n
        out.append(Items(at))
        out = [items for items in out if items.ids]
        if out:
            yield out


def leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    found = None
    for group in groups_of(benchmark, block_words, group_words):
        df, n, sums, path = _statistics(docs, group)
        blocks = []
        for b, items in enumerate(group):
            counts = np.array([df[t] for t in items.terms], dtype=np.int64)
            items.anchor(counts)
            idf = np.log((n + 1) / (counts + 0.5)).clip(0)
            blocks.append(Block(items, idf, latent_space(sums, b, items, idf)))
        drop(spark, path)
        rows = search(docs, blocks)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    best = F.max_by(F.struct("cosine", "lcs", "answer", "start"), F.struct("lcs", "cosine", F.negative("start"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    bad, _ = keep(leaks(docs, benchmark).select("doc_id").where("doc_id is not null").distinct(), "leaks")
    return without(docs, bad, "doc_id")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
