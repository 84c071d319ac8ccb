"""N-gram Jaccard join by filters under several global orders.

Two texts link when ``100 * |intersection| >= percent * |union|`` for their sets of word shingles.
Under any one total order of all shingles, the first tokens (prefixes) of two linked sets share
several tokens; candidates must do so under every one of ``ORDERS`` orders before their sets are
intersected.

1. One pass over the texts makes each set (64-bit shingle hashes), its size and a hash of the whole
   set. Texts with equal sets are one node from here on.
2. The first order puts frequent shingles last. "Frequent" comes from counts that each task keeps
   of its own rows, and at most ``MAX_DEMOTED`` shingles are demoted; any choice gives a valid
   order, so it changes the work and never the result.
3. Prefix tokens of the first order are joined. In blocks of up to ``SMALL_BLOCK`` nodes all pairs of
   fitting sizes are candidates. In a larger block each node first meets the block's least and
   greatest nodes of its size class; verified links give components, and only pairs across
   components are candidates then. A group of near copies thus costs its size and not its square,
   and no pair that could join two components is left out.
4. Candidates must share prefix tokens under the other orders (plain hashes) too; those left are
   verified on whole sets.
5. Components by contraction: each node moves to its least neighbour until no link is left.

Sets are compared by 64-bit hashes of shingles, and copies by a 64-bit hash of the sorted set.

Defined results: a text without words (null, empty, white space) has an empty set and links with
nothing; a text with fewer words than a shingle has its whole sequence as one shingle; repeated rows
are copies of each other; a row with a null id is judged but never names a component; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from platewise.llm.common import drop, keep, maybe_in, release, table, without

ORDERS = 3
SHARE = 3  # tokens that prefixes of linked sets share at least, if the sets are large enough
JOIN_PART = 5  # and, in percent, this part of large ones under the first order
FILTER_PART = 20  # and under the others
SMALL_BLOCK = 32
DEMOTE_AT = 64
MAX_DEMOTED = 1 << 17
LOCAL_COUNT = 3
FLUSH = 2_000_000
PIECE = 1000  # rows of a batch that are worked off at a time

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = [np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(1, ORDERS)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MUL2
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word ``n``-grams, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    s = h[: len(h) - k + 1].copy() if k else h
    for i in range(1, k):
        s = s * _MUL + h[i : len(h) - k + 1 + i]
    return np.unique(mix(s + np.uint64(k)))


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """A row per text (heavy false) and, besides, the shingles frequent within a task (heavy true)."""
    schema = "heavy boolean, doc_id bigint, n bigint, node bigint, s array<bigint>, tok bigint, cnt bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held, size = [], 0

        def flush():
            toks, cnt = np.unique(np.concatenate(held), return_counts=True)
            often = cnt >= LOCAL_COUNT
            return pd.DataFrame({"heavy": True, "tok": toks[often].view(np.int64), "cnt": cnt[often]})

        def full(pdf):
            for c, kind in (("doc_id", "Int64"), ("n", "Int64"), ("node", "Int64"), ("tok", "Int64"), ("cnt", "Int64")):
                pdf[c] = pdf[c].astype(kind) if c in pdf else pd.array([None] * len(pdf), dtype=kind)
            if "s" not in pdf:
                pdf["s"] = None
            return pdf[["heavy", "doc_id", "n", "node", "s", "tok", "cnt"]]

        for batch in batches:
            for i in range(0, len(batch), PIECE):
                pdf = batch.iloc[i : i + PIECE]
                ns, nodes, sets = [], [], []
                for text in pdf.text:
                    s = shingle_set(text, n)
                    ns.append(len(s))
                    node = node_of(s) if len(s) else None
                    nodes.append(node)
                    if node is None or node in seen:
                        sets.append(None)
                        continue
                    seen.add(node)
                    held.append(s)
                    size += len(s)
                    sets.append(s.view(np.int64))
                yield full(pd.DataFrame({"heavy": False, "doc_id": pdf.doc_id.to_numpy(), "n": ns, "node": pd.array(nodes, dtype="Int64"), "s": sets}))
                if size >= FLUSH:
                    yield full(flush())
                    held, size = [], 0
        if held:
            yield full(flush())
        held, seen = [], set()
        release()

    return docs.mapInPandas(run, schema)


def least_overlap(n, percent: int):
    """ceil(percent * n / 100): the shared tokens that a link of a set of ``n`` needs."""
    return (n * percent + 99) // 100


def share(n: int, percent: int, part: int) -> int:
    """Prefix tokens that a set of ``n`` shares with any linked one, for prefixes that much longer."""
    return min(least_overlap(n, percent), max(SHARE, n * part // 100))


def share_col(n: Column, percent: int, part: int) -> Column:
    return F.least(F.floor((n * percent + 99) / 100), F.greatest(F.lit(SHARE), F.floor(n * part / 100))).cast("int")


def prefix(s: np.ndarray, rank: np.ndarray, percent: int, part: int) -> np.ndarray:
    """The first tokens of a set in the order of ``rank``, in that order."""
    p = len(s) - least_overlap(len(s), percent) + share(len(s), percent, part)
    if p < len(s):
        at = np.argpartition(rank, p - 1)[:p]
        s, rank = s[at], rank[at]
    return s[np.argsort(rank)]


def _prefixes(sets: DataFrame, demoted: np.ndarray, percent: int) -> DataFrame:
    """Each node's prefix tokens under the first order: (node, n, toks)."""
    late = sets.sparkSession.sparkContext.broadcast(demoted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = late.value
        for batch in batches:
            for i in range(0, len(batch), PIECE):
                pdf, toks = batch.iloc[i : i + PIECE], []
                for s in pdf.s:
                    s = np.asarray(s, dtype=np.int64)
                    rank = mix(s.view(np.uint64)) >> np.uint64(1)
                    if len(last):
                        at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                        rank |= (last[at] == s).astype(np.uint64) << np.uint64(63)
                    toks.append(prefix(s, rank, percent, JOIN_PART))
                yield pd.DataFrame({"node": pdf.node.to_numpy(), "n": pdf.n.to_numpy(), "toks": toks})
        release()

    made = sets.mapInPandas(run, "node bigint, n bigint, toks array<bigint>")
    # a copy in another task made the same row
    return made.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("toks").alias("toks"))


def _whole(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, n, s, o1, o2, ...): whole sets, and their prefixes under the other orders.

    Of those prefixes the lower 32 bits of a token are kept; where two tokens of a prefix agree in
    them, the filter allows for it.
    """
    others = [f"o{k}" for k in range(1, ORDERS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), PIECE):
                cols = {c: [] for c in ("node", "n", "s", *others)}
                for text in batch.text.iloc[i : i + PIECE]:
                    s = shingle_set(text, n)
                    if not len(s):
                        continue
                    cols["node"].append(node_of(s))
                    cols["n"].append(len(s))
                    cols["s"].append(s.view(np.int64))
                    for k, o in enumerate(others):
                        cols[o].append(np.unique(prefix(s, mix(s + _SEEDS[k]), percent, FILTER_PART).astype(np.uint32)).view(np.int32))
                yield pd.DataFrame(cols)
        release()

    schema = "node bigint, n bigint, s array<bigint>, " + ", ".join(f"{o} array<int>" for o in others)
    made = docs.select("text").mapInPandas(run, schema)
    return made.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("n", "s", *others)])


def _fits(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _size_class(n: Column, percent: int) -> Column:
    """Sizes that fit each other are at most one class apart (classes are a hair wider than the ratio)."""
    width = max(math.log(100 / percent) * (1 + 1e-9), 1e-6)
    return F.floor(F.log(n.cast("double")) / width).cast("bigint")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")


def _with_both(pairs: DataFrame, nodes: DataFrame, cols: list[str]) -> DataFrame:
    """``pairs`` with the columns of either node, named ``<col>_a`` and ``<col>_b``."""
    wanted = maybe_in(nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")
    for x in "ab":
        pairs = pairs.join(wanted.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols]), x)
    return pairs


def _verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The candidate pairs (a, b) that pass the other orders' filters and link.

    Sets are made again from the texts, for the nodes of the pairs alone; ``reps`` has a document
    of each node.
    """
    spark = pairs.sparkSession
    ids = reps.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    texts = maybe_in(docs, ids.select(F.col("rep").alias("doc_id")), "doc_id").unionByName(docs.where("doc_id is null"))
    nodes, p1 = keep(_whole(texts, n, percent), "nodes")
    others = [f"o{k}" for k in range(1, ORDERS)]
    passed = _with_both(pairs, nodes, ["n", *others])
    need = F.least(*[share_col(F.col(f"n_{x}"), percent, FILTER_PART) for x in "ab"])
    for o in others:
        whole = F.col("n_a") - F.floor((F.col("n_a") * percent + 99) / 100) + share_col(F.col("n_a"), percent, FILTER_PART)
        alike = whole - F.size(f"{o}_a")  # tokens of the prefix that agree with another one in 32 bits
        passed = passed.where(F.size(F.array_intersect(f"{o}_a", f"{o}_b")) >= need - alike)
    passed, p2 = keep(passed.select("a", "b"), "passed")
    both = _with_both(passed, nodes, ["n", "s"])
    both = both.withColumn("shared", F.size(F.array_intersect("s_a", "s_b")).cast("bigint"))
    links, _ = keep(both.where(F.expr(f"100 * shared >= {percent} * (n_a + n_b - shared)")).select("a", "b"), "links")
    drop(spark, p1, p2)
    return links


def components(links: DataFrame, left: str = "a", right: str = "b") -> tuple[DataFrame | None, list[str]]:
    """(node, label): every node of the links with one label for each connected component.

    Returns None for no links, and the paths of the tables that hold the result.
    """
    edges, path = keep(links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct(), "edges")
    assigned, held = None, [path]
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step, p1 = keep(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to")).withColumnRenamed("a", "node"), "step")
        if assigned is None:
            assigned, p2 = step, p1
        else:
            moved = assigned.join(step.select(F.col("node").alias("label"), F.col("to")), "label", "left")
            assigned, p2 = keep(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
        if "label" not in assigned.columns:
            assigned = assigned.withColumnRenamed("to", "label")
        to = lambda x: step.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}"))
        nxt = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges, path = keep(nxt.where("a <> b").distinct(), "edges")
        held += [path, p1, p2]
    return assigned, held


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable by links)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    made, big = keep(_sets(docs, n), "sets")
    light, _ = keep(made.where("not heavy").select("doc_id", "n", "node"), "docs")
    reps = light.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    sets = made.where("s is not null").select("node", "n", "s")
    frequent = made.where("heavy").groupBy("tok").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= DEMOTE_AT)
    demoted = frequent.orderBy(F.col("cnt").desc(), "tok").limit(MAX_DEMOTED).select("tok").toPandas().tok.to_numpy(dtype=np.int64)

    prefixes, t1 = keep(_prefixes(sets, np.sort(demoted), percent), "prefixes")
    drop(spark, big)
    tokens = prefixes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("toks").alias("at", "tok"))
    blocks = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    tokens, t2 = keep(tokens.join(blocks, "tok"), "blocks")

    # small blocks: all pairs of fitting sizes that meet often enough
    small, large = tokens.where(F.col("c") <= SMALL_BLOCK), tokens.where(F.col("c") > SMALL_BLOCK)
    n_large = large.groupBy("node").agg(F.count(F.lit(1)).alias("in_large"))
    small = small.select("tok", "node", "n")
    small = small.join(n_large, "node", "left").select(*small.columns, F.coalesce("in_large", F.lit(0)).alias("in_large"))
    x, y = small.alias("x"), small.alias("y")
    met = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.node") < F.col("y.node")) & _fits(F.col("x.n"), F.col("y.n"), percent))
    need = F.least(*[share_col(F.col(f"{v}.n"), percent, JOIN_PART) for v in "xy"]) - F.least("x.in_large", "y.in_large")
    met = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), need.alias("need"))
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.first("need").alias("need")).where("k >= need").select("a", "b")

    # large blocks: each node and three others of the block
    any_large = large.limit(1).count() > 0
    if any_large:
        # the node with the fewest rare tokens before the shared one is the most central
        central = F.min_by("node", F.struct("at", "node"))
        hubs = large.groupBy("tok").agg(F.array_distinct(F.array(central, F.min("node"), F.max("node"))).alias("hubs"))
        met = large.join(hubs, "tok").select(F.col("node").alias("a"), "n", F.explode("hubs").alias("b"))
        met = met.groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("k"))
        pairs = pairs.unionByName(_ordered(met.where(F.col("k") >= share_col(F.col("n"), percent, JOIN_PART)))).distinct()
    pairs, p1 = keep(pairs, "pairs")
    links = _verify(pairs, reps, docs, n, percent)
    drop(spark, p1)
    label, held = components(links)

    if any_large:
        large = large.select("tok", "node", "n", "at")
        if label is None:
            placed = large.withColumn("comp", F.col("node"))
        else:
            placed = large.join(label, "node", "left").select(*large.columns, F.coalesce("label", "node").alias("comp"))
        placed, p2 = keep(placed, "placed")
        per = placed.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("k"))
        main = per.groupBy("tok").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        # a token at place `at` can be the first shared one of a link only if enough tokens follow
        # it: the other set is no smaller than the least that fits
        least = F.floor((F.col("n") * percent + 99) / 100)
        placed = placed.where(F.col("n") - F.col("at") >= least).join(main.select("tok", "main"), "tok")
        # a block is dealt by size class as well as by token, so that a hot token is many tasks
        size = _size_class(F.col("n"), percent)
        around = F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: size + i)).alias("class")
        x, y = placed.withColumn("class", size).alias("x"), placed.where("comp <> main").select("*", around).alias("y")
        across = (F.col("x.tok") == F.col("y.tok")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.comp") != F.col("y.comp")) & _fits(F.col("x.n"), F.col("y.n"), percent)
        across &= (F.col("x.comp") == F.col("x.main")) | (F.col("x.node") < F.col("y.node"))
        # overlap that a link needs, by the sum of the sizes
        needed = (F.col("x.n") + F.col("y.n")) * percent
        across &= F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) * (100 + percent) >= needed
        rest, p3 = keep(_ordered(x.join(y, across).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))).distinct(), "across")
        # they must share as many tokens of their whole prefixes as the others
        rest = _with_both(rest, prefixes, ["n", "toks"])
        need = F.least(*[share_col(F.col(f"n_{v}"), percent, JOIN_PART) for v in "ab"])
        rest, p4 = keep(rest.where(F.size(F.array_intersect("toks_a", "toks_b")) >= need).select("a", "b"), "rest")
        more = _verify(rest, reps, docs, n, percent)
        drop(spark, p2, p3, p4)
        if more.limit(1).count():
            drop(spark, *held)
            label, _ = components(links.unionByName(more))
    drop(spark, t1, t2)

    if label is not None:
        joined = reps.join(label, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
        least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
        reps = joined.join(least, "label").select("node", F.col("component_id").alias("rep"))
    out = light.join(reps, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document, that of the least id, for each component."""
    found = near_duplicates(docs, n, percent)
    gone = found.where("component_id <> doc_id").select("doc_id")
    return without(docs, keep(gone, "gone")[0], "doc_id")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)
