"""Language-model scores by context-tree weighting.

A text is the stream of its tokens: lower-cased (A-Z) words, one space between two, and an end mark,
a byte that UTF-8 does not have; before it stand as many end marks as a context has bytes. Each byte
is eight binary decisions, and each decision has a context tree over the ``depth`` bytes before it.
In every node a Krichevsky-Trofimov estimate stands for "the context ends here", with weight 1/2
against the product of the node's children (:func:`kt`, :func:`levels`). What a tree says of the next
bit is thus a mixture of the estimates at all depths on the path, each with its posterior weight.
The code length of a byte is the sum over its eight bits.

The tree follows from the counts of byte (depth + 1)-grams, and a text's score needs the code lengths
of its own grams only:

1. One pass over the texts packs them into parts of ``PART_BYTES``, wherever they come from, and
   writes for each part its texts, and its distinct grams and words with their counts in learning
   texts. Grams are dealt into ``REGIONS`` by the last two bytes of their context, so that a region
   holds whole subtrees; words by hash.
2. Grams and words are folded by region as a stream: the whole corpus' counts, with none left out.
3. Each region sends its subtrees' weighted probabilities up. Depths 0 and 1 have at most 256 x 256
   nodes; only these meet on the driver, and go out to all regions, which then know the code lengths.
4. Each part gets the code lengths of its grams and the counts of its words back from their regions,
   and sums them for its texts. A region that many parts ask is dealt by salt.

Defined results: a null or empty text is the end mark alone; a row with a null id is scored and
learned from; repeated rows are scored and learned from each time; without learning texts every bit
costs one bit; an empty table gives an empty table; columns other than doc_id and text are ignored.
Texts of any length are read in stretches of ``STRETCH`` bytes with their contexts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import drop, keep, release, table

DEPTH = 5
REGIONS = 1024
PART_BYTES = 16 << 20
STRETCH = 1 << 20
CHUNK = 2 << 20  # bytes whose grams are sorted at a time
ASKED_BYTES = 32 << 20  # keys that a region looks up at a time
FOLD = 1 << 21  # grams that a fold holds before it adds them up
END = b"\xff"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HALF = math.log(0.5)

PARTS = "part bigint, kind string, doc_id bigint, held_out boolean, body binary, region int, keys binary, counts binary"
ANSWERS = "part bigint, kind string, region int, keys binary, values binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def body_of(text: str | None) -> bytes:
    """Lower-cased words with one space between."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())


def stretches(bodies: Iterable[bytes], depth: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of about ``CHUNK`` bytes of (number of the text, stretch with its context)."""
    out, size = [], 0
    for k, body in enumerate(bodies):
        stream = END * depth + body + END
        for i in range(0, len(stream) - depth, STRETCH):
            out.append((k, stream[i : i + STRETCH + depth]))
            size += len(out[-1][1])
            if size >= CHUNK:
                yield out
                out, size = [], 0
    if out:
        yield out


def grams_of(pieces: list[tuple[int, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of stretches laid end to end, and where each stretch begins among them."""
    flat = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
    size = np.array([len(p) for _, p in pieces])
    first = np.cumsum(size) - size
    n = len(flat) - depth
    grams = flat[:n].astype(np.uint64)
    for k in range(1, depth + 1):
        grams <<= np.uint64(8)
        grams |= flat[k : k + n]
    inside = np.ones(len(flat), bool)  # by the gram's last byte: contexts are not predicted
    inside[(first[:, None] + np.arange(depth)).ravel()] = False
    return grams[inside[depth:]], first - depth * np.arange(len(pieces))


def added(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams with the sums of their counts."""
    g, n = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return g[starts], np.add.reduceat(n, starts) if len(g) else n


def region_of(grams: np.ndarray) -> np.ndarray:
    """By the last two bytes of the context."""
    pair = (grams >> np.uint64(8)) & np.uint64(0xFFFF)
    return (((pair * np.uint64(40503)) & np.uint64(0xFFFF)) % np.uint64(REGIONS)).astype(np.uint16)


def by_region(region: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of keys by their regions, the regions, and where each begins."""
    order = np.argsort(region, kind="stable")
    names, starts = np.unique(region[order], return_index=True)
    return order, names.astype(np.int32), starts


def packed(docs: DataFrame, depth: int) -> DataFrame:
    """Rows of PARTS: texts of every part, and by region the grams (eight bytes each) and words (with spaces between) in them."""
    names = [f.split()[0] for f in PARTS.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}
    schema = pa.schema([(n, types[f.split()[1]]) for n, f in zip(names, PARTS.split(", "))])

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def flush(part: int, docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(docs), 1000):
            some = docs[i : i + 1000]
            ids, held, bodies = zip(*some)
            yield rows(len(some), part=[part] * len(some), kind=["text"] * len(some), doc_id=ids, held_out=held, body=bodies)
        found, counts = [], []
        for held in (False, True):
            for pieces in stretches((b for _, h, b in docs if h == held), depth):
                g, n = np.unique(grams_of(pieces, depth)[0], return_counts=True)
                found.append(g)
                counts.append(n * (not held))
        grams, n = added(found, counts)
        order, regions, starts = by_region(region_of(grams))
        g, n = np.split(grams[order], starts[1:]), np.split(n[order].astype(np.uint32), starts[1:])
        yield rows(len(g), part=[part] * len(g), kind=["grams"] * len(g), region=regions, keys=[x.tobytes() for x in g], counts=[x.tobytes() for x in n])
        words: Counter[bytes] = Counter()
        for _, held, body in docs:
            if held:
                words.update(dict.fromkeys(body.split(b" "), 0))
            else:
                words.update(body.split(b" "))
        words.pop(b"", None)
        listed, n = list(words), np.fromiter(words.values(), np.uint32, len(words))
        order, regions, starts = by_region(np.fromiter(map(crc32, listed), np.int64, len(listed)) % REGIONS)
        w, n = np.split(order, starts[1:]), np.split(n[order], starts[1:])
        yield rows(len(regions), part=[part] * len(regions), kind=["words"] * len(regions), region=regions, keys=[b" ".join(map(listed.__getitem__, x.tolist())) for x in w[: len(regions)]], counts=[x.tobytes() for x in n[: len(regions)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for i, out, text in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), batch["text"]):
                held.append((i, out, body_of(text.as_py())))
                size += len(held[-1][2])
                if size >= PART_BYTES:
                    yield from flush(part, held)
                    part, held, size = part + 1, [], 0
        if held:
            yield from flush(part, held)
            held = []
        release()

    return docs.mapInArrow(run, PARTS)


def folded(asked: DataFrame) -> DataFrame:
    """(kind, region, keys, counts, total, learned): sums over all parts, and the number of keys that occur in learning texts."""
    schema = "kind string, region int, keys binary, counts binary, total bigint, learned bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, found, counts, held, words = None, [], [], 0, Counter()

        def out():
            keys, n = (b" ".join(words), np.fromiter(words.values(), np.int64, len(words))) if words else added(found, counts)
            return pd.DataFrame([(*at, keys if words else keys.tobytes(), n.tobytes(), int(n.sum()), int((n > 0).sum()))], columns=[f.split()[0] for f in schema.split(", ")])

        for pdf in batches:
            for kind, r, keys, n in zip(pdf.kind, pdf.region, pdf["keys"], pdf.counts):
                if (kind, r) != at:
                    if at is not None:
                        yield out()
                    at, found, counts, held, words = (kind, r), [], [], 0, Counter()
                n = np.frombuffer(n, np.uint32).astype(np.int64)
                if kind == "words":
                    words.update(dict(zip(keys.split(b" "), n.tolist())))
                    continue
                found.append(np.frombuffer(keys, np.uint64))
                counts.append(n)
                held += len(n)
                if held >= FOLD + 2 * len(found[0]):
                    g, n = added(found, counts)
                    found, counts, held = [g], [n], len(g)
        if at is not None:
            yield out()
        found, counts, words = [], [], None
        release()

    by = ["kind", "region"]
    return asked.select(*by, "keys", "counts").repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, eight steps up."""
    y, steps = x + 8, np.ones_like(x)
    for k in range(8):
        steps = steps * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)


def mixed(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes whose children's weighted probabilities multiply to ``below``: the weight of the own estimate and the log of the weighted probability."""
    own = kt(n0, n1)
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.logaddexp(own, below) + HALF


def levels(grams: np.ndarray, counts: np.ndarray, bit: int, depth: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """The nodes of one bit's trees from ``depth`` up to depth 2.

    Each level has, for what stands below it, the number of its node, and n0, n1 and own weight by
    node; then keys (context, decision) and log weighted probabilities of the nodes at depth 2.
    """
    byte = (grams & np.uint64(255)).astype(np.int64)
    digit = (byte >> (7 - bit)) & 1
    keys, at = np.unique((grams & ~np.uint64(255)) | ((1 << bit) | (byte >> (8 - bit))).astype(np.uint64), return_inverse=True)
    n0, n1 = np.bincount(at, counts * (1 - digit), len(keys)), np.bincount(at, counts * digit, len(keys))
    out, log_w = [(at, n0, n1, np.ones(len(keys)))], kt(n0, n1)
    for d in range(depth - 1, 1, -1):
        keys, at = np.unique(keys & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        n0, n1 = np.bincount(at, n0, len(keys)), np.bincount(at, n1, len(keys))
        weight, log_w = mixed(n0, n1, np.bincount(at, log_w, len(keys)))
        out.append((at, n0, n1, weight))
    return out, keys, log_w


def top_of(model: DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of depths 0 and 1 by last byte and decision: their share of P(1), and what is left to the depths below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, 1 << 16))
        for pdf in batches:
            for g, n in zip(pdf["keys"], pdf.counts):
                g, n = np.frombuffer(g, np.uint64), np.frombuffer(n, np.int64)
                for bit in range(8):
                    found, keys, log_w = levels(g, n, bit, depth)
                    at = (keys & np.uint64(0xFFFF)).astype(np.int64)
                    for k, values in enumerate((found[-1][1], found[-1][2], log_w)):
                        sums[k] += np.bincount(at, values, 1 << 16)
        at = np.flatnonzero(sums.any(0))
        yield pd.DataFrame({"at": at, "n0": sums[0][at], "n1": sums[1][at], "log_w": sums[2][at]})

    parts = model.mapInPandas(run, "at int, n0 double, n1 double, log_w double")
    n0, n1, below = np.zeros((3, 1 << 16))
    for r in parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "log_w")]).collect():  # at most 65,536
        n0[r["at"]], n1[r["at"]], below[r["at"]] = r["n0"], r["n1"], r["log_w"]
    weight, log_w = mixed(n0, n1, below)
    r0, r1 = n0.reshape(256, 256).sum(0), n1.reshape(256, 256).sum(0)
    root, _ = mixed(r0, r1, log_w.reshape(256, 256).sum(0))
    first = np.tile(root * (r1 + 0.5) / (r0 + r1 + 1), 256)
    rest = np.tile(1 - root, 256)
    return first + rest * weight * (n1 + 0.5) / (n0 + n1 + 1), rest * (1 - weight)


def log_probabilities(grams: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """log10 P(last byte | those before it) of a region's sorted grams."""
    out = np.zeros(len(grams))
    byte = (grams & np.uint64(255)).astype(np.int64)
    for bit in range(8):
        found, keys, _ = levels(grams, counts, bit, depth)
        at = (keys & np.uint64(0xFFFF)).astype(np.int64)
        one, rest = top[0][at], top[1][at]
        for up, n0, n1, weight in reversed(found):
            one = one + rest * weight * (n1 + 0.5) / (n0 + n1 + 1)
            rest = rest * (1 - weight)
            one, rest = one[up], rest[up]
        out += np.log10(np.where((byte >> (7 - bit)) & 1 == 1, one, 1 - one))
    return out


class Lookup:
    """Values of a closed set of grams: a gram whose slot no other one has needs no comparison."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.grams, self.values = grams, values
        self.shift = np.uint64(64 - max(10, int(8 * len(grams) + 1).bit_length()))
        slot = self._slot(grams)
        self.table = np.full(1 << (64 - int(self.shift)), np.nan, np.float32)
        alone = np.bincount(slot)[slot] == 1
        self.table[slot[alone]] = values[alone]

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        out = self.table[self._slot(grams)]
        shared = np.flatnonzero(np.isnan(out))
        out[shared] = self.values[np.searchsorted(self.grams, grams[shared])]
        return out


def code_lengths(model: DataFrame, depth: int) -> DataFrame:
    """(kind, region, keys, values): every gram of the corpus with its log10 probability."""
    top = model.sparkSession.sparkContext.broadcast(top_of(model, depth))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, g, n in zip(pdf.region, pdf["keys"], pdf.counts):
                logs = log_probabilities(np.frombuffer(g, np.uint64), np.frombuffer(n, np.int64), top.value, depth)
                yield pd.DataFrame([("grams", r, g, logs.tobytes())], columns=["kind", "region", "keys", "values"])
        release()

    return model.mapInPandas(run, "kind string, region int, keys binary, values binary")


def answered(asked: DataFrame, known: DataFrame, salts: int) -> DataFrame:
    """Rows of ANSWERS: what is known of the keys that each part asks of each region.

    Grams do not travel back: a part has the same ones again, in the same order, from its texts.
    """
    asked = asked.select("part", "kind", "region", "keys", F.pmod(F.xxhash64("part"), F.lit(salts)).cast("int").alias("salt"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked) and asked.kind[0] == "words":
            counts = dict(zip(known["keys"][0].split(b" "), np.frombuffer(known["values"][0], np.int64).tolist()))
            for part, region, words in zip(asked.part, asked.region, asked["keys"]):
                found = map(counts.__getitem__, words.split(b" "))
                rows.append((part, "words", region, words, np.fromiter(found, np.int64).tobytes()))
        elif len(asked):
            grams, logs = np.frombuffer(known["keys"][0], np.uint64), np.frombuffer(known["values"][0])
            for part, region, keys in zip(asked.part, asked.region, asked["keys"]):
                found = logs[np.searchsorted(grams, np.frombuffer(keys, np.uint64))]
                rows.append((part, "grams", region, None, found.astype(np.float32).tobytes()))
        return pd.DataFrame(rows, columns=["part", "kind", "region", "keys", "values"])

    by = ["kind", "region", "salt"]
    return asked.groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(run, ANSWERS)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def summed(texts: DataFrame, answers: DataFrame, n_tokens: int, n_words: int, n_texts: int, depth: int) -> DataFrame:
    """Rows of SCORES: per part, its texts with the code lengths and word counts that it asked for."""
    below = n_tokens + 0.5 * (n_words + 1)

    def share(count: int) -> float:
        return math.log10((count + 0.5) / below)

    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        bodies = texts.body.tolist()
        told = {kind: answers[answers.kind == kind].sort_values("region") for kind in ("grams", "words")}
        grams = np.unique(np.concatenate([np.unique(grams_of(p, depth)[0]) for p in stretches(bodies, depth)]))
        logs = np.empty(len(grams), np.float32)
        logs[by_region(region_of(grams))[0]] = np.frombuffer(b"".join(told["grams"]["values"]), np.float32)
        look = Lookup(grams, logs)
        score = np.zeros(len(bodies))
        for pieces in stretches(bodies, depth):
            g, first = grams_of(pieces, depth)
            np.add.at(score, [k for k, _ in pieces], np.add.reduceat(look(g).astype(float), first))
        counts = np.frombuffer(b"".join(told["words"]["values"]), np.int64)
        worth = {w: share(n) for w, n in zip(b" ".join(told["words"]["keys"]).split(b" "), counts.tolist()) if n}
        end, unknown = share(n_texts), share(0)
        rows = []
        for i, held, body, s in zip(texts.doc_id, texts.held_out, bodies, score):
            own = body.split(b" ") if body else []
            found = [worth[w] for w in own if w in worth]
            base = math.fsum(found) + (len(own) - len(found)) * unknown + end
            rows.append((i, held, len(own) + 1, len(found) + (n_texts > 0), n_tokens, base, float(s), -float(s) / math.log10(2) / (len(body) + 1)))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in SCORES.split(", ")]).astype({"doc_id": "Int64"})

    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(run, SCORES)


def score(docs: DataFrame, held: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """Rows of SCORES for every row of ``docs`` (doc_id, text), learned from those that are not held out."""
    if not 2 <= depth <= 7:
        raise ValueError("contexts have 2 to 7 bytes")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (held_out() if held is None else held).alias("held_out"), F.col("text").cast("string").alias("text"))
    parts, path = keep(packed(rows, depth), "parts", "zstd")
    asked = parts.where("kind <> 'text'")
    counts, counts_path = keep(folded(asked), "counts")
    texts = parts.where("kind = 'text'").select("part", "doc_id", "held_out", "body")
    n_texts = texts.where("not held_out").count()
    words = counts.where("kind = 'words'")
    n, v = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("learned"), F.lit(0))).first()
    asked_bytes = asked.groupBy("kind", "region").agg(F.sum(F.octet_length("keys")).alias("b")).agg(F.max("b")).first()[0] or 0
    drop(spark)  # shuffle files of the steps so far
    known = code_lengths(counts.where("kind = 'grams'"), depth).unionByName(words.select("kind", "region", "keys", F.col("counts").alias("values")))
    answers = answered(asked, known, 1 + asked_bytes // ASKED_BYTES)
    out, _ = keep(summed(texts, answers, n + n_texts, v + (n_texts > 0), n_texts, depth), "scores")
    drop(spark, path, counts_path)
    return out


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
