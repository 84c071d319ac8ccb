"""Document fingerprints as Merkle trees over paragraphs and sections, with SQL functions only.

Leaves are blocks: sentences, or stretches of ``BLOCK`` characters of a longer sentence, within a
paragraph (line); in a paragraph of fewer than ``SHORT`` characters, stretches of ``SMALL_BLOCK``, so that
short texts have leaves to share. A paragraph's node digests its leaves. A section ends after a paragraph whose
digest ends in one of four digits, or at a blank line, so an insertion moves no later boundary; its
node digests its paragraphs. The root digests the sections. A fingerprint is written as

    root|section>leaf.length,leaf.length:paragraph;leaf.length:paragraph;|section>...

Equal texts have equal roots; where roots differ, the differing sections, paragraphs and leaves are
the edits (:func:`differing`). The likeness of two fingerprints walks the trees: equal roots are alike by
1; of unequal ones the sections with equal nodes count whole, and only those that differ are
compared by their leaves. It is the Dice coefficient of what both have, weighted by length, so both edits
and moves inside a text are seen.

``next`` texts come from one shuffle of the table by ranges of the key: quantiles cut the key into up
to ``MAX_RANGES`` ranges, a window looks one row ahead inside each range, and the first row of every
range is also given to the range before it. A row finds its range in two steps, first among every
``STRIDE``-th bound, then among those between.

Defined results: a null text counts as empty; the empty text has one paragraph
without leaves, and two empty texts are alike by 1; rows with equal keys are ordered by text; rows with a null key come first; a
table of one row is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.llm.common import table, text_or_empty

BLOCK = 160
ROWS_PER_RANGE = 2000
MAX_RANGES = 1 << 16
STRIDE = 256
SHORT, SMALL_BLOCK = 100, 10
LEAF = rf"[^.!?]{{1,{BLOCK}}}[.!?]*|[.!?]+"
SMALL_LEAF = rf".{{1,{SMALL_BLOCK}}}"


def digest(col: Column) -> Column:
    """16 hex digits of SHA-256."""
    return F.substring(F.sha2(col, 256), 1, 16)


def _leaves_of(p: Column) -> Column:
    leaf = F.when(F.length(p) < SHORT, F.lit(f"(?s){SMALL_LEAF}")).otherwise(F.lit(f"(?s){LEAF}"))
    blocks = F.regexp_extract_all(p, leaf, F.lit(0))
    return F.array_join(F.transform(blocks, lambda b: F.concat(digest(b), F.lit("."), F.length(b))), ",")


def fingerprint(text: Column) -> Column:
    paragraphs = F.transform(F.split(text_or_empty(text), "\n", -1), _leaves_of)
    paragraphs = F.array_join(F.transform(paragraphs, lambda p: F.concat(p, F.lit(":"), digest(p), F.lit(";"))), "")
    # a paragraph's digest stands last; that of a blank line ends in 4
    sections = F.filter(F.split(paragraphs, r"(?<=[048c];)"), lambda s: s != "")
    body = F.array_join(F.transform(sections, lambda s: F.concat(digest(s), F.lit(">"), s)), "|")
    # a one-element transform names the value, which is thereby computed once
    return F.transform(F.array(body), lambda b: F.concat(F.sha2(b, 256), F.lit("|"), b))[0]


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def leaves(fp: Column) -> Column:
    """The set of ``digest.length`` leaves."""
    return F.array_distinct(F.regexp_extract_all(fp, F.lit(r"[0-9a-f]{16}\.[0-9]+"), F.lit(0)))


def _weight(of: Column) -> Column:
    return F.aggregate(of, F.lit(0).cast("bigint"), lambda s, x: s + F.substring(x, 18, 20).cast("bigint"))


def sections(fp: Column) -> Column:
    """The distinct section nodes, each with what lies below it."""
    return F.array_distinct(F.slice(F.split(fp, r"\|"), 2, 1 << 30))


def _alike(root_a: Column, root_b: Column, sa: Column, sb: Column) -> Column:
    """By sections that are equal, and by the leaves of those that are not."""

    def below(nodes):
        return leaves(F.array_join(nodes, "|"))

    def walk(x):
        same, la, lb = _weight(below(x["same"])), below(x["a"]), below(x["b"])
        shared = same + _weight(F.array_intersect(la, lb))
        whole = 2 * same + _weight(la) + _weight(lb)
        return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(2.0) * shared / whole)

    parts = F.struct(F.array_intersect(sa, sb).alias("same"), F.array_except(sa, sb).alias("a"), F.array_except(sb, sa).alias("b"))
    # a one-element transform names the parts, which are thereby computed once
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(F.transform(F.array(parts), walk)[0])


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, 0 for nothing in common."""
    return _alike(root(a), root(b), sections(a), sections(b))


def differing(a: Column, b: Column) -> Column:
    """Paragraph nodes of ``b`` that ``a`` does not have, found by section first: the edits."""

    def nodes(s):
        return F.regexp_extract_all(F.array_join(s, "|"), F.lit(r":([0-9a-f]{16})"), F.lit(1))

    changed_a, changed_b = F.array_except(sections(a), sections(b)), F.array_except(sections(b), sections(a))
    return F.array_except(nodes(changed_b), nodes(changed_a))


def _range_of(key: Column, bounds: list[int], stride: int = STRIDE) -> Column:
    """How many of the sorted bounds are not above the key."""

    def upto(edges):
        return F.size(F.filter(edges, lambda b: b <= key))

    def literal(values):
        return F.array(*map(F.lit, values)).cast("array<bigint>") if len(values) <= stride else F.lit(np.array(values, dtype=np.int64))

    if len(bounds) <= stride:
        return upto(literal(bounds))
    coarse = upto(literal(bounds[::stride]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * stride + upto(F.slice(literal(bounds), (coarse - 1) * stride + 1, stride)))


def next_rows(df: DataFrame, key: str, carry: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with ``next_<c>`` for every column of ``carry``: its value in the next row by ``key``."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least")).first()
    n_ranges = max(1, min(MAX_RANGES, -(-stats.n // rows_per_range)))
    bounds = []
    if n_ranges > 1 and stats.least is not None:
        cuts = [i / n_ranges for i in range(1, n_ranges)]
        got = df.agg(F.percentile_approx(key, cuts, 10 * n_ranges).alias("q")).first().q
        bounds = sorted({q for q in got if q > stats.least})
    place = F.when(F.col(key).isNull(), 0).otherwise(_range_of(F.col(key), bounds))
    ranged = df.withColumn("_range", place.cast("int")).withColumn("_ghost", F.lit(False))
    # the least key of each range and, for its first row, the range before it: one row a range
    firsts = ranged.groupBy("_range").agg(F.min(F.struct(F.col(key).isNotNull().alias("k"), F.col(key).alias("key"))).alias("f")).collect()
    starts = sorted((r["_range"], r["f"]["key"]) for r in firsts)
    if starts:
        rows = [(r, k, starts[i - 1][0]) for i, (r, k) in enumerate(starts)]
        known = F.broadcast(df.sparkSession.createDataFrame(rows, "_range int, _first bigint, _before int"))  # at most MAX_RANGES rows
        # of equal first keys the least text is the first row
        rank = F.row_number().over(Window.partitionBy("_range").orderBy("_text"))
        ghosts = ranged.join(known, "_range").where(F.col(key).eqNullSafe(F.col("_first"))).withColumn("_rank", rank).where("_rank = 1")
        ghosts = ghosts.withColumn("_ghost", F.lit(True)).withColumn("_range", F.col("_before")).select(ranged.columns)
        ranged = ranged.unionByName(ghosts)
    w = Window.partitionBy("_range").orderBy(F.col("_ghost").asc(), F.col(key).asc_nulls_first(), "_text")
    for c in carry:
        ranged = ranged.withColumn(f"next_{c}", F.lead(c).over(w))
    return ranged.where("not _ghost").drop("_range", "_ghost")


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by as many of the following text."""
    n = F.length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - k), F.substr(following, F.lit(1), k))


def compare_with_next(docs: DataFrame) -> DataFrame:
    base = docs.select("doc_id", text_or_empty("text").alias("_text")).withColumn("fingerprint", fingerprint(F.col("_text")))
    out = next_rows(base, "doc_id", ["_text", "fingerprint"])
    out = out.select(
        "doc_id",
        F.length("_text").cast("bigint").alias("n_chars"),
        "fingerprint",
        root(F.col("next_fingerprint")).alias("next_root"),
        sections(F.col("next_fingerprint")).alias("next_sections"),
        edited_text(F.col("_text"), F.col("next__text")).alias("edited"),
    )
    out = out.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    out = out.withColumn("own", sections(F.col("fingerprint"))).withColumn("changed", sections(F.col("edited_fingerprint")))
    own_root = root(F.col("fingerprint"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        _alike(own_root, root(F.col("edited_fingerprint")), F.col("own"), F.col("changed")).alias("near_edited"),
        _alike(own_root, F.col("next_root"), F.col("own"), F.col("next_sections")).alias("near_next"),
    )


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
