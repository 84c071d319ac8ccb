"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Each task builds one encoder from the broadcast rank file (its size is checked) and encodes its
rows batch by batch. Texts longer than ``cut_chars`` are cut first where a non-space character is
followed by white space: no match of the pattern spans such a place and no look-ahead crosses it,
so the ids are those of the whole text while one call never sees more than one stretch. A run of over
``LONG_RUN`` white-space characters, on which the library's pattern matching would exhaust its stack,
is encoded as the one match that it is: all of it at the end of a text, else all but its last
character, which belongs to what follows.

Defined results: a null text counts as empty and has no ids; extra columns, repeated rows and null
ids pass through untouched; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from platewise.llm.common import release, small_batches, table

RANKS = "byte_bpe_50k.tiktoken"
MAX_RANK_FILE = 64 << 20
CUT_CHARS = 1 << 16
PIECE_CHARS = 1 << 20

LONG_RUN = 4096

# White space as the pattern's library sees it (Python's also has four control characters).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
_RUN = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")
_built: dict[str, tiktoken.Encoding] = {}


def encoder(ranks: bytes, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file's bytes, built once in each Python worker."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _built:
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        _built[key] = tiktoken.Encoding(
            "local", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={}
        )
    return _built[key]


def stretches(text: str, cut_chars: int = CUT_CHARS) -> Iterator[str]:
    """Cut at the first safe place at or after every ``cut_chars`` characters."""
    start = 0
    while len(text) - start > cut_chars:
        m = _SAFE.search(text, start + cut_chars)
        if not m or m.start() >= len(text):
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(enc: tiktoken.Encoding, text: str, cut_chars: int = CUT_CHARS) -> list[int]:
    if len(text) <= min(cut_chars, LONG_RUN):
        return enc.encode_ordinary(text)
    out, start = [], 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        for part in stretches(text[start : run.start()], cut_chars):
            out += enc.encode_ordinary(part)
        out += enc._encode_single_piece(text[run.start() : end])
        start = end
    for part in stretches(text[start:], cut_chars):
        out += enc.encode_ordinary(part)
    return out


def decode(enc: tiktoken.Encoding, ids) -> bytes:
    """The raw bytes of ids; they need not be valid UTF-8 on their own."""
    return enc.decode_bytes(list(ids))


def _broadcast_ranks(spark: SparkSession, path: str):
    small_batches(spark)
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE + 1)
    if len(data) > MAX_RANK_FILE:
        raise ValueError(f"rank file over {MAX_RANK_FILE} bytes")
    return spark.sparkContext.broadcast(data)


def encode_frame(
    df: DataFrame,
    text: str = "text",
    out: str = "ids",
    rank_path: str | None = None,
    cut_chars: int = CUT_CHARS,
    exact: str | None = None,
) -> DataFrame:
    """``df`` with a column ``out`` of token ids and, if named, a column ``exact``: whether they
    decode to the very bytes of the text.

    A batch is worked off in pieces of about ``PIECE_CHARS`` characters, which bounds a task's
    memory for ids whatever the batch holds.
    """
    ranks = _broadcast_ranks(df.sparkSession, rank_path or public_tokenizers.path(RANKS))
    fields = [StructField(out, ArrayType(IntegerType()))] + ([StructField(exact, BooleanType())] if exact else [])
    schema = StructType([f for f in df.schema.fields if f.name not in (out, exact)] + fields)
    kept = [f.name for f in schema.fields[: -len(fields)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for batch in batches:
            size = pc.utf8_length(pc.fill_null(batch.column(text), "")).to_numpy(zero_copy_only=False)
            piece = np.cumsum(size) // PIECE_CHARS
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
            for first, last in zip(edges, edges[1:]):
                rows = batch.slice(first, last - first)
                ids, same = [], []
                for t in rows.column(text).to_pylist():
                    got = encode(enc, t or "", cut_chars)
                    ids.append(np.asarray(got, dtype=np.int32))
                    if exact:
                        same.append(decode(enc, got) == (t or "").encode())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))] + ([pa.array(same, pa.bool_())] if exact else [])
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in kept] + new, names=schema.names)
        release()

    return df.mapInArrow(run, schema)


def decode_frame(df: DataFrame, ids: str = "ids", out: str = "bytes", rank_path: str | None = None) -> DataFrame:
    """``df`` with a binary column ``out``: the bytes that the ids stand for (null ids: none)."""
    ranks = _broadcast_ranks(df.sparkSession, rank_path or public_tokenizers.path(RANKS))

    @F.pandas_udf("binary")
    def raw(col: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(ranks.value)
        for s in col:
            yield pd.Series([decode(enc, () if x is None else x) for x in s])

    return df.withColumn(out, raw(F.col(ids)))


def digests(
    df: DataFrame, key: str = "doc_id", text: str = "text", rank_path: str | None = None, cut_chars: int = CUT_CHARS
) -> DataFrame:
    """Per row: key, n_tokens, digest of the ids, digest of what they decode to.

    Encoding, decoding and hashing happen in one pass, so that no ids leave the task.
    """
    ranks = _broadcast_ranks(df.sparkSession, rank_path or public_tokenizers.path(RANKS))

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks.value)
        for s in texts:
            rows = []
            for t in s:
                ids = encode(enc, t or "", cut_chars)
                packed = np.asarray(ids, dtype="<u4").tobytes()
                rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decode(enc, ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(key), both(F.col(text)).alias("r")).select(key, "r.*")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
