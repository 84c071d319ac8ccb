"""Chat formatting by event-sourced reconstruction.

A log holds events ``(conv_id, seq, msg, kind, role, text)``. ``open`` starts a message, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` empties it and what follows fills it
again. :func:`fold` partitions the log by conversation and message and folds each message's events
in the order of ``seq``; :func:`render` partitions the messages by conversation, sorts by position
and writes each turn as

    ### Role: text</turn>\\n

Both go through the rows as a stream, so a task holds one message and never a whole conversation; a
conversation with a third of all rows is one long stream. In texts and roles a backslash goes before
every backslash, ``###`` and ``</turn>`` (and ``:`` in roles), which :func:`read_back` undoes.

Defined results: null texts and roles count as empty; a null conversation id is a conversation of
its own; turns with equal positions are ordered by role and text, and repeated rows are turns each;
an empty log gives no rows; extra columns are ignored. Events before a message's ``open`` count,
since the order is that of ``seq`` alone; unknown kinds are errors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.llm.common import table

HEAD, TAIL = "### ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.S)

MESSAGES = "conv_id bigint, pos bigint, role string, text string"
RENDERED = "conv_id bigint, pos bigint, role string, segment string, loss_from int, loss_to int"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn, and where its text begins and ends in it."""
    head = HEAD + _CONTROL_ROLE.sub(lambda m: "\\" + m[0], role) + ": "
    body = escape(text)
    return head + body + TAIL, len(head), len(head) + len(body)


def read_back(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    m = _TURN.fullmatch(segment)
    if not m:
        raise ValueError("not a rendered turn")
    return unescape(m[1]), unescape(m[2])


def _str(x) -> str:
    return x if isinstance(x, str) else ""


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, pos, role, text); ``msg`` gives the position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, role, parts = None, "", []
        for pdf in batches:
            out = []
            for conv, msg, dup, kind, r, text in zip(pdf.conv_id, pdf.msg, pdf.dup, pdf.kind, pdf.role, pdf.text):
                key = (conv, msg, dup)
                if at is None or not all(map(_same, key, at)):
                    if at is not None:
                        out.append((at[0], at[1], role, "".join(parts)))
                    at, role, parts = key, "", []
                if kind == "open":
                    role = _str(r)
                elif kind == "delta":
                    parts.append(_str(text))
                elif kind == "edit":
                    parts = [_str(text)]
                elif kind == "regenerate":
                    parts = []
                else:
                    raise ValueError(f"unknown kind {kind!r}")
            yield _frame(out)
        if at is not None:
            yield _frame([(at[0], at[1], role, "".join(parts))])

    def _frame(rows):
        pdf = pd.DataFrame(rows, columns=["conv_id", "pos", "role", "text"])
        return pdf.astype({"conv_id": "Int64", "pos": "Int64"})

    if "dup" not in log.columns:
        log = log.withColumn("dup", F.lit(0))
    log = log.select("conv_id", "msg", "dup", "seq", "kind", "role", "text")
    dealt = log.repartition("conv_id", "msg", "dup").sortWithinPartitions("conv_id", "msg", "dup", "seq", "kind", "text")
    return dealt.mapInPandas(run, MESSAGES)


def log_of_turns(conversations: DataFrame, piece: int = 256) -> DataFrame:
    """A log that folds back to the stored turns.

    A message is opened and streamed as a ``delta`` for every ``piece`` characters. By hash of its text
    one in three is a first draft that is regenerated (the draft is the text backwards, half of it),
    and one in three ends in another text that an ``edit`` replaces. Rows that share conversation and
    turn are messages each, told apart by ``dup``, and may come in any order.
    """
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("dup", F.row_number().over(w))
    pieces = F.ceil(F.length("text") / piece).cast("int")
    none, way = F.lit(None).cast("string"), F.pmod(F.xxhash64("text"), F.lit(3))

    def event(seq, kind, role=none, text=none):
        return F.struct(seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    def streamed(i):
        return event(i + 3, "delta", text=F.substr("text", (i - 1) * piece + 1, F.lit(piece)))

    opening = F.array(event(F.lit(0), "open", F.col("role")))
    draft = F.array(event(F.lit(1), "delta", text=F.reverse(F.substr("text", F.lit(1), F.length("text") / 2))), event(F.lit(2), "regenerate"))
    deltas = F.when(pieces > 0, F.transform(F.sequence(F.lit(1), pieces), streamed)).otherwise(F.slice(opening, 1, 0))
    early = F.array(event(F.lit(1), "delta", text=F.concat(F.reverse(F.substr("text", F.lit(1), F.lit(piece))), F.lit(" ..."))), event(F.lit(2), "edit", text=F.col("text")))
    events = F.when(way == 0, F.concat(opening, draft, deltas)).when(way == 1, F.concat(opening, early)).otherwise(F.concat(opening, deltas))
    return rows.select("conv_id", F.col("turn").alias("msg"), "dup", F.explode(events).alias("e")).select("conv_id", "msg", "dup", "e.*")


def _ordered(messages: DataFrame) -> DataFrame:
    return messages.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """One row a turn: its segment of the output and the loss mask inside it (assistant texts).

    A conversation's output is its segments in the order of pos.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for role, text in zip(pdf.role, pdf.text):
                role, (seg, a, b) = _str(role), turn(_str(role), _str(text))
                rows.append((role, seg, a if role == "assistant" else 0, b if role == "assistant" else 0))
            new = pd.DataFrame(rows, columns=["role", "segment", "loss_from", "loss_to"], index=pdf.index)
            yield pd.concat([pdf[["conv_id", "pos"]].astype("Int64"), new], axis=1)

    return _ordered(messages).mapInPandas(run, RENDERED)


def read_rendered(rendered: DataFrame) -> DataFrame:
    """Per conversation what its output says, read from the segments alone.

    ``rendered`` comes straight from :func:`render`, which leaves the turns of a conversation
    together and in order.
    """

    class Sums:
        def __init__(self):
            self.n = self.loss = self.chars = 0
            self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

        def add(self, seg, a, b):
            role, text = read_back(seg)
            self.n += 1
            self.chars += len(seg)
            self.turns.update(f"{role}\n{text}\n".encode())
            masked = unescape(seg[a:b])
            self.loss += len(masked)
            self.masked.update(masked.encode())

        def row(self, conv):
            return conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums = None, None
        for pdf in batches:
            out = []
            for conv, seg, a, b in zip(pdf.conv_id, pdf.segment, pdf.loss_from, pdf.loss_to):
                if sums is None or not _same(conv, at):
                    if sums is not None:
                        out.append(sums.row(at))
                    at, sums = conv, Sums()
                sums.add(seg, a, b)
            yield _rows(out)
        if sums is not None:
            yield _rows([sums.row(at)])

    def _rows(rows):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    return rendered.mapInPandas(run, READ)


PROBE = r"\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_rendered(render(fold(log_of_turns(turns))))
