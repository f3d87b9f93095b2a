r"""Conversations as training text, verified by parsing them back.

Grammar (``turn`` repeats; nothing stands between turns):

    turn    = "### " name ": " content "</turn>" LF
    content = any characters; "\\" stands for "\", "\###" for "###", "\</turn>" for
              "</turn>"; these three strings do not occur otherwise
    name    = like content, and "\:" stands for ":"

A turn is rendered plainly, parsed, and compared with its source; texts that do not
come back identical are escaped and rendered again. Turns are rendered and digested
one by one, so a conversation may have any number of them.

Defined results: null text and null role are empty; turns with equal numbers are
ordered by role, then text; repeated rows are turns of their own; a null conversation
id is a conversation; no rows give no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from passagekit.llm.common import table, text_of
from passagekit.plans.registry import query
from passagekit.scale import stage

OPEN, CLOSE = "### ", "</turn>\n"
CONTROLS = ("###", "</turn>")
ASSISTANT = "assistant"

# An escape with what it stands for, or a control string.
_STOP = re.compile(r"\\(\\|###|</turn>)?|###|</turn>")
_STOP_OF_NAME = re.compile(r"\\(\\|###|</turn>|:)?|###|</turn>|:")


class GrammarError(ValueError):
    pass


def escaped(text: str, name: bool = False) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROLS + ((":",) if name else ()):
        text = text.replace(control, "\\" + control)
    return text


def _content(text: str, at: int, end: str, name: bool) -> tuple[str, int]:
    """Content from ``at`` up to the string ``end``, and the place behind it."""
    parts, start = [], at
    for stop in (_STOP_OF_NAME if name else _STOP).finditer(text, at):
        at = stop.start()
        if text[at] != "\\":
            if not text.startswith(end, at):
                raise GrammarError(f"control string at {at}")
            return "".join([*parts, text[start:at]]), at + len(end)
        if stop[1] is None:
            raise GrammarError(f"stray escape at {at}")
        parts += [text[start:at], stop[1]]
        start = stop.end()
    raise GrammarError("content has no end")


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of all turns; the range is that of the content."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise GrammarError(f"no turn at {at}")
        role, begin = _content(text, at + len(OPEN), ": ", True)
        content, at = _content(text, begin, CLOSE, False)
        turns.append((role, content, begin, at - len(CLOSE)))
    return turns


def _comes_back(piece: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(piece)] == [(role, text)]
    except GrammarError:
        return False


def render(role: str, text: str) -> str:
    """One turn. What does not come back identical is escaped, the text first."""
    for name, content in ((role, text), (role, escaped(text)), (escaped(role, True), escaped(text))):
        piece = f"{OPEN}{name}: {content}{CLOSE}"
        if _comes_back(piece, role, text):
            return piece
    raise GrammarError(f"no form of {role!r} comes back")


def format_turns(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_col, turn, role, text, formatted), one row per turn.

    The formatted turns of a conversation, joined in the order of (turn, role, text),
    are its training text.
    """
    source = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text")
    )
    schema = T.StructType([*source.schema, T.StructField("formatted", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render(role, text) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [f.name for f in schema])

    return source.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def conversation_texts(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, formatted): each conversation's training text as one string."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "formatted")))
    return turns.groupBy(conv_col).agg(F.array_join(F.transform(ordered, lambda t: t["formatted"]), "").alias("formatted"))


class _Digest:
    """What is read back of one conversation, turn by turn."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str) -> None:
        for role, text, _, _ in parse(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == ASSISTANT:
                self.loss_chars += len(text)
                self.loss.update(text.encode())
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation, parsed from the formatted turns alone.

    Turns are sorted within partitions and read as a stream: a task holds one batch,
    however long a conversation is.
    """
    fields = [
        ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()),
        ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()),
    ]
    schema = T.StructType([turns.schema[conv_col], *[T.StructField(n, t) for n, t in fields]])
    names = [f.name for f in schema]
    ordered = turns.repartition(conv_col).sortWithinPartitions(conv_col, "turn", "role", "text").select(conv_col, "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            done = []
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if current is None or current.conv != conv:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conv)
                current.add(piece)
            yield _batch(done, batch.schema.field(0).type)
            kind = batch.schema.field(0).type
        if current is not None:
            yield _batch([current.row()], kind)

    def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return ordered.mapInArrow(run, schema)


#: Fixed values of the result contract: a conversation made of control strings.
HARD_ID = -7
HARD_TEXT = "\\### Assistant: </turn> ok"

SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {HARD_ID}, 0, 'user', '{HARD_TEXT}'
  UNION ALL SELECT {HARD_ID}, 1, 'assistant', '{HARD_TEXT}'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>') AS content,
         replace(replace(replace(replace(role, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>'), ':', '\\:') AS name
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(name) + length(content) + {len(OPEN) + 2 + len(CLOSE)}) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op2_chat", SQL)
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted text of every conversation says when it is read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(
        [(HARD_ID, turn, role, HARD_TEXT) for turn, role in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string",
    )
    return read_back(stage(format_turns(rows.unionByName(hard)), "chat"))
