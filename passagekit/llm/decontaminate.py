"""Benchmark passages inside documents, found by one Aho-Corasick automaton.

Windows of benchmark words become the patterns of one automaton. Every document is
scanned once in its normalised form; hits are mapped back to word numbers and to
code-point offsets of the original text.

Defined results: null text has no words; an item without words has no window; an
item whose id is null marks words but is not counted; repeated items count once;
every input row gives one output row, also when ids repeat. Other columns of the
documents are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from passagekit.llm.common import UPPER, ascii_lower, fresh, table, text_of
from passagekit.plans.registry import query
from passagekit.scale import drop_stage, stage

#: Fixed value of the result contract: what separates words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10

#: Windows in one automaton, and bytes of them. More are scanned for in several passes
#: with a stored table between, so that a worker never holds more than one automaton.
MAX_WINDOWS = 2_000_000
MAX_WINDOW_BYTES = 256 << 20

_JOINED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_SPAN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hits", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ]))),
])


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(window, n, items): distinct word windows and the items that have them.

    An item with fewer than ``window`` words, but not none, is one window.
    """
    words = F.regexp_extract_all(ascii_lower(text_of(text_col)), F.lit(WORD), F.lit(0))
    lists = items.select(F.col(id_col).cast("string").alias("item"), words.alias("words"))
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    windows = lists.where(F.size("words") > 0).select(
        "item",
        size.alias("n"),
        F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, size), " "))).alias("window"),
    )
    return windows.groupBy("window", "n").agg(F.collect_set("item").alias("items"))


def normalised(text: bytes) -> tuple[bytes, int]:
    """Lower-cased words between single spaces, and their number."""
    words = text.translate(_JOINED).split()
    return b" " + b" ".join(words) + b" ", len(words)


class Scanner:
    """The automaton over windows. Text is scanned as bytes, one per character."""

    def __init__(self, windows: list[tuple[str, int, list[str]]]):
        self.items = [sorted(items) for _, _, items in windows]
        self.sizes = [n for _, n, _ in windows]
        self.automaton = ahocorasick.Automaton()
        for number, (window, _, _) in enumerate(windows):
            self.automaton.add_word(f" {window} ".encode().decode("latin-1"), number)
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, the word numbers that are hit, the items found."""
        joined, count = normalised(text)
        none = np.zeros(0, np.int64)
        if not self.items or not count:
            return count, none, set()
        found = list(self.automaton.iter(joined.decode("latin-1")))
        if not found:
            return count, none, set()
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        ends = np.searchsorted(spaces, [end for end, _ in found])
        change = np.zeros(count + 1, np.int64)
        np.add.at(change, ends - [self.sizes[w] for _, w in found], 1)
        np.add.at(change, ends, -1)
        items = set().union(*(self.items[w] for w in {w for _, w in found}))
        return count, np.flatnonzero(np.cumsum(change[:-1]) > 0), items


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Code-point ranges of runs of hit words in the original text."""
    if not len(hit):
        return []
    places = [m.span() for m in _SPAN.finditer(text)]
    edges = np.flatnonzero(np.diff(hit) > 1)
    first, last = np.r_[hit[0], hit[edges + 1]], np.r_[hit[edges], hit[-1]]
    return [{"start": places[a][0], "end": places[b][1]} for a, b in zip(first, last)]


# A worker serves many tasks: the automaton of a broadcast is built once in it.
_scanners: dict[int, Scanner] = {}


def _scanner(shared) -> Scanner:
    if shared.id not in _scanners:
        _scanners.clear()
        _scanners[shared.id] = Scanner(shared.value)
    return _scanners[shared.id]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hits", pa.list_(pa.int64())),
    ("items", pa.list_(pa.string())), ("spans", _SPANS),
])


def _scan_once(docs: DataFrame, text_col: str, out: str, windows: list) -> DataFrame:
    """One pass; what an earlier pass found in ``out`` is kept and added to."""
    shared = _Shared(docs.sparkSession, windows)
    before = out in docs.columns
    schema = T.StructType([*(docs.drop(out).schema), T.StructField(out, SCHEMA)])
    names = [field.name for field in schema]
    column = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        for batch in batches:
            earlier = batch.column(len(names) - 1).to_pylist() if before else None
            rows = []
            for i, text in enumerate(batch.column(column).to_pylist()):
                text = text or ""
                count, hit, items = scanner.scan(text.encode())
                if before:
                    hit = np.union1d(hit, np.array(earlier[i]["hits"], np.int64))
                    items = items.union(earlier[i]["items"])
                rows.append({
                    "n_words": count, "n_hit": len(hit), "hits": hit, "items": sorted(items),
                    "spans": original_spans(text, hit),
                })
            kept = batch.columns[: len(names) - 1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, _ARROW)], names)

    return docs.mapInArrow(run, schema)


class _Shared:
    """A broadcast with a number by which workers know it."""

    def __init__(self, spark: SparkSession, value):
        self.handle = spark.sparkContext.broadcast(value)
        self.id = self.handle._jbroadcast.id()

    def __getstate__(self):
        return {"handle": self.handle, "id": self.id}

    @property
    def value(self):
        return self.handle.value


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    out: str = "passages",
    max_windows: int = MAX_WINDOWS,
    max_bytes: int = MAX_WINDOW_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit, hits (word numbers), items,
    spans (code-point ranges of the original text).

    The windows of the benchmark are gathered on the driver, at most
    ``max_windows`` or ``max_bytes`` at a time. A larger benchmark is cut by window
    hash and scanned for in several passes, each adding to what the last one stored.
    """
    docs = docs.drop(out)
    found = item_windows(items, item_id, item_text, window)
    # Twice the slices, so that an uneven cut stays below the bound as well.
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("bytes")).first()
    passes = max(-(-size.n // max_windows), -(-size.bytes // max_bytes))
    slices = 1 if passes <= 1 else 2 * passes
    if slices > 1:
        found = stage(found, "windows")
    part, stored = F.pmod(F.xxhash64("window"), F.lit(slices)), None
    for number in range(slices):
        chosen = [(row.window, row.n, row["items"]) for row in found.where(part == number).collect()]
        docs = _scan_once(docs, text_col, out, chosen)
        if number < slices - 1:
            docs = stage(docs, "scanned")
            if stored is not None:
                drop_stage(stored)
            stored = docs
    return docs


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark passage, in their own columns."""
    out = fresh(docs.columns, "passages")
    marked = find_passages(docs, items, text_col, out=out, **options)
    return marked.where(F.col(f"`{out}`.n_hit") == 0).select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), '{1}', '{2}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _words_sql(column: str) -> str:
    return _WORDS.format(column, UPPER, UPPER.lower())


SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {_words_sql('text')} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words_sql('text')} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT item, w, least(len(w), {WINDOW}) AS n,
               unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0)),
doc_windows AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
found AS (SELECT r, i, d.n, item FROM doc_windows d JOIN item_windows m ON m.n = d.n AND m.win = d.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit
        FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
listed AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS names
           FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit ON hit.r = docs.r LEFT JOIN listed ON listed.r = docs.r
"""


@query("op8_decontaminate", SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "passages.n_words", "passages.n_hit",
        F.size("passages.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("passages.items", ","), 256).alias("items_sha256"),
        (F.col("passages.n_hit") > 0).alias("contaminated"),
    )
