"""Lines that many documents share, found through two Bloom filters.

Line keys are hashed once. The hashes are dealt by segment; each segment keeps one
filter of hashes seen once and one of hashes seen twice. A line whose hash the second
filter lacks occurs in one document at most and goes no further; only suspected
repeats are shuffled, as digests, to be counted exactly and to find their first
occurrence.

Defined results: null and empty text are one empty line; a key shorter than
``min_chars`` is never dropped; every input row is a document of its own, also when
ids repeat; rows with a null id come first when the first occurrence is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from passagekit.llm.common import UPPER, fresh, table, text_of
from passagekit.plans.registry import query
from passagekit.scale import fits, stage

MIN_CHARS = 1
MIN_DOCS = 10

#: One segment of a filter: 128 KiB, filled with about 8 bits per line key.
SEGMENT_BITS = 1 << 20
BITS_PER_KEY = 8
PROBES = 4

#: Largest filter sent to all workers, in bytes. Beyond it every line counts as
#: suspected: the result stays the same, and 16 bytes per line are shuffled.
MAX_FILTER_BYTES = 64 << 20

#: Most dropped keys sent to all workers. More are joined by a shuffle.
MAX_SENT_KEYS = 1_000_000

_BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys: stripped, A-Z in lower case."""
    lines = (text or "").encode().split(b"\n")
    return lines, [line.strip(_BLANK).lower() for line in lines]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def _hashes(text: str | None, min_chars: int) -> dict[bytes, int]:
    return {k: xxhash.xxh3_64_intdigest(k) for k in set(line_keys(text)[1]) if _long_enough(k, min_chars)}


def _probes(hashes: np.ndarray) -> np.ndarray:
    """Bit numbers of each hash within its segment, shape (n, PROBES)."""
    step = (hashes >> np.uint64(20)) | np.uint64(1)
    turn = np.arange(PROBES, dtype=np.uint64)
    return (hashes[:, None] + step[:, None] * turn) % np.uint64(SEGMENT_BITS)


def _segments(hashes: np.ndarray, count: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)


def _test(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _set(bits: np.ndarray, places: np.ndarray) -> None:
    flat = places.ravel()
    np.bitwise_or.at(bits, flat >> np.uint64(3), np.uint8(1) << (flat & np.uint64(7)).astype(np.uint8))


def _hash_lists(texts: DataFrame, segments: int, min_chars: int) -> DataFrame:
    """(segment, once, twice): hashes found once, or more often, in one batch.

    However many documents share a line, a batch sends its hash only once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for text in batch.column(0).to_pylist() for h in _hashes(text, min_chars).values()]
            values, counts = np.unique(np.array(found, np.uint64), return_counts=True)
            places = _segments(values, segments)
            edges = np.searchsorted(places, np.arange(segments + 1, dtype=np.uint64))
            rows = {"segment": [], "once": [], "twice": []}
            for number in np.flatnonzero(np.diff(edges)):
                part = slice(edges[number], edges[number + 1])
                several = counts[part] > 1
                rows["segment"].append(int(number))
                rows["once"].append(values[part][~several].tobytes())
                rows["twice"].append(values[part][several].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["segment"], pa.int32()), pa.array(rows["once"], pa.binary()), pa.array(rows["twice"], pa.binary())],
                ["segment", "once", "twice"],
            )

    return texts.mapInArrow(run, "segment int, once binary, twice binary")


def _build_filter(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two filters of one segment; what is returned is the second."""
    once, twice = np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)
    for batch in batches:
        for single, several in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist()):
            places = _probes(np.frombuffer(several, np.uint64))
            _set(once, places)
            _set(twice, places)
            places = _probes(np.frombuffer(single, np.uint64))
            _set(twice, places[_test(once, places)])
            _set(once, places)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([twice.tobytes()])], ["segment", "bits"])


def twice_filter(texts: DataFrame, text_col: str, min_chars: int = MIN_CHARS, max_bytes: int = MAX_FILTER_BYTES):
    """``{segment: bits}`` of keys seen twice and the number of segments.

    None instead of the bits when they would exceed ``max_bytes``.
    """
    text = text_of(text_col)
    lines = texts.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    segments = max(1, -(-lines * BITS_PER_KEY // SEGMENT_BITS))
    if segments * (SEGMENT_BITS // 8) > max_bytes:
        return None, segments
    lists = _hash_lists(texts.select(text_col), segments, min_chars)
    built = lists.groupBy("segment").applyInArrow(_build_filter, "segment int, bits binary")
    # At most ``max_bytes`` in all, by the check above.
    return {row.segment: bytes(row.bits) for row in built.collect()}, segments


def _suspected(hashes: list[int], bits: dict[int, np.ndarray] | None, segments: int) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), bool)
    values = np.array(hashes, np.uint64)
    places, numbers = _probes(values), _segments(values, segments)
    out = np.zeros(len(values), bool)
    for number in np.unique(numbers):
        at = numbers == number
        if int(number) in bits:
            out[at] = _test(bits[int(number)], places[at])
    return out


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def repeated_lines(
    docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
    max_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """(digest, n_docs, first): keys found in at least ``min_docs`` documents.

    ``first`` is the smallest (document id, line number). A key is told apart by its
    128-bit digest.
    """
    found, segments = twice_filter(docs, text_col, min_chars, max_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("id", kind), T.StructField("line", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value and {k: np.frombuffer(v, np.uint8) for k, v in shared.value.items()}
        for batch in batches:
            seen: dict[bytes, list] = {}
            for i, (owner, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                keys = line_keys(text)[1]
                own: dict[bytes, int] = {}
                for number, key in enumerate(keys):
                    if key not in own and _long_enough(key, min_chars):
                        own[key] = number
                if not own:
                    continue
                hashes = [xxhash.xxh3_64_intdigest(k) for k in own]
                for (key, number), yes in zip(own.items(), _suspected(hashes, bits, segments)):
                    if yes:
                        entry = seen.setdefault(_digest(key), [0, owner, number])
                        entry[0] += 1
                        if (owner is not None, owner, number) < (entry[1] is not None, entry[1], entry[2]):
                            entry[1:] = owner, number
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(seen), pa.binary()), pa.array([e[0] for e in seen.values()], pa.int64()),
                    pa.array([e[1] for e in seen.values()], batch.schema.field(0).type),
                    pa.array([e[2] for e in seen.values()], pa.int64()),
                ],
                ["digest", "n", "id", "line"],
            )

    counted = docs.select(id_col, text_col).mapInArrow(run, schema)
    return (
        counted.groupBy("digest")
        .agg(F.sum("n").alias("n_docs"), F.min(F.struct("id", "line")).alias("first"))
        .where(F.col("n_docs") >= min_docs)
    )


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    keep: str = "none",
    out: str = "lines",
    max_bytes: int = MAX_FILTER_BYTES,
    max_keys: int = MAX_SENT_KEYS,
) -> DataFrame:
    """``docs`` with a struct ``out``: n_lines, n_dropped, kept (the rest, joined).

    ``keep="first"`` leaves the first occurrence of a repeated line in place. Few
    repeated keys are sent to all workers; many reach their documents by a shuffle.
    """
    repeated = stage(repeated_lines(docs, id_col, text_col, min_docs, min_chars, max_bytes), "repeated-lines")
    first = keep == "first"
    if fits(repeated, max_keys):
        sent = docs.sparkSession.sparkContext.broadcast(
            {bytes(r.digest): (r["first"]["id"], r["first"]["line"]) if first else None for r in repeated.collect()}
        )
        return _rewrite(docs, id_col, text_col, out, min_chars, sent.value and sent, None)
    keyed, listed = fresh(docs.columns, "_row_key"), fresh(docs.columns, "_dropped")
    row_key = F.xxhash64(F.col(id_col).isNull(), id_col), F.sha2(text_of(text_col), 256)
    marked = docs.withColumn(keyed, F.struct(*row_key))
    lines = _line_digests(marked.select(keyed, text_col), min_chars).join(repeated, "digest")
    # A document holds so many distinct keys as it has lines: bounded by its text.
    dropped = lines.groupBy("key").agg(F.collect_set(F.struct("digest", "first")).alias(listed))
    joined = marked.join(dropped.withColumnRenamed("key", keyed), keyed, "left").drop(keyed)
    return _rewrite(joined, id_col, text_col, out, min_chars, None, listed, first)


def _line_digests(marked: DataFrame, min_chars: int) -> DataFrame:
    schema = T.StructType([T.StructField("key", marked.schema[0].dataType), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {_digest(k) for k in line_keys(text)[1] if _long_enough(k, min_chars)}
                rows += [i] * len(own)
                digests += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(digests, pa.binary())], ["key", "digest"]
            )

    return marked.mapInArrow(run, schema)


def _rewrite(docs, id_col, text_col, out, min_chars, sent, listed, first=False) -> DataFrame:
    kind = T.StructType([
        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType()),
    ])
    kept_columns = [c for c in docs.columns if c not in (out, listed)]
    source = docs.select(*kept_columns, *([listed] if listed else []))
    schema = T.StructType([*source.select(*kept_columns).schema, T.StructField(out, kind)])
    id_at, text_at = kept_columns.index(id_col), kept_columns.index(text_col)
    arrow = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = sent.value if sent else {}
        for batch in batches:
            own = batch.column(len(kept_columns)).to_pylist() if listed else None
            rows = []
            for i, (owner, text) in enumerate(zip(batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist())):
                gone = everywhere
                if listed:
                    pairs = own[i] or []
                    gone = {p["digest"]: (p["first"]["id"], p["first"]["line"]) if first else None for p in pairs}
                lines, keys = line_keys(text)
                if gone:
                    verdict = {k: gone[d] if (d := _digest(k)) in gone else False for k in set(keys) if _long_enough(k, min_chars)}
                    kept = [
                        line for number, (line, key) in enumerate(zip(lines, keys))
                        if (where := verdict.get(key, False)) is False or where == (owner, number)
                    ]
                else:
                    kept = lines
                rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
            made = pa.array([dict(zip(("n_lines", "n_dropped", "kept"), r)) for r in rows], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept_columns)], made], [f.name for f in schema])

    return source.mapInArrow(run, schema)


SQL = f"""
WITH numbered AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM numbered),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key
  FROM lines),
gone AS (SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS}),
kept AS (
  SELECT r, count(*) AS n_lines, count(g.key) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '') AS text
  FROM keyed k LEFT JOIN gone g ON g.key = k.key GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM numbered JOIN kept USING (r)
"""


@query("op6_line_dedup", SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept", 256).alias("kept_sha256")
    )
