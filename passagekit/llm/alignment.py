"""Alignment of two tokenizers over a corpus, with pairs counted outside of memory.

Byte offsets at which tokens of both sides end cut a text into groups; tokens that end
together are linked. How often a pair of ids is linked in the whole corpus tells which
counterpart an id has most often.

1. A task aligns its documents and collects records (pair, document, times). When enough
   are held it sorts them by radix partition, second id, first id and document, and writes
   a run: per partition a zstd stream of (pair, total, documents), then one of
   (document, times). The pairs of a run are added up before anything is merged, so a pair
   that every document has is one row per run.
2. Runs are merged per partition by a heap, ``FAN_IN`` at a time, in rounds. The order is
   by the second id first, so when one of its blocks is merged, its highest count is
   known, and the block is written with all counts and a mark on the highest.
3. Counts stream back: each run is read again beside the merged partitions and gives every
   document its number of best links and its sum of counts.

Spark deals out documents, merges and runs. Only lists of files and one row per document
are shuffled; a task holds one run or a block of one id at a time.

Defined results: null and empty text has no tokens, and neither has a text whose tokens,
joined, do not give a space and the text; such rows have zeros and an empty digest. Each
input row gives one result row, repeated and null ids too. An empty table has no rows.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from passagekit.llm.common import table
from passagekit.llm.files import create, new_name, open_random, task_each
from passagekit.llm.pairs import SIDE_BITS, Aligner, aligner, gather
from passagekit.plans.registry import query
from passagekit.scale import shared_dir, stage

#: Partitions by the second id, records of a run, runs merged at once.
RADIX = 16
RUN_RECORDS = 2_000_000
FAN_IN = 32

#: Characters aligned at once; longer texts are taken in parts.
SLICE_CHARS = 4 << 20

#: Packed bytes of a stream read at once.
READ_BYTES = 1 << 16

_PAIR_BITS = 2 * SIDE_BITS
_CUT = re.compile(r"(?<=\S)(?= )")


# -- files ----------------------------------------------------------------------


class RunFile:
    """A file of zstd streams; each has its own checksum."""

    def __init__(self, folder: str):
        self.path, self.place = new_name(folder, ".zst"), 0
        self.out = create(self.path)

    def stream(self, frames: Iterator[np.ndarray]) -> int:
        """Write arrays as one stream; returns its place."""
        begin = self.place
        packer = zstandard.ZstdCompressor(level=3, write_checksum=True).compressobj()
        for frame in frames:
            self._put(packer.compress(np.ascontiguousarray(frame).tobytes()))
        self._put(packer.flush())
        return begin

    def _put(self, data: bytes) -> None:
        self.place += self.out.write(data) if data else 0

    def close(self) -> None:
        self.out.close()


def read_stream(path: str, place: int, width: int) -> Iterator[np.ndarray]:
    """The rows (``width`` integers of 64 bits) of one stream, piece by piece."""
    file, size, held = open_random(path), 8 * width, b""
    file.seek(place)
    stream = zstandard.ZstdDecompressor().decompressobj()
    while not stream.eof:
        data = file.read(READ_BYTES)
        if not data:
            raise ValueError(f"{path} is cut off")
        held += stream.decompress(data)
        whole = len(held) - len(held) % size
        if whole:
            yield np.frombuffer(held[:whole], "<i8").reshape(-1, width)
            held = held[whole:]
    file.close()
    if held:
        raise ValueError(f"{path}: a row is cut off")


def side_blocks(frames: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Rows whose pairs have one second id, block after block."""
    held: list[np.ndarray] = []
    for frame in frames:
        sides = frame[:, 0] >> SIDE_BITS
        cuts = np.flatnonzero(np.r_[True, sides[1:] != sides[:-1]])
        for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(frame)]):
            if held and held[0][0, 0] >> SIDE_BITS != sides[start]:
                yield np.concatenate(held)
                held = []
            held.append(frame[start:stop])
    if held:
        yield np.concatenate(held)


def merged(runs: list[Iterator[np.ndarray]]) -> Iterator[np.ndarray]:
    """(pair, count, best) of several sorted runs, one block of a second id at a time."""
    heap: list[tuple[int, int, np.ndarray]] = []
    blocks = [side_blocks(run) for run in runs]

    def push(i: int) -> None:
        block = next(blocks[i], None)
        if block is not None:
            heapq.heappush(heap, (int(block[0, 0]) >> SIDE_BITS, i, block))

    for i in range(len(blocks)):
        push(i)
    while heap:
        side, parts = heap[0][0], []
        while heap and heap[0][0] == side:
            _, i, block = heapq.heappop(heap)
            parts.append(block)
            push(i)
        rows = np.concatenate(parts)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        counts = np.add.reduceat(rows[:, 1], first)
        yield np.stack([rows[first, 0], counts, (counts == counts.max()).astype(np.int64)], 1)


# -- documents to runs ----------------------------------------------------------------


class Collector:
    """Records of a task; writes a run whenever enough are held."""

    def __init__(self, folder: str, records: int):
        self.folder, self.records = folder, records
        self.held: list[np.ndarray] = []
        self.waiting = 0

    def add(self, pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> list[dict]:
        self.held.append(np.stack([pairs, docs, times]))
        self.waiting += len(pairs)
        return self.flush() if self.waiting >= self.records else []

    def flush(self) -> list[dict]:
        """The list of the partitions of a new run."""
        if not self.waiting:
            return []
        pairs, docs, times = np.concatenate(self.held, 1)
        self.held, self.waiting = [], 0
        radix = (pairs >> SIDE_BITS) % RADIX
        order = np.argsort(radix << _PAIR_BITS | pairs, kind="stable")
        pairs, docs, times, radix = pairs[order], docs[order], times[order], radix[order]
        file, made = RunFile(self.folder), []
        edges = np.searchsorted(radix, np.arange(RADIX + 1))
        for part, (start, stop) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            if start == stop:
                continue
            mine = pairs[start:stop]
            first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            rows = np.stack([mine[first], np.add.reduceat(times[start:stop], first), np.diff(np.r_[first, len(mine)])], 1)
            made.append({
                "radix": part, "path": file.path, "place": file.stream(iter([rows])),
                "docs": file.stream(iter([np.stack([docs[start:stop], times[start:stop]], 1)])),
                "low": int(docs.min()), "high": int(docs.max()),
            })
        file.close()
        return made


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE_CHARS`` characters; a longer text stands alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        length = len(text or "")
        if i > start and size + length > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += length
    if start < len(texts):
        yield start, len(texts)


def _parts(text: str, size: int) -> Iterator[str]:
    """A text cut before spaces where chunks begin, after ``size`` characters or more."""
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + size)
        stop = cut.start() if cut else len(text)
        yield text[start:stop]
        start = stop


class Aligned:
    """Texts, aligned: counts (n, 4), written groups, and records (docs, pairs, times)."""

    def __init__(self, model: Aligner, texts: list[str | None], size: int = SLICE_CHARS):
        spaced = [" " + t if t else "" for t in texts]
        if len(texts) == 1 and len(spaced[0]) > size:
            self._long(model, list(_parts(spaced[0], size)))
        else:
            self._short(model, spaced)

    def _short(self, model: Aligner, texts: list[str]) -> None:
        slots, counts = model.texts(texts)
        ends = np.cumsum(counts)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(model.sizes[slots], 0)])
        self.counts = sums[ends] - sums[ends - counts]
        written, names = model.written, slots.tolist()
        self.groups = [
            ";".join([written[i] for i in names[end - n:end]]) for n, end in zip(counts.tolist(), ends.tolist())
        ]
        links = model.sizes[slots, 3]
        pairs = gather(model.pairs, model.starts[slots], links)
        docs = np.repeat(np.repeat(np.arange(len(texts)), counts), links)
        keys, self.times = np.unique(docs << _PAIR_BITS | pairs, return_counts=True)
        self.docs, self.pairs = keys >> _PAIR_BITS, keys & ((1 << _PAIR_BITS) - 1)

    def _long(self, model: Aligner, parts: list[str]) -> None:
        """One text in parts; if one of them is altered, the text has no tokens."""
        counts, groups, pairs, times = np.zeros((1, 4), np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in parts:
            self._short(model, [part])
            if not self.counts.any():
                return
            counts, groups = counts + self.counts, [*groups, self.groups[0]]
            pairs, at = np.unique(np.concatenate([pairs, self.pairs]), return_inverse=True)
            added = np.zeros(len(pairs), np.int64)
            np.add.at(added, at, np.concatenate([times, self.times]))
            times = added
        self.counts, self.groups, self.pairs, self.times = counts, [";".join(groups)], pairs, times
        self.docs = np.zeros(len(pairs), np.int64)


_RUN = "radix int, path string, place long, docs long, low long, high long"


def _encoded(docs: DataFrame, id_col: str, text_col: str, models: tuple[str, str], records: int) -> DataFrame:
    """A stored table with a row per document and, with a path, per partition of a run."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    folder = shared_dir(docs.sparkSession, "pair-runs")
    schema = T.StructType([
        T.StructField("task", T.LongType()), T.StructField("at", T.LongType()), rows.schema["id"],
        *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")),
        T.StructField("groups_sha256", T.StringType()), *T._parse_datatype_string(_RUN).fields,
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, model = None, aligner(*models)
        task, seen = uuid.uuid4().int >> 65, 0
        collector = Collector(folder, records)

        def listed(made: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"task": task, **row} for row in made], arrow)

        for batch in batches:
            if arrow is None:
                kinds = {"groups_sha256": pa.string(), "path": pa.string(), "radix": pa.int32(), "id": batch.schema.field("id").type}
                arrow = pa.schema([(name, kinds.get(name, pa.int64())) for name in schema.names])
            texts = batch.column("text").to_pylist()
            for start, stop in _slices(texts):
                found = Aligned(model, texts[start:stop])
                digests = [sha256(g.encode()).hexdigest() if g else "" for g in found.groups]
                columns = {
                    "task": np.full(stop - start, task), "at": seen + np.arange(stop - start), "id": batch.column("id").slice(start, stop - start),
                    **dict(zip(("n_a", "n_b", "n_groups", "n_links"), found.counts.T)), "groups_sha256": digests,
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(stop - start, f.type) for f in arrow], schema=arrow
                )
                made = collector.add(found.pairs, found.docs + seen, found.times)
                seen += stop - start
                if made:
                    yield listed(made)
        made = collector.flush()
        if made:
            yield listed(made)

    return stage(rows.mapInArrow(run, schema), "aligned")


# -- merging and handing back -------------------------------------------------------------


def _grouped(listed: DataFrame, keys: list[str], order: list[str], groups: int) -> DataFrame:
    """Rows of one key together. The rows are small but stand for files: a task per key."""
    return listed.repartition(max(1, min(groups, 20_000)), *keys).sortWithinPartitions(*keys, *order)


def _runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Consecutive rows of a list of files that share their keys."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            found = tuple(row[k] for k in keys)
            if held and found != key:
                yield held
                held = []
            key = found
            held.append(row)
    if held:
        yield held


def merge_runs(listed: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One merged stream per partition: a stored list (radix, path, place)."""
    folder = shared_dir(listed.sparkSession, "pair-counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, out = None, []
        for rows in _runs_of(batches, ["radix", "grp"]):
            file = file or RunFile(folder)
            place = file.stream(merged([read_stream(r["path"], r["place"], 3) for r in rows]))
            out.append({"radix": rows[0]["radix"], "path": file.path, "place": place})
        if file:
            file.close()
            yield pa.RecordBatch.from_pylist(out, pa.schema([("radix", pa.int32()), ("path", pa.string()), ("place", pa.int64())]))

    while True:
        most = listed.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
        groups = 1 if most <= fan_in else -(-2 * most // fan_in)
        keyed = listed.select("radix", "path", "place", F.pmod(F.xxhash64("path"), F.lit(groups)).cast("int").alias("grp"))
        listed = stage(_grouped(keyed, ["radix", "grp"], ["path"], RADIX * groups).mapInArrow(run, "radix int, path string, place long"), "merged-list")
        if groups == 1:
            return listed


def _handed_back(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(task, at, n_best, count_sum): what each run adds to its documents."""
    # One row per partition.
    where = {row.radix: (row.path, row.place) for row in counts.collect()}

    def totals(pairs: np.ndarray, path: str, place: int) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(pairs), 2), np.int64)
        for frame in read_stream(path, place, 3):
            low, high = np.searchsorted(pairs, frame[0, 0]), np.searchsorted(pairs, frame[-1, 0], "right")
            out[low:high] = frame[np.searchsorted(frame[:, 0], pairs[low:high]), 1:]
        return out[:, 0], out[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs_of(batches, ["path"]):
            low, size = rows[0]["low"], rows[0]["high"] - rows[0]["low"] + 1
            best, sums = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for row in rows:
                mine = np.concatenate(list(read_stream(row["path"], row["place"], 3)))
                count, highest = totals(mine[:, 0], *where[row["radix"]])
                begun = 0
                each_count, each_best = np.repeat(count, mine[:, 2]), np.repeat(highest, mine[:, 2])
                for frame in read_stream(row["path"], row["docs"], 2):
                    part = slice(begun, begun + len(frame))
                    np.add.at(sums, frame[:, 0] - low, frame[:, 1] * each_count[part])
                    np.add.at(best, frame[:, 0] - low, frame[:, 1] * each_best[part])
                    begun += len(frame)
            columns = [np.full(size, rows[0]["task"]), low + np.arange(size), best, sums]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["task", "at", "n_best", "count_sum"])

    spread = _grouped(runs, ["path"], ["radix"], runs.select("path").distinct().count())
    return spread.mapInArrow(run, "task long, at long, n_best long, count_sum long")


def align(
    docs: DataFrame, left: str, right: str, id_col: str = "doc_id", text_col: str = "text", records: int = RUN_RECORDS,
    fan_in: int = FAN_IN,
) -> tuple[DataFrame, DataFrame]:
    """Results per document, and the list of merged counts (for ``pair_counts``).

    ``left`` is the path of a byte-level vocabulary, ``right`` that of a piece model.
    """
    encoded = _encoded(docs, id_col, text_col, (left, right), records)
    runs = encoded.where(F.col("path").isNotNull()).select("task", "radix", "path", "place", "docs", "low", "high")
    counts = merge_runs(runs, fan_in)
    added = _handed_back(runs, counts).groupBy("task", "at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = encoded.where(F.col("path").isNull())
    # Both sides have a row per document.
    both = found.join(added.hint("merge"), ["task", "at"], "left")
    none = F.lit(0).cast("long")
    return both.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256",
    ), counts


def pair_counts(counts: DataFrame) -> DataFrame:
    """(left_id, right_id, count, best): every linked pair of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for frame in read_stream(row["path"], row["place"], 3):
                    columns = [frame[:, 0] & ((1 << SIDE_BITS) - 1), frame[:, 0] >> SIDE_BITS, frame[:, 1], frame[:, 2] > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["left_id", "right_id", "count", "best"])

    return task_each(counts).mapInArrow(run, "left_id long, right_id long, count long, best boolean")


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of a byte-level and a piece vocabulary for every document."""
    import public_tokenizers

    left, right = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align(table(spark, sf_dir, "documents"), left, right)[0]
