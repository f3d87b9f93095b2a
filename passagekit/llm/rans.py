"""Token ids in binary files, coded by a static range asymmetric numeral system.

One frequency table over the whole corpus is shared by all files. Ids are cut into
independent blocks; a block is coded by interleaved lanes whose states are stored with
it, so any block can be decoded alone. The index at the end of a file holds, for each
block, its place, its number of ids and a checksum, and for each document its number
of ids and a checksum. All blocks of a task are coded side by side with numpy.

File layout, integers little-endian:

    magic | table (zlib) | block ... | index (zlib) | index place, index bytes, crc32 | magic
    block: states of all lanes (uint64) | words (uint32), in the order they are read

Defined results: null and empty text is the end id alone; rows with a null id come
first; rows with equal ids keep an arbitrary but fixed order; no rows give no file.
Damaged blocks and documents raise.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window as W

from passagekit.llm.common import table
from passagekit.llm.files import create, new_name, open_random, task_each
from passagekit.llm.tokens import tokenizer
from passagekit.plans.registry import query
from passagekit.scale import drop_stage, shared_dir, stage

MAGIC = b"RANSIDS1"
END_ID = 0

SCALE_BITS = 18
LANES = 64
STEPS = 256
BLOCK_IDS = LANES * STEPS

#: Blocks coded side by side, and the size at which a file is closed.
BLOCKS_AT_ONCE = 64
FILE_IDS = 64 << 20

#: Bytes of text that are tokenised at once.
GROUP_BYTES = 8 << 20

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


# -- frequency table ------------------------------------------------------------


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts scaled to a sum of ``2 ** bits``; whatever occurs keeps at least 1."""
    counts = counts.astype(np.int64)
    while (1 << bits) < 2 * np.count_nonzero(counts):
        bits += 1
    total, target = int(counts.sum()), 1 << bits
    if not total:
        return counts
    freqs = np.where(counts > 0, np.maximum(1, counts * target // total), 0)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    missing = target - int(freqs.sum())
    if missing > 0:
        freqs[order[0]] += missing
    for i in order:  # more was given to rare ids than was left over
        if missing >= 0:
            break
        taken = min(int(freqs[i]) - 1, -missing)
        freqs[i] -= taken
        missing += taken
    return freqs


@dataclass(frozen=True)
class Table:
    """Frequencies of ids; their sum is a power of two."""

    freqs: np.ndarray

    def __post_init__(self):
        object.__setattr__(self, "bits", int(self.freqs.sum()).bit_length() - 1)
        object.__setattr__(self, "wide", self.freqs.astype(np.uint64))
        object.__setattr__(self, "before", (np.cumsum(self.freqs) - self.freqs).astype(np.uint64))

    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freqs), dtype=np.uint32), self.freqs)

    def to_bytes(self) -> bytes:
        ids = np.flatnonzero(self.freqs)
        return zlib.compress(np.stack([ids, self.freqs[ids]]).astype("<u4").tobytes())

    @staticmethod
    def from_bytes(data: bytes) -> "Table":
        ids, freqs = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1).astype(np.int64)
        out = np.zeros(int(ids.max()) + 1, np.int64)
        out[ids] = freqs
        return Table(out)


# -- blocks -----------------------------------------------------------------------


def encode_blocks(ids: np.ndarray, coder: Table) -> list[bytes]:
    """``ids`` of shape (blocks, steps, lanes), all blocks side by side."""
    blocks, steps, lanes = ids.shape
    states = np.full((blocks, lanes), _LOW, np.uint64)
    words = np.zeros(ids.shape, np.uint32)
    written = np.zeros(ids.shape, bool)
    bits, room = np.uint64(coder.bits), np.uint64(63 - coder.bits)
    for step in range(steps - 1, -1, -1):
        symbol = ids[:, step]
        freq = coder.wide[symbol]
        full = states >= freq << room
        written[:, step] = full
        words[:, step] = states.astype(np.uint32)
        states = np.where(full, states >> _WORD, states)
        whole = states // freq
        states = (whole << bits) + (states - whole * freq) + coder.before[symbol]
    return [states[i].astype("<u8").tobytes() + words[i][written[i]].astype("<u4").tobytes() for i in range(blocks)]


def decode_blocks(data: list[bytes], steps: int, coder: Table, symbols: np.ndarray) -> np.ndarray:
    """The ids of blocks with equal numbers of steps, shape (blocks, steps * lanes)."""
    head = LANES * 8
    states = np.stack([np.frombuffer(d, "<u8", LANES) for d in data]).astype(np.uint64)
    parts = [np.frombuffer(d, "<u4", offset=head) for d in data]
    sizes = np.array([len(p) for p in parts])
    # One spare word: places beyond a block's words are looked at but not used.
    stream = np.concatenate([*parts, np.zeros(1, "<u4")]).astype(np.uint64)
    ends = np.cumsum(sizes)
    place = ends - sizes
    out = np.empty((len(data), steps, LANES), np.uint32)
    bits, mask = np.uint64(coder.bits), np.uint64((1 << coder.bits) - 1)
    for step in range(steps):
        slot = states & mask
        symbol = symbols[slot]
        out[:, step] = symbol
        states = coder.wide[symbol] * (states >> bits) + slot - coder.before[symbol]
        empty = states < _LOW
        at = place[:, None] + np.cumsum(empty, axis=1) - 1
        states[empty] = (states[empty] << _WORD) | stream[at[empty]]
        place = place + empty.sum(axis=1)
    if not np.array_equal(place, ends) or (states != _LOW).any():
        raise ValueError("a block does not end where it should")
    return out.reshape(len(data), -1)


# -- files -------------------------------------------------------------------------


class Writer:
    """Writes the ids of documents, given in their final order, into one file."""

    def __init__(self, uri: str, coder: Table):
        self.out, self.coder = create(uri), coder
        self.place = 0
        self.pending: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.blocks: list[tuple[int, int, int]] = []
        self.sizes: list[np.ndarray] = []
        self.sums: list[int] = []
        shared = coder.to_bytes()
        self._put(MAGIC + struct.pack("<I", len(shared)) + shared)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of several documents one after another, and their numbers."""
        self.sizes.append(sizes)
        raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes) * 4
        self.sums += [zlib.crc32(raw[end - 4 * n:end]) for n, end in zip(sizes.tolist(), ends.tolist())]
        self.pending.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= BLOCKS_AT_ONCE * BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.pending, np.zeros(0, np.uint32)])
        full = len(ids) // BLOCK_IDS
        for start in range(0, full, BLOCKS_AT_ONCE):
            stop = min(full, start + BLOCKS_AT_ONCE)
            part = ids[start * BLOCK_IDS:stop * BLOCK_IDS].reshape(-1, STEPS, LANES)
            self._blocks(encode_blocks(part, self.coder), BLOCK_IDS)
        rest = ids[full * BLOCK_IDS:]
        if last and len(rest):
            # The last block is filled up with an id that the table has.
            filled = np.full(-(-len(rest) // LANES) * LANES, np.flatnonzero(self.coder.freqs)[0], np.uint32)
            filled[:len(rest)] = rest
            self._blocks(encode_blocks(filled.reshape(1, -1, LANES), self.coder), len(rest))
            rest = rest[:0]
        self.pending, self.waiting = [rest], len(rest)

    def _blocks(self, coded: list[bytes], count: int) -> None:
        for data in coded:
            self.blocks.append((len(data), count, zlib.crc32(data)))
            self._put(data)

    def close(self) -> None:
        self._flush(True)
        sizes = np.concatenate([*self.sizes, np.zeros(0, np.int64)])
        index = zlib.compress(
            struct.pack("<QQ", len(self.blocks), len(sizes)) + np.array(self.blocks, "<u8").tobytes()
            + sizes.astype("<u8").tobytes() + np.array(self.sums, "<u4").tobytes()
        )
        tail = struct.pack("<QQI", self.place, len(index), zlib.crc32(index))
        self._put(index + tail + MAGIC)
        self.out.close()


class Reader:
    """Reads a file; ``ids`` gives the ids of any range of blocks."""

    TAIL = 20 + len(MAGIC)

    def __init__(self, uri: str):
        self.file = open_random(uri)
        end = self.file.size()
        head, tail = self.file.read_at(len(MAGIC) + 4, 0), self.file.read_at(self.TAIL, end - self.TAIL)
        if not head.startswith(MAGIC) or not tail.endswith(MAGIC):
            raise ValueError(f"{uri} is no file of ids, or is cut off")
        size = struct.unpack("<I", head[len(MAGIC):])[0]
        self.first = len(head) + size
        self.coder = Table.from_bytes(self.file.read_at(size, len(head)))
        self.symbols = self.coder.symbols()
        place, length, crc = struct.unpack("<QQI", tail[:20])
        packed = self.file.read_at(length, place)
        if zlib.crc32(packed) != crc:
            raise ValueError(f"{uri}: the index is damaged")
        index = zlib.decompress(packed)
        blocks, docs = struct.unpack("<QQ", index[:16])
        table_ = np.frombuffer(index, "<u8", 3 * blocks, 16).reshape(-1, 3).astype(np.int64)
        self.bytes, self.counts, self.crcs = table_[:, 0], table_[:, 1], table_[:, 2]
        self.sizes = np.frombuffer(index, "<u8", docs, 16 + 24 * blocks).astype(np.int64)
        self.sums = np.frombuffer(index, "<u4", docs, 16 + 24 * blocks + 8 * docs)
        self.places = self.first + np.cumsum(self.bytes) - self.bytes

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of blocks ``start`` to ``stop``, each verified by its checksum."""
        data = self.file.read_at(int(self.bytes[start:stop].sum()), int(self.places[start]))
        cuts = np.cumsum(self.bytes[start:stop])
        parts = [data[end - n:end] for n, end in zip(self.bytes[start:stop], cuts)]
        for i, part in enumerate(parts):
            if zlib.crc32(part) != self.crcs[start + i]:
                raise ValueError(f"block {start + i} is damaged")
        out = []
        full = [i for i in range(start, stop) if self.counts[i] == BLOCK_IDS]
        if full:
            out.append(decode_blocks(parts[:len(full)], STEPS, self.coder, self.symbols).ravel())
        for i in range(start + len(full), stop):
            count = int(self.counts[i])
            out.append(decode_blocks([parts[i - start]], -(-count // LANES), self.coder, self.symbols)[0, :count])
        return np.concatenate([*out, np.zeros(0, np.uint32)])

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn, verified."""
        held, at, block = np.zeros(0, np.uint32), 0, 0
        for number, size in enumerate(self.sizes.tolist()):
            while len(held) - at < size:
                stop = min(len(self.bytes), block + BLOCKS_AT_ONCE)
                if stop == block:
                    raise ValueError("the blocks end inside a document")
                held, at, block = np.concatenate([held[at:], self.ids(block, stop)]), 0, stop
            ids = held[at:at + size]
            at += size
            if zlib.crc32(ids.astype("<u4").tobytes()) != self.sums[number]:
                raise ValueError(f"document {number} is damaged")
            yield ids


# -- Spark ---------------------------------------------------------------------------


def _gathered(batches: Iterator[pa.RecordBatch], size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``size`` bytes: fewer look-ups of equal pieces."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def tokenised(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int = END_ID) -> DataFrame:
    """A stored table (seq, id, ids, n) of all documents in ascending order of id.

    ``seq`` numbers the rows in that order, with gaps. ``ids`` are little-endian
    integers of two bytes, or four for a large vocabulary. Texts are tokenised where
    they are read; only ids are sorted, and rows that share an id by a hash of their ids,
    so that many of them are spread too.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        width = "<u2" if max(words.size, end_id + 1) <= 1 << 16 else "<u4"
        step = np.dtype(width).itemsize
        last = np.array([end_id], width).tobytes()
        for batch in _gathered(batches):
            ids, counts = words.encode(batch.column(1))
            ends = np.cumsum(counts)
            raw = memoryview(ids.astype(width).tobytes())
            packed = [bytes(raw[(e - n) * step:e * step]) + last for n, e in zip(counts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary()), pa.array(counts + 1)], ["id", "ids", "n"],
            )

    coded = stage(rows.mapInArrow(run, schema), "token-ids", "zstd")
    hashed = coded.withColumn("hash", F.xxhash64("ids"))
    placed = hashed.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash")
    ordered = stage(placed.select(F.monotonically_increasing_id().alias("seq"), "id", "ids", "n"), "sorted-ids", "zstd")
    drop_stage(coded)
    return ordered


def frequency_table(ids: DataFrame, size: int) -> Table:
    """The shared table over all ids. A task sends one number per id it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts += np.bincount(_ids(data, size), minlength=size)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["id", "n"])

    sums = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    # One row per id of the vocabulary.
    for row in sums.collect():
        out[row.id] = row.n
    return Table(scaled(out))


def _ids(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if size <= 1 << 16 else "<u4")


def write_ids(ids: DataFrame, size: int, label: str = "ids", file_ids: int = FILE_IDS) -> DataFrame:
    """Write a table made by ``tokenised``: a stored list (path, first, docs, n).

    Every run of rows that stand next to each other becomes a file; ordered by
    ``first``, the files hold the documents in ascending order of id.
    """
    folder = shared_dir(ids.sparkSession, label)
    shared = ids.sparkSession.sparkContext.broadcast(frequency_table(ids, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, done = shared.value, None, []
        expected, width = -1, _ids(bytes(4), size).itemsize

        def close() -> None:
            if writer:
                writer.close()
                done[-1][2:] = [sum(len(s) for s in writer.sizes), writer.total]

        for batch in batches:
            seqs = batch.column(0).to_numpy()
            # Rows that do not follow each other belong to different files.
            cuts = np.flatnonzero(np.r_[True, np.diff(seqs) != 1])
            data = batch.column(1).to_pylist()
            for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(seqs)]):
                if writer is None or int(seqs[start]) != expected or writer.total >= file_ids:
                    close()
                    path = new_name(folder, ".ids")
                    writer = Writer(path, coder)
                    done.append([path, int(seqs[start]), 0, 0])
                raw = b"".join(data[start:stop])
                sizes = np.array([len(d) for d in data[start:stop]], np.int64) // width
                writer.add(_ids(raw, size).astype(np.uint32), sizes)
                expected = int(seqs[stop - 1]) + 1
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))],
            ["path", "first", "docs", "n"],
        )

    return stage(ids.select("seq", "ids").mapInArrow(run, "path string, first long, docs long, n long"), f"{label}-list")


def read_ids(files: DataFrame) -> DataFrame:
    """(seq, start, n_tokens, ids_crc32) of every document, read from the files.

    ``start`` counts the ids of all documents before. The window runs over one row
    per file, not over documents.
    """
    before = W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    offsets = files.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, docs, offset in zip(*(batch.column(i).to_pylist() for i in range(4))):
                reader = Reader(path)
                if len(reader.sizes) != docs:
                    raise ValueError(f"{path}: {len(reader.sizes)} documents, {docs} were written")
                crcs, sizes = [], []
                for ids in reader.documents():
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    sizes.append(len(ids))
                sizes = np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(docs) + first), pa.array(offset + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                    ["seq", "start", "n_tokens", "ids_crc32"],
                )

    spread = task_each(offsets.select("path", "first", "docs", "offset"))
    return spread.mapInArrow(run, "seq long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write all documents and read them back: (id, start, n_tokens, ids_crc32)."""
    ids = tokenised(docs, id_col, text_col, path, end_id)
    size = max(tokenizer(path).size, end_id + 1)
    # Spark takes the rows read from files to be as few as the files and would
    # broadcast them; both sides have a row per document.
    found = read_ids(write_ids(ids, size)).hint("merge")
    return found.join(ids.select("seq", F.col("id").alias(id_col)), "seq").select(id_col, "start", "n_tokens", "ids_crc32")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids in the written files."""
    return token_files(table(spark, sf_dir, "documents"), vocabulary())
