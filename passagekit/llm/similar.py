"""Near-duplicates by the similarity of word shingles, without a miss.

The similarity of two texts is the Jaccard similarity of their sets of shingles. Texts
of one set are one node. If all sets are ordered alike, two sets of at least the wanted
similarity share one of their first n - ceil(similarity * n) + 1 shingles, so only sets
that meet in such a prefix are compared, and these exactly. Any order finds the same
pairs; shingles that are common in a sample come last, which keeps the groups short. The
first shingle that two sets share is at places which leave enough shingles behind them in
both; pairs that meet at other places are not compared there.

Pairs that another method offers, such as near fingerprints, are compared first, and
what they connect need not meet again. A group is compared in rounds. In each, a member
meets one centre of its group. The first centre is the member whose prefix has the fewest
shingles before the shared one: of many altered copies that is the one with the fewest
alterations, which most others are similar to. From the second round on only groups that
the links so far leave apart are looked at, and another order chooses their centres. At
last, members that are still apart meet each other at the places where a first shared
shingle can lie, and are compared if their prefixes share enough. Altered copies that are too far from each other have their own, rare
shingles before all shared ones, so they do not meet, however many they are. Copies of one
text are connected by the first round, so a large class is not compared pair by pair.

Prefixes are shuffled once, by shingle, and read in order: what only one set has, which is
nearly everything, goes no further. Shingles of very many sets are not shuffled; their
centres are aggregated and sent to the rows. For comparison a text travels once per pair,
to its centre, and a centre with many members is compared in several tasks.

Defined results: null, empty and blank text has the empty set, which is linked to
nothing but itself; a text with fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from passagekit.llm.components import components
from passagekit.llm.shingles import shingle_hashes
from passagekit.scale import broadcast_if_small, drop_stage, stage

#: Sampled sets, sets of the sample that make a shingle common, and common shingles held.
SAMPLE = 5_000
COMMON_SEEN = 3
MAX_COMMON = 200_000

#: Rounds with centres.
CENTRES = 2

#: Sets, by the sample, from which on a shingle's rows are not shuffled.
HOT_ROWS = 10_000

#: Members that one task compares with a centre at a time.
MEMBERS = 2_000


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def key_of(shingles: np.ndarray) -> int:
    """XXH64 of a set; 0 for the empty one."""
    return xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes()) if len(shingles) else 0


def with_keys(
    docs: DataFrame, text_col: str, out: str, size: int, print_out: str, fingerprint: Callable[[np.ndarray], int]
) -> DataFrame:
    """``docs`` with the key of the text's set and the fingerprint of its shingles, as signed 64-bit integers."""
    source = docs.drop(out, print_out)
    schema = T.StructType([*source.schema, T.StructField(out, T.LongType()), T.StructField(print_out, T.LongType())])
    at = source.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
            for i, text in enumerate(batch.column(at)):
                hashes = shingle_hashes(text.as_py(), size)
                keys[i], prints[i] = key_of(np.unique(hashes)), fingerprint(hashes)
            made = [pa.array(keys.view(np.int64)), pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [f.name for f in schema])

    return source.mapInArrow(run, schema)


def prefix(shingles: np.ndarray, similarity: Fraction, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The first shingles of a set: rare ones before those of the sorted ``common``."""
    n = len(shingles)
    if not n:
        return shingles
    count = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        count = np.where(common[at] == shingles, seen[at], 0)
    need = -(-n * similarity.numerator // similarity.denominator)
    return shingles[np.lexsort((shingles, count))][: n - need + 1]


def _shingle_rows(texts: DataFrame, size: int, cut=None) -> DataFrame:
    """(token, fp, n, place) of the sets of ``texts`` (fp, text), each set once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            tokens, keys, sizes = [], [], []
            for fp, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if fp in done:
                    continue
                done.add(fp)
                whole = shingle_set(text.as_py(), size)
                tokens.append(whole if cut is None else cut(whole))
                keys.append(fp)
                sizes.append(len(whole))
            counts = np.array([len(t) for t in tokens], np.int64)
            ends = np.cumsum(counts)
            places = np.arange(int(counts.sum())) - np.repeat(ends - counts, counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), counts)),
                pa.array(np.repeat(np.array(sizes, np.int32), counts)), pa.array(places.astype(np.int32)),
            ], ["token", "fp", "n", "place"])

    return texts.mapInArrow(run, "token long, fp long, n int, place int")


def common_shingles(texts: DataFrame, size: int, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted shingles that several sets of a sample have, how many have them, and one of how many sets is in the sample."""
    every = max(1, total // SAMPLE)
    part = texts.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0)
    counts = _shingle_rows(part, size).groupBy("token").agg(F.countDistinct("fp").alias("n")).where(F.col("n") >= COMMON_SEEN)
    rows = counts.orderBy(F.desc("n"), "token").limit(MAX_COMMON).collect()
    common, seen = np.array([r.token for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(common)
    return common[order], seen[order], every


def compared(pairs: DataFrame, texts: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """The stored ``pairs`` (m, c) whose sets are as similar as wanted, as (a, b)."""
    needed = pairs.select(F.explode(F.array("m", "c")).alias("fp")).distinct()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            new = []
            for fp in batch.column(0).to_pylist():
                new.append(fp not in done)
                done.add(fp)
            kept = batch.filter(pa.array(new, pa.bool_()))
            texts_ = [pack(t.as_py().encode()) if t.is_valid else None for t in kept.column(1)]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(texts_, pa.binary())], ["fp", "text"])

    def set_of(packed: pa.Scalar) -> np.ndarray:
        return shingle_set(zstandard.decompress(packed.as_py()).decode() if packed.is_valid else None, size)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre, last = None, None, None
        for batch in batches:
            members, centres = [], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for (c, part, member, m), text in zip(keys, batch.column(4)):
                if not member:
                    if (c, part) != key:
                        key, centre, last = (c, part), set_of(text), None
                    continue
                if m == last:
                    continue
                last, one = m, set_of(text)
                both = len(np.intersect1d(one, centre, assume_unique=True))
                if both * similarity.denominator >= similarity.numerator * (len(one) + len(centre) - both):
                    members.append(m)
                    centres.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array(centres, pa.int64())], ["a", "b"])

    met = texts.join(broadcast_if_small(needed), "fp", "left_semi").select("fp", "text")
    held = stage(met.mapInArrow(once, "fp long, text binary"), "pair-texts")
    parts = (F.floor((F.count("*") - 1) / MEMBERS) + 1).cast("int").alias("parts")
    centres = broadcast_if_small(pairs.groupBy("c").agg(parts))
    part = F.pmod(F.xxhash64("m"), "parts").cast("int")
    members = broadcast_if_small(pairs.join(centres, "c").select("c", part.alias("part"), "m"))
    rows = members.join(held.withColumnRenamed("fp", "m"), "m").select("c", "part", F.lit(True).alias("member"), "m", "text")
    heads = centres.select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    heads = heads.join(held.withColumnRenamed("fp", "c"), "c").select("c", "part", F.lit(False).alias("member"), F.col("c").alias("m"), "text")
    order = ["c", "part", "member", "m"]
    dealt = rows.unionByName(heads).repartition("c", "part").sortWithinPartitions(*order)
    found = stage(dealt.mapInArrow(check, "a long, b long"), "similar")
    drop_stage(held)
    return found


_MET = "token long, fp long, n int, place int, c long, c_n int, c_place int"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ordered by token, place and turn: those of tokens that several sets have.

    The first row of a token, that with the lowest place, is its centre. It is held back
    until another set follows.
    """
    first = last = None
    shown = False
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if first is None or row[0] != first[0]:
                first, last, shown = row, row[1], False
                continue
            if row[1] == last:
                continue
            last = row[1]
            if not shown:
                out.append((*first, *first[1:]))
                shown = True
            out.append((*row, *first[1:]))
        columns = list(zip(*out)) if out else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["token", "fp", "n", "place", "c", "c_n", "c_place"]
        )


def shared_prefixes(rows: DataFrame, hot: list[int]) -> DataFrame:
    """The ``rows`` of tokens that several sets have, each with its token's centre, stored.

    ``rows`` go straight into the shuffle and are not stored themselves; they are made a
    second time if there are ``hot`` tokens, those of very many sets.
    """
    turn = F.xxhash64("fp")
    # At most MAX_COMMON tokens.
    listed = F.broadcast(rows.sparkSession.createDataFrame([(t,) for t in hot], "token long"))
    narrow = rows.join(listed, "token", "left_anti") if hot else rows
    met = narrow.repartition("token").sortWithinPartitions("token", "place", turn, "fp").mapInArrow(_meet, _MET)
    if not hot:
        return stage(met, "met")
    wide = stage(rows.join(listed, "token", "left_semi"), "hot-prefixes")
    # At most as many rows as ``hot`` has.
    centre = F.min(F.struct("place", turn.alias("turn"), "fp", "n")).alias("centre")
    centres = wide.groupBy("token").agg(
        centre, F.min("fp").alias("low"), F.max("fp").alias("high")
    ).where(F.col("low") != F.col("high"))
    centres = broadcast_if_small(centres.select(
        "token", F.col("centre.fp").alias("c"), F.col("centre.n").alias("c_n"), F.col("centre.place").alias("c_place")
    ))
    met = stage(met.unionByName(wide.join(centres, "token")), "met")
    drop_stage(wide)
    return met


def similar_links(
    texts: DataFrame, total: int, size: int, similarity: float | str, candidates: DataFrame | None = None
) -> DataFrame:
    """(a, b): links that connect all sets of at least ``similarity``.

    ``texts`` is a stored table (fp, text) with the key of each text's set, repeats
    included; ``total`` is the number of keys. The stored pairs (m, c) of ``candidates``
    are compared first; what they connect is not compared again.
    """
    spark, wanted = texts.sparkSession, Fraction(str(similarity))
    done, links = candidates, None if candidates is None else compared(candidates, texts, size, wanted)
    common, seen, every = common_shingles(texts, size, total)
    shared = spark.sparkContext.broadcast((common, seen))
    rows = _shingle_rows(texts, size, lambda s: prefix(s, wanted, *shared.value))
    met = shared_prefixes(rows, common[seen * every >= HOT_ROWS].view(np.int64).tolist())

    near = met.where((F.col("fp") != F.col("c")) & may_be_similar(wanted, ("n", "place"), ("c_n", "c_place"))).select("fp", "c")
    if links is not None:
        near = not_connected(near, links)
    for turn in range(1, CENTRES + 1):
        # Two sets may be centres of each other.
        pairs = near.select(F.greatest("fp", "c").alias("m"), F.least("fp", "c").alias("c")).distinct()
        pairs = stage(pairs if done is None else pairs.join(done, ["m", "c"], "left_anti"), "pairs")
        found = compared(pairs, texts, size, wanted)
        done, links = (pairs, found) if done is None else (done.unionByName(pairs), links.unionByName(found))
        if turn > 1:
            drop_stage(left)
        left = still_apart(met, links)
        if turn == CENTRES or left.isEmpty():
            break
        order = F.struct(F.xxhash64("fp", F.lit(turn)).alias("turn"), "fp", "n", "place", "root")
        chosen = broadcast_if_small(left.groupBy("token").agg(F.min(order).alias("centre")))
        meeting = left.join(chosen, "token").select(
            "fp", "n", "place", "root", F.col("centre.fp").alias("c"), F.col("centre.n").alias("c_n"),
            F.col("centre.place").alias("c_place"), F.col("centre.root").alias("c_root"),
        )
        near = meeting.where((F.col("root") != F.col("c_root")) & may_be_similar(wanted, ("n", "place"), ("c_n", "c_place")))
    drop_stage(met)
    meeting = stage(crossing(left, wanted).distinct().join(done, ["m", "c"], "left_anti"), "crossing")
    rest = stage(enough_shared(meeting, left, wanted), "pairs")
    for table in (left, meeting):
        drop_stage(table)
    return links.unionByName(compared(rest, texts, size, wanted))


def may_be_similar(wanted: Fraction, a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Whether sets (size, place of a shared token) can be similar, if it is their first shared token."""
    (n, at), (o, to) = a, b
    sizes = F.greatest(n, o) * wanted.numerator <= F.least(n, o) * wanted.denominator
    left = F.least(F.col(n) - F.col(at), F.col(o) - F.col(to))
    return sizes & (left * (wanted.numerator + wanted.denominator) >= (F.col(n) + F.col(o)) * wanted.numerator)


def crossing(left: DataFrame, wanted: Fraction) -> DataFrame:
    """(m, c), repeats included: sets of different roots that share a token where it can be their first.

    Similar sets do meet: their first shared token has enough shingles behind it in both.
    In the smaller set it lies in the first part of the prefix, so only these rows are
    one side of the join.
    """
    one, two = (left.select("token", *[F.col(n).alias(f"{n}_{side}") for n in ("fp", "n", "place", "root")]) for side in "ab")
    early = two.where(
        F.col("place_b") * (wanted.numerator + wanted.denominator) <= F.col("n_b") * (wanted.denominator - wanted.numerator)
    )
    larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("fp_a") > F.col("fp_b")))
    met = one.join(early, "token").where(
        larger & (F.col("root_a") != F.col("root_b")) & may_be_similar(wanted, ("n_a", "place_a"), ("n_b", "place_b"))
    )
    return met.select(F.greatest("fp_a", "fp_b").alias("m"), F.least("fp_a", "fp_b").alias("c"))


def enough_shared(pairs: DataFrame, left: DataFrame, wanted: Fraction) -> DataFrame:
    """The stored ``pairs`` (m, c) whose prefixes share as many tokens as those of similar sets.

    ``left`` holds all tokens that two such prefixes share; other shared tokens are outside
    the prefix that ends first. Sixteen bits of a token are compared, repeats counted, so
    never too few are found, and a pair takes little room.
    """
    needed = pairs.select(F.explode(F.array("m", "c")).alias("fp")).distinct()
    digest = (F.col("token").bitwiseAND(0xFFFF) - (1 << 15)).cast("short")
    digests = left.join(broadcast_if_small(needed), "fp", "left_semi").groupBy("fp").agg(
        F.first("n").alias("n"), F.collect_list(digest).alias("digests")
    )
    digests = stage(digests, "prefix-digests")

    def counted(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Row and digest as one number, each once, and how often it is there."""
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        return np.unique(rows << 16 | (lists.flatten().to_numpy().astype(np.int64) + (1 << 15)), return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (one, ones), (two, twos) = counted(batch.column(3)), counted(batch.column(5))
            both, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
            shared = np.bincount(both >> 16, np.minimum(ones[i], twos[j]), len(batch)).astype(np.int64)
            n, o = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 4))
            outside = -(-np.maximum(n, o) * wanted.numerator // wanted.denominator) - 1
            enough = (shared + outside) * (wanted.numerator + wanted.denominator) >= (n + o) * wanted.numerator
            yield batch.select([0, 1]).filter(pa.array(enough))

    for name in ("m", "c"):
        pairs = pairs.join(digests.toDF(name, f"n_{name}", f"digests_{name}"), name)
    return pairs.select("m", "c", "n_m", "digests_m", "n_c", "digests_c").mapInArrow(run, "m long, c long")


def not_connected(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (fp, c) that ``links`` leave in different components."""
    roots = broadcast_if_small(components(links))
    for name in ("fp", "c"):
        pairs = pairs.join(roots.toDF(name, f"{name}_root"), name, "left")
    apart = F.coalesce("fp_root", "fp") != F.coalesce("c_root", "c")
    return pairs.where(apart).select("fp", "c")


def still_apart(met: DataFrame, links: DataFrame) -> DataFrame:
    """(token, fp, n, place, root): stored rows of tokens whose sets are not all connected."""
    roots = components(links).select(F.col("node").alias("fp"), "root")
    placed = met.select("token", "fp", "n", "place").join(broadcast_if_small(roots), "fp", "left")
    placed = placed.withColumn("root", F.coalesce("root", "fp"))
    apart = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    apart = broadcast_if_small(apart.where(F.col("low") != F.col("high")).select("token"))
    return stage(placed.join(apart, "token", "left_semi"), "apart")
