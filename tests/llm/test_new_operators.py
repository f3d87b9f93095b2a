"""Alignment, manifest and shards: brute force, skew, edges."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from __spark_entry__ import queries
from passagekit.llm import alignment, merkle
from passagekit.llm.pairs import SIDE_BITS, Aligner, byte_level, gather, pieces
from passagekit.llm.sharding import interleaved, write_shards

LEFT, RIGHT = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    """Ids and bytes of both sides, straight from the libraries."""
    left = Tokenizer.from_file(LEFT)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}

    def tokens(text):
        a = left.encode(" " + text, add_special_tokens=False).ids
        b = right.encode(text)
        name = lambda i: left.id_to_token(i)
        a = [(i, bytes(code[c] for c in name(i)) if name(i) != "<|endoftext|>" else name(i).encode()) for i in a]
        b = [
            (i, bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode())
            for i in b
        ]
        return a, b

    return tokens


def brute(plain, text):
    """(n_a, n_b, groups, written groups, links) of a text, or None."""
    if not text:
        return None
    a, b = plain(text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    a_at, b_at = (np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b))
    cuts, written, links = sorted(set(a_at) & set(b_at)), [], []
    i = j = 0
    for cut in cuts:
        left, right = [], []
        while i < len(a) and a_at[i] <= cut:
            left.append(a[i][0])
            i += 1
        while j < len(b) and b_at[j] <= cut:
            right.append(b[j][0])
            j += 1
        written.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
        links += [(left[-1], right[-1])]
    return len(a), len(b), len(cuts), ";".join(written), links


def expected(plain, rows):
    found = [(doc, brute(plain, text)) for doc, text in rows]
    counts = Counter(link for _, x in found if x for link in x[4])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = Counter()
    for doc, x in found:
        if x is None:
            out[doc, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        n_best = sum(counts[link] == best[link[1]] for link in x[4])
        out[(doc, *x[:3], len(x[4]), n_best, sum(counts[link] for link in x[4]), hashlib.sha256(x[3].encode()).hexdigest())] += 1
    return out, counts, best


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("kind", ["sf_dir", "dirty_dir"])
def test_alignment(kind, spark, plain, request):
    folder = request.getfixturevalue(kind)
    rows = queries()["op11_alignment"](spark, folder).select(*COLUMNS).collect()
    assert Counter(map(tuple, rows)) == expected(plain, documents(spark, folder))[0]


def test_alignment_in_many_small_runs(spark, plain, sf_dir):
    # Runs of 500 records, three merged at a time: several rounds, documents in several runs.
    docs = spark.createDataFrame(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect())
    found, listed = alignment.align(docs, LEFT, RIGHT, records=500, fan_in=3)
    wanted, counts, best = expected(plain, [(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(tuple(r) for r in found.select(*COLUMNS).collect()) == wanted
    table = {(r.left_id, r.right_id): (r["count"], r.best) for r in alignment.pair_counts(listed).collect()}
    assert table == {link: (n, best[link[1]] == n) for link, n in counts.items()}


def test_long_text_in_parts(plain):
    text = "some words,  and\n more of it " * 40 + "x" * 300 + " end "
    model = Aligner(byte_level(LEFT), pieces(RIGHT))
    found, want = alignment.Aligned(model, [text], 50), brute(plain, text)
    assert (*found.counts[0].tolist(), found.groups[0]) == (*want[:3], len(want[4]), want[3])
    links = Counter({(int(p) & (1 << SIDE_BITS) - 1, int(p) >> SIDE_BITS): int(n) for p, n in zip(found.pairs, found.times)})
    assert links == Counter(want[4])
    assert not alignment.Aligned(model, [text + "▁" + text], 50).counts.any()


ALPHABET = st.lists(st.sampled_from(list("ab '\n\t\r\x0b\x1c\x85\xa0  　​1½é.,!x\x00") + [
    "'s", "  ", " \n", "▁", "<|endoftext|>", "<0x41>", "的", "\U0001f600", "é", "﻿",
]), max_size=25).map("".join)


@pytest.fixture(scope="module")
def small_cache():
    return Aligner(byte_level(LEFT), pieces(RIGHT), remembered=40, chars=400)


@given(texts=st.lists(ALPHABET, max_size=6))
@settings(max_examples=300, deadline=None)
def test_chunks_equal_whole_texts(texts, small_cache, plain):
    slots, counts = small_cache.texts([" " + t if t else "" for t in texts])
    ends = np.cumsum(counts)
    for text, n, end in zip(texts, counts.tolist(), ends.tolist()):
        want, mine = brute(plain, text), slots[end - n:end]
        assert (want is None) == (n == 0)
        if want:
            links = gather(small_cache.pairs, small_cache.starts[mine], small_cache.sizes[mine, 3])
            assert tuple(small_cache.sizes[mine].sum(0).tolist()) == (*want[:3], len(want[4]))
            assert ";".join(small_cache.written[i] for i in mine) == want[3]
            assert [(int(p) & (1 << SIDE_BITS) - 1, int(p) >> SIDE_BITS) for p in links] == want[4]


# -- manifest ---------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes):
    """The root and the siblings of every leaf, level by level."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for leaf, p in enumerate(place):
            run = runs[p // 3]
            proofs[leaf].append((run[:p % 3], run[p % 3 + 1:]))
        nodes, place = [sha("".join(run)) for run in runs], [p // 3 for p in place]
    return nodes[0], proofs


def test_appended_witnesses_equal_the_tree():
    for n in [*range(1, 31), 80, 81, 82, 243, 500, 729]:
        leaves = [sha(str(i)) for i in range(n)]
        made = merkle.Appender(merkle.height(n))
        nodes = [merkle.Node(x) for x in leaves]
        for node in nodes:
            made.append(node)
        root, proofs = tree(leaves)
        assert made.close().digest == root
        for node, proof in zip(nodes, proofs):
            steps = merkle.witness(node)
            assert steps == proof and merkle.unpacked(merkle.packed(steps)) == proof
            assert merkle.folded(node.digest, steps) == root


@pytest.mark.parametrize("sizes", [[1], [2200], [1, 1], [729, 730, 1, 3, 1459]])
def test_manifest_over_many_blocks(sizes, spark):
    rows = [(f"s{g}" if g else None, i, sha(f"{g}-{i}")) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string").withColumns({
        "grp": F.lit("x"), "node": F.lit(1), "POS": F.lit(2), "root": F.lit("old"), "check": F.when(F.col("doc_id") % 2 == 0, F.lit("0")),
    })
    found = merkle.manifest(df, check_col="check", block_levels=2).collect()
    # Blocks of nine leaves: several rounds of block roots.
    below = [tree([r[2] for r in rows if r[0] == (f"s{g}" if g else None)]) for g in range(len(sizes))]
    root, above = tree([r for r, _ in below])
    assert len(found) == len(rows) and "grp" in found[0] and found[0].POS == 2
    for r in found:
        g = int(r.source[1:]) if r.source else 0
        steps = below[g][1][r.doc_id] + above[g]
        assert (r.root, r.subroot) == (root, below[g][0])
        assert r.proof_sha256 == sha("".join("".join(a + b) for a, b in steps))
        assert (r.folded_root == root) == (r.doc_id % 2 == 1)


def test_manifest_detects_tampering(spark, sf_dir):
    texts = dict(documents(spark, sf_dir))
    for r in queries()["op12_merkle"](spark, sf_dir).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id] or "")
        assert r.verified == (not changed)


# -- shards -------------------------------------------------------------------------


def test_shards_match_the_mixture(spark):
    # One source has most of the rows; the same row many times.
    rows = [("hot", i) for i in range(3_000)] + [(None, i) for i in range(700)] + [("b", 1)] * 503 + [("c", 1)]
    df = spark.createDataFrame(rows, "source string, doc_id long").withColumn("Shard", F.lit("old"))
    found = interleaved(df, 7, by=["doc_id"]).collect()
    assert Counter((r.source, r.doc_id) for r in found) == Counter(rows)
    sizes = Counter(r.shard for r in found)
    assert sorted(sizes) == list(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(n)) for s, n in sizes.items())
    of = Counter(s for s, _ in rows)
    for s, n in sizes.items():
        for source, total in of.items():
            assert abs(sum(r.source == source for r in found if r.shard == s) - total * n / len(rows)) <= 2
    # Any prefix of a shard has the mixture too, and the ids are shuffled.
    head = [r for r in found if r.shard == 3 and r.slot < 100]
    assert abs(sum(r.source == "hot" for r in head) - 100 * 3_000 / len(rows)) <= 2
    ids = [r.doc_id for r in sorted(head, key=lambda r: r.slot) if r.source == "hot"]
    assert ids != sorted(ids) and max(ids) - min(ids) > 1_000


def test_few_rows_and_seeds(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)], "source string, doc_id long")
    found = sorted((r.shard, r.slot) for r in interleaved(df, 40).collect())
    assert found == [(0, 0), (13, 0), (26, 0)]
    many = spark.createDataFrame([("a", i) for i in range(50)], "source string, doc_id long")
    places = [{r.doc_id: (r.shard, r.slot) for r in interleaved(many, 2, seed=s).collect()} for s in ("x", "x", "y")]
    assert places[0] == places[1] != places[2]


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([("a", i) for i in range(90)], "source string, doc_id long")
    write_shards(interleaved(df, 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert [r.slot for r in spark.read.parquet(str(tmp_path / "out/shard=1")).collect()] == list(range(30))
    assert back.count() == 90 and back.columns == ["source", "doc_id", "slot", "shard"]


# -- near-duplicates by similarity: hot shingles, many members ------------------------------


@pytest.mark.parametrize("hot, members", [(3, 2), (10**9, 3)])
def test_hot_shingles_and_many_members(spark, monkeypatch, hot, members):
    """A third of the texts are near copies of one another; none of the ways loses a link."""
    from passagekit.llm import similar, simhash

    monkeypatch.setattr(similar, "HOT_ROWS", hot)
    monkeypatch.setattr(similar, "MEMBERS", members)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1:]) for i in range(0, 120, 4)]
    texts += [" ".join(f"u{i}-{j}" for j in range(40)) for i in range(50)] + texts[:7] + [None, "", "", "a b", "A b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs, size=5, similarity=0.8).collect()}

    def shingles(t):
        words = (t or "").lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, one in enumerate(sets):
        for j in range(i):
            if one == sets[j] or 5 * len(one & sets[j]) >= 4 * len(one | sets[j]) > 0:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert kept == set(label)


def test_added_tokens_are_those_of_the_library():
    from passagekit.llm.tokens import WordTokenizer

    plain, words = Tokenizer.from_file(LEFT), WordTokenizer(LEFT, remembered=5, chars=40)
    texts = ["hello <|endoftext|> world", "a b", None, "a <|endoftext|>", "x" * 500 + " a b", "a b c d e f g", "a b c  d"]
    for _ in range(3):
        ids, counts = words.encode(texts)
        assert ids.tolist() == [i for t in texts for i in plain.encode(t or "", add_special_tokens=False).ids]
        assert counts.tolist() == [len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert words.held <= 2_000


def test_tokens_of_pieces_cut_at_marks():
    from passagekit.llm.tokens import WordTokenizer

    plain, words = Tokenizer.from_file(LEFT), WordTokenizer(LEFT, remembered=20)
    texts = [
        "Avec,\nAvec.\n\nAvec\n \nz", "a,b.c;d:e!f?g\nh", "é,é.\né\n\né", "don't,'s don'\nt", "x\n", "\nx", "\n\nx", " x", "x ",
        "1,2.\n3", "日,\n日.\nz", "a\x00b\nc", "a\x0b\nb", ".\na\nb\nc", "word" * 3_000 + ",\nword", "", None,
    ]
    for batch in (texts, texts[::-1], [" ".join(t or "" for t in texts)]):
        ids, counts = words.encode(batch)
        wanted = [plain.encode(t or "", add_special_tokens=False).ids for t in batch]
        assert counts.tolist() == [len(w) for w in wanted]
        assert ids.tolist() == [i for w in wanted for i in w]


def test_pipeline_offers_the_pairs_of_near_fingerprints_first(spark, monkeypatch):
    """Texts with near fingerprints meet through the pivot tables before the exact search."""
    from passagekit.llm import similar, simhash

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:399], "other"]), " ".join(f"x{i}" for i in range(300)), " ".join(f"x{i}" for i in range(300, 600))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [simhash.fingerprint(simhash.shingle_hashes(t, 5)) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 < (prints[2] ^ prints[3]).bit_count()
    offered, links = [], similar.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda *args: (offered.append(args[4].collect()), links(*args))[1])
    kept = simhash.one_of_each(docs, size=5, similarity=0.8).select("doc_id").collect()
    keys = sorted(np.array([similar.key_of(similar.shingle_set(t, 5)) for t in texts[:2]], np.uint64).view(np.int64).tolist())
    assert [sorted(r) for r in offered[0]] == [keys] and sorted(r.doc_id for r in kept) == [0, 2, 3]


def test_prefixes_are_shuffled_without_being_stored(spark, monkeypatch):
    from passagekit.llm import similar, simhash

    labels, store = [], similar.stage
    monkeypatch.setattr(similar, "stage", lambda df, label="stage", *more: (labels.append(label), store(df, label, *more))[1])
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join([*words[:59], "x"])), (2, "a b c d e f")], "doc_id long, text string")
    kept = simhash.one_of_each(docs, size=5, similarity=0.8).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [0, 2] and "met" in labels
    assert not {"prefixes", "hot-prefixes"} & set(labels)


def test_altered_copies_that_stay_apart_do_not_meet_pair_by_pair(spark, monkeypatch):
    """Copies with one altered word meet the text itself; those with four are far from all others."""
    from passagekit.llm import similar, simhash

    base = [f"w{i}" for i in range(104)]
    texts = [" ".join(base)]
    for i in range(60):
        places = [5 + (7 * i + 25 * j) % 95 for j in range(1 if i % 3 == 0 else 4)]
        texts.append(" ".join(f"x{i}-{at}" if at in places else w for at, w in enumerate(base)))
    sets = [set(similar.shingle_set(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i, one in enumerate(sets):
        for j in range(i):
            if 5 * len(one & sets[j]) >= 4 * len(one | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert len(set(label)) > 30
    rows, crossing = [], similar.crossing
    monkeypatch.setattr(similar, "crossing", lambda *args: (rows.append(crossing(*args).count()), crossing(*args))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs, size=5, similarity=0.8).collect()}
    # All pairs of the copies that stay apart were 780 rows for each of their shingles.
    assert kept == set(label) and sum(rows) < 100


def test_pairs_whose_prefixes_share_too_little_are_not_compared(spark):
    """A bound on the shared shingles never drops a similar pair, also if digests are equal."""
    from fractions import Fraction
    from passagekit.llm import similar

    wanted, none = Fraction("0.8"), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(8):
        base = rng.integers(0, 1 << 62, 200, np.uint64)
        base[:40] = base[0] + (np.arange(40, dtype=np.uint64) << np.uint64(16))
        sets += [np.unique(np.r_[base[cut:], rng.integers(0, 1 << 62, cut, np.uint64)]) for cut in (0, 10, 22, 45, 80)]
    rows = [(int(t), i, len(s), at) for i, s in enumerate(sets) for at, t in enumerate(similar.prefix(s, wanted, *none).tolist())]
    left = similar.stage(spark.createDataFrame(rows, "token long, fp long, n int, place int"))
    pairs = similar.stage(spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(i)], "m long, c long"))
    kept = {(r.m, r.c) for r in similar.enough_shared(pairs, left, wanted).collect()}
    true = set()
    for i, one in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(one, sets[j]))
            if 5 * both >= 4 * (len(one) + len(sets[j]) - both):
                true.add((i, j))
    assert true and true <= kept and len(kept) < 100
