"""The operators' own interfaces: other parameters, other paths, damage."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from passagekit.llm import chat, decontaminate, langid, licence, linededup, mixture, quality, rans, simhash, warc
from passagekit.llm.common import python_batches
from passagekit.llm.components import components
from passagekit.llm.licence_texts import LICENCES, known_forms, long_texts
from passagekit.llm.tokens import WordTokenizer
from tools.compare import difference

# -- chat ---------------------------------------------------------------------

PARTS = ["#", "##", "###", "\\", "</turn>", "</turn", "\n", ": ", ":", "a", " ", "### assistant: ", "é"]
CONTENT = st.lists(st.sampled_from(PARTS), max_size=9).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(CONTENT, CONTENT), max_size=4))
def test_chat_comes_back(turns):
    pieces = [chat.render(role, text) for role, text in turns]
    parsed = chat.parse("".join(pieces))
    assert [t[:2] for t in parsed] == turns
    whole = "".join(pieces)
    for (_, text), (_, _, start, end) in zip(turns, parsed):
        assert whole[start:end] in (text, chat.escaped(text))


def test_chat_reads_many_escapes_in_one_pass():
    text = "### a</turn>\n\\" * 100_000
    piece = chat.render("user", text)
    assert chat.parse(piece)[0][:2] == ("user", text)


def test_chat_leaves_harmless_text_alone():
    assert chat.render("user", "a ## b") == "### user: a ## b</turn>\n"


@pytest.mark.parametrize("text", ["x", "### a", "### a: b", "### a: b</turn>\nrest", "### a: \\b</turn>\n", "### a: ###</turn>\n"])
def test_chat_grammar_is_strict(text):
    with pytest.raises(chat.GrammarError):
        chat.parse(text)


def test_chat_whole_conversations(spark, dirty_dir):
    turns = chat.format_turns(spark.read.parquet(f"{dirty_dir}/conversations.parquet"))
    texts = {r.conv_id: r.formatted for r in chat.conversation_texts(turns).collect()}
    back = {r.conv_id: r for r in chat.read_back(turns).collect()}
    assert set(texts) == set(back)
    for conv, text in texts.items():
        assert len(text) == back[conv].formatted_chars and len(chat.parse(text)) == back[conv].n_turns


# -- tokens and files -----------------------------------------------------------


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"), remembered=50)


PIECES = ["a", "B", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\x85", "\u2028", "'s", "'", "1", "é", "日", ".", "<|endoftext|>", "Ġ", "\x1c", "😀"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=6))
def test_tokens_equal_whole_encoding(words, texts):
    ids, counts = words.encode(texts)
    wanted = [words.encode_whole(t or "") for t in texts]
    assert counts.tolist() == [len(w) for w in wanted]
    assert ids.tolist() == [i for w in wanted for i in w]


@pytest.mark.parametrize("counts", [[5], [1, 0, 10**9], [3] * 40_000, [1] + [10**6] * 3])
def test_scaled_frequencies(counts):
    freqs = rans.scaled(np.array(counts))
    total = int(freqs.sum())
    assert total & (total - 1) == 0 and ((freqs > 0) == (np.array(counts) > 0)).all()


@pytest.mark.parametrize("total", [1, 63, 64, rans.BLOCK_IDS, rans.BLOCK_IDS + 1, 3 * rans.BLOCK_IDS + 777])
@pytest.mark.parametrize("kinds", [1, 2, 40_000])
def test_file_round_trip(tmp_path, total, kinds):
    rng = np.random.default_rng(total + kinds)
    ids = (rng.zipf(1.4, total) % kinds).astype(np.uint32)
    cuts = np.sort(rng.integers(0, total + 1, 5))
    sizes = np.diff(np.r_[0, cuts, total])
    path = f"{tmp_path}/a/x.ids"
    writer = rans.Writer(path, rans.Table(rans.scaled(np.bincount(ids, minlength=kinds))))
    for start in range(0, len(sizes), 2):
        part = slice(start, start + 2)
        begin = int(sizes[:start].sum())
        writer.add(ids[begin:begin + int(sizes[part].sum())], sizes[part])
    writer.close()
    back = list(rans.Reader(path).documents())
    assert [len(b) for b in back] == sizes.tolist() and np.array_equal(np.concatenate(back), ids)
    blocks = len(rans.Reader(path).counts)
    assert np.array_equal(rans.Reader(path).ids(blocks - 1, blocks), ids[(blocks - 1) * rans.BLOCK_IDS:])


def test_file_notices_damage(tmp_path):
    ids = np.arange(50_000, dtype=np.uint32) % 977
    path = f"{tmp_path}/x.ids"
    writer = rans.Writer(path, rans.Table(rans.scaled(np.bincount(ids))))
    writer.add(ids, np.array([len(ids)]))
    writer.close()
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(ValueError):
        list(rans.Reader(path).documents())
    open(path, "wb").write(bytes(data[:-9]))
    with pytest.raises(ValueError):
        rans.Reader(path)


def test_many_files_keep_the_order(spark, sf_dir):
    docs = python_batches(spark, 15).read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    ids = rans.tokenised(docs, "doc_id", "text", rans.vocabulary())
    files = rans.write_ids(ids, 50_257, file_ids=3_000)
    assert files.count() > 8
    found = rans.read_ids(files).join(ids.select("seq", "id", "n"), "seq").orderBy("start").collect()
    python_batches(spark)
    assert [r.id for r in found] == sorted(r.id for r in found) and all(r.n == r.n_tokens for r in found)
    assert [r.start for r in found] == np.cumsum([0, *(r.n for r in found)])[:-1].tolist()


# -- archives -------------------------------------------------------------------


def test_members_are_read_in_small_pieces(tmp_path):
    records = [warc.record_bytes(str(i), f"http://x/{i}", b"p" * i * 1_000) for i in range(5)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(records))

    class Slow:
        def __init__(self):
            self.file = open(path, "rb")

        def read(self, _):
            return self.file.read(7)

    found = [warc.parse_record(m) for m in warc.members(Slow())]
    assert [(r["record_id"], r["payload_bytes"]) for r in found] == [(str(i), i * 1_000) for i in range(5)]
    assert all(zlib.decompress(r, 31).startswith(b"WARC/1.1\r\n") for r in records)


def test_archives_notice_damage(tmp_path):
    member = zlib.decompress(warc.record_bytes("1", "u", b"payload"), 31)
    for wrong in (member.replace(b"payload", b"Payload"), member[:-1], member.replace(b"WARC/1.1", b"WARC/9.9")):
        with pytest.raises(ValueError):
            warc.parse_record(wrong)
    half = warc.record_bytes("1", "u", b"payload" * 99)[:-12]
    path = tmp_path / "half"
    path.write_bytes(half)
    with pytest.raises(ValueError), open(path, "rb") as stream:
        list(warc.members(stream))


def test_small_archives_and_no_revisits(spark, dirty_dir):
    pages = spark.read.parquet(f"{dirty_dir}/pages.parquet")
    listed = warc.write_archives(pages, "page_id", "url", "html", min_bytes=1_000, archive_bytes=1)
    rows = warc.read_archives(listed).collect()
    assert len(rows) == pages.count() == listed.count()
    assert {r.record_type for r in rows} == {"response"}
    wanted = Counter((None if r.page_id is None else str(r.page_id), r.url, (r.html or "").encode()) for r in pages.collect())
    assert Counter((r.record_id, r.url, bytes(r.payload)) for r in rows) == wanted


# -- lines ------------------------------------------------------------------------


def _kept(rows, min_docs, keep):
    keys = lambda text: [line.strip(" \t\n\x0b\x0c\r").lower() for line in (text or "").split("\n")]
    docs = Counter(key for _, text in rows for key in set(keys(text)) if key)
    first = {}
    for owner, text in rows:
        for number, key in enumerate(keys(text)):
            place = (owner is not None, owner, number)
            first[key] = min(first.get(key, place), place)
    out = []
    for owner, text in rows:
        lines = (text or "").split("\n")
        stays = [
            line for number, (line, key) in enumerate(zip(lines, keys(text)))
            if docs[key] < min_docs or keep == "first" and first[key] == (owner is not None, owner, number)
        ]
        out.append((owner, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return Counter(out)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("limits", [{}, {"max_bytes": 0}, {"max_keys": 0}, {"max_bytes": 0, "max_keys": 0}])
def test_lines(spark, dirty_dir, keep, limits):
    docs = spark.read.parquet(f"{dirty_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = linededup.drop_repeated_lines(docs, min_docs=3, keep=keep, out="out", **limits)
    assert found.columns == [*docs.columns, "out"]
    got = Counter((r.doc_id, r.out.n_lines, r.out.n_dropped, r.out.kept) for r in found.collect())
    assert got == _kept(rows, 3, keep)


def test_filter_never_misses_a_repeat():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    once, twice = (np.zeros(linededup.SEGMENT_BITS // 8, np.uint8) for _ in range(2))
    for part in (values[:15_000], values[10_000:]):
        places = linededup._probes(part)
        linededup._set(twice, places[linededup._test(once, places)])
        linededup._set(once, places)
    hit = linededup._test(twice, linededup._probes(values))
    assert hit[10_000:15_000].all() and hit.mean() < 0.4


# -- benchmark passages -------------------------------------------------------------


def test_passages_in_several_passes(spark, dirty_dir):
    docs, items = (spark.read.parquet(f"{dirty_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    one = decontaminate.find_passages(docs, items, out="found")
    many = decontaminate.find_passages(docs, items, out="found", max_windows=3)
    key = lambda df: Counter((r.doc_id, str(r.found)) for r in df.select("doc_id", "found").collect())
    assert key(one) == key(many)


def test_spans_are_those_of_the_original(spark, dirty_dir):
    docs, items = (spark.read.parquet(f"{dirty_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    found = decontaminate.find_passages(docs, items, out="found").where("found.n_hit > 0").collect()
    assert found
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    for row in found:
        hit = [row.text[s.start:s.end] for s in row.found.spans]
        assert sum(len(re.findall(pattern, h)) for h in hit) == row.found.n_hit
        inside = [m for m in re.finditer(pattern, row.text) if any(s.start <= m.start() < s.end for s in row.found.spans)]
        assert len(inside) == row.found.n_hit
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(found)


@pytest.mark.parametrize("url", ["http://a/x%20y?q=%41", "http://b/ü?é=1#%C3%A9", "http://c/a b\tc", "", ":", " x "])
def test_archives_keep_addresses(url):
    record = warc.parse_record(zlib.decompress(warc.record_bytes("1", url, b"x"), 31))
    assert record["url"] == (url or None) and record["payload"] == b"x"


def test_passes_hold_one_automaton_each(spark):
    words = [f"w{i}" for i in range(120)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "lone pair")], "item_id long, text string")
    rows = [(1, "a " + " ".join(words[5:20]) + " b"), (2, "Lone, PAIR"), (3, None), (4, " ".join(words[:9]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = decontaminate.find_passages(docs, items)
    for bound in ({"max_windows": 40}, {"max_bytes": 2_000}):
        cut = decontaminate.find_passages(docs, items, **bound)
        assert cut._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert cut.exceptAll(whole).isEmpty() and whole.exceptAll(cut).isEmpty()
    assert {r.doc_id: r.passages.n_hit for r in whole.collect()} == {1: 15, 2: 2, 3: 0, 4: 0}


# -- mixture -----------------------------------------------------------------------


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1_000), st.integers(1, 9)), min_size=1, max_size=6))
def test_targets_share_out_everything(spark, sources):
    rows = [(str(i), size, weight) for i, (size, weight) in enumerate(sources)]
    got = mixture.targets(spark.createDataFrame(rows, "source string, source_size long, weight long")).collect()
    total, left = sum(s for s, _ in sources), set(range(len(sources)))
    wanted, over = {}, True
    while over:
        share = (total - sum(wanted.values())) / (sum(sources[i][1] for i in left) or 1)
        over = {i for i in left if share * sources[i][1] > 3 * sources[i][0]}
        wanted |= {i: 3 * sources[i][0] for i in over}
        left -= over
    wanted |= {i: share * sources[i][1] for i in left}
    assert all(abs(r.target - wanted[int(r.source)]) <= 1e-6 * max(1, total) for r in got)


def test_mix_comes_near_its_targets_and_repeats(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('s', id % 4) AS source", "10 + id % 7 AS size", "'x' AS mix")
    mix = mixture.contract_mix(docs, F.col("size"))
    planned = mixture.with_copies(docs, mix, out="plan")
    again = mixture.with_copies(docs.repartition(7), mix, out="plan")
    taken = planned.groupBy("source").agg(F.sum(F.col("size") * F.col("plan.copies")).alias("n"), F.max("plan.target").alias("t"))
    assert all(abs(r.n - r.t) < 0.03 * r.t for r in taken.collect())
    assert planned.exceptAll(again).isEmpty() and planned.where("plan.copies > 3").isEmpty()
    copies = planned.agg(F.sum("plan.copies")).first()[0]
    out = mixture.mixed(docs, mix)
    assert out.columns == docs.columns and out.count() == copies


def test_equal_and_missing_ids_draw_on_their_own(spark):
    rows = [(None, "s0", f"t{i}") for i in range(400)] + [(1, "s1", f"u{i % 200}") for i in range(400)] + [(2, "s2", "same")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mixture.contract_mix(docs, F.lit(1))
    planned = mixture.with_copies(docs, mix)
    taken = {r.source: (r.n, r.t) for r in planned.groupBy("source").agg(F.sum("mix.copies").alias("n"), F.max("mix.target").alias("t")).collect()}
    assert all(abs(n - t) < 60 for n, t in taken.values()) and len(taken) == 3
    again = mixture.with_copies(docs.repartition(5), mix)
    assert planned.exceptAll(again).isEmpty() and planned.count() == len(rows)


# -- near-duplicates -------------------------------------------------------------------


def _union(fps, bits=4):
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= bits):
            group[root(i)] = root(int(j))
    return [root(i) for i in range(len(fps))]


def _crowd(seed, centres=6, around=60, apart=300):
    rng = np.random.default_rng(seed)
    fps = list(rng.integers(0, 1 << 64, apart, np.uint64))
    for centre in rng.integers(0, 1 << 64, centres, np.uint64):
        for _ in range(around):
            value = int(centre)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                value ^= 1 << int(bit)
            fps.append(np.uint64(value))
    return np.unique(np.array([*fps, 0], np.uint64))


@pytest.mark.parametrize("total", [700, 10**8, 10**13])
@pytest.mark.parametrize("max_group", [16, 4_096])
def test_links_connect_what_is_near(spark, total, max_group):
    """Any number of blocks and slices gives the classes of brute force."""
    fps = _crowd(total % 97)
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    links = simhash.find_links(df, len(fps), max_group=max_group, masks=simhash.block_masks(total))
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all(0 < ((a ^ b) & (2**64 - 1)).bit_count() for a, b in pairs)
    roots = {r.node: r.root for r in components(links).collect()}
    got = [roots.get(int(v), int(v)) for v in fps.view(np.int64)]
    wanted = _union(fps)
    assert len(set(zip(got, wanted))) == len(set(got)) == len(set(wanted))


def test_block_masks_lose_no_pair():
    for total in (1, 10**7, 10**9, 10**12):
        masks = simhash.block_masks(total)
        for seed in range(200):
            bits = random.Random(seed).sample(range(64), 4)
            change = sum(1 << b for b in bits)
            assert any(change & mask == 0 for mask in masks)


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b")
    star = spark.range(1_001, 1_400).selectExpr("id AS a", "1000L AS b")
    found = {r.node: r.root for r in components(chain.unionByName(star)).collect()}
    assert found == {**{i: 0 for i in range(300)}, **{i: 1_000 for i in range(1_000, 1_400)}}
    assert components(chain.where("false")).isEmpty()


def test_one_of_each_class_stays(spark, dirty_dir):
    docs = spark.read.parquet(f"{dirty_dir}/documents.parquet")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    print_of = lambda text: simhash.fingerprint(simhash.shingle_hashes(text))
    rows = [(r.doc_id, print_of(r.text)) for r in docs.collect()]
    classes = _union(np.array([p for _, p in rows], np.uint64))
    best = {}
    for (owner, value), root in zip(rows, classes):
        place = (owner is None, owner, value)
        best[root] = min(best.get(root, place), place, key=lambda p: (p[0], p[1] or 0, p[2] - (1 << 64) * (p[2] >> 63)))
    assert Counter((r.doc_id, print_of(r.text)) for r in kept.collect()) == Counter((p[1], p[2]) for p in best.values())


def _variants():
    """Texts with 5 to 25 % of their words changed at one place, chains, and copies."""
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80 + 10 * base)]
        rows.append(" ".join(words))
        for share in (0.05, 0.1, 0.15, 0.18, 0.22, 0.25):
            cut = int(share * len(words))
            rows.append(" ".join(words[:-cut] + [f"x{rng.randrange(10**6)}" for _ in range(cut // 3)]))
            rows.append(" ".join([f"y{rng.randrange(10**6)}"] * (cut // 4) + words[cut:]))
        rows.append(" ".join(words).upper())
    boiler = " ".join(f"b{i}" for i in range(60))
    return rows + [f"{boiler} own{i} line{i} of{i} text{i}" for i in range(20)] + [None, "", "one", "One", "a b c d e", "a b c d f"]


def _similar_classes(texts, size, similarity):
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    label = list(range(len(sets)))
    for i, one in enumerate(sets):
        for j, two in enumerate(sets[:i]):
            if one == two or len(one & two) >= similarity * len(one | two) > 0:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_one_of_each_by_similarity(spark):
    """All pairs of texts of the wanted similarity are found, also beyond four bits."""
    texts = _variants()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs, size=5, similarity=0.8).collect()}
    assert kept == set(_similar_classes(texts, 5, 0.8))


def test_pipeline_drops_near_copies_of_four_fifths(spark):
    words = [f"w{i}" for i in range(204)]
    near = words[:104] + [f"x{i}" for i in range(18)] + words[122:]
    texts = [" ".join(words), " ".join(near)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = [simhash.fingerprint(simhash.shingle_hashes(t)) for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() > simhash.MAX_BITS
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [0]


# -- licences -----------------------------------------------------------------------------


def test_licences_are_found_whatever_their_form(spark):
    mit = LICENCES["MIT"]
    forms = [
        mit, mit.upper(), "Copyright (c) 2019 Some One\n\n" + mit, re.sub(r"\s+", " ", mit),
        mit.replace("sublicense", "sub-license").replace('"', "“"), "(c) 2001 x\nAll rights reserved.\n" + mit.replace("License", "Licence"),
    ]
    others = [mit + " or else", mit.replace("without restriction", ""), "", None, "Copyright (c) 2020 x", "été"]
    docs = spark.createDataFrame(list(enumerate(forms + others)), "doc_id long, text string")
    found = {r.doc_id: r.licence for r in licence.find_licences(docs, licence.known_licences(spark)).collect()}
    assert [found[i].licences for i in range(len(forms))] == [["MIT"]] * len(forms)
    assert all(found[len(forms) + i].licences == [] for i in range(len(others)))
    assert found[len(forms) + 2].digest is None and found[len(forms) + 5].digest is not None


def test_long_licences_and_forms_without_title(spark):
    texts = dict(long_texts())
    cut = texts["GPL-3.0"].index("END OF TERMS")
    forms = {
        "Apache-2.0": texts["Apache-2.0"], "GPL-3.0": texts["GPL-3.0"][texts["GPL-3.0"].index("Copyright"):cut].upper(),
        "MIT": LICENCES["MIT"].split("\n\n", 1)[1], "ISC": "ISC License\n\nCopyright (c) 2020 x\n\n" + LICENCES["ISC"],
        "MPL-2.0": re.sub(r"\s+", " ", texts["MPL-2.0"]), "GPL-2.0": texts["GPL-2.0"],
    }
    docs = spark.createDataFrame([*forms.items(), ("none", texts["GPL-2.0"][:9_000])], "id string, text string")
    found = {r.id: r.licence.licences for r in licence.find_licences(docs, licence.known_licences(spark)).collect()}
    assert found == {name: [name] for name in forms} | {"none": []}


def test_known_licences_match_sql(spark, tmp_path):
    rows = list(enumerate(text for _, text in known_forms()))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = duckdb.connect()
    found.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(licence.op4_licence(spark, str(tmp_path)), found, licence.SQL) is None
    assert licence.op4_licence(spark, str(tmp_path)).where("NOT is_licence").isEmpty()


def test_licences_with_one_digest_are_listed(spark):
    known = spark.createDataFrame([("b", "Some text."), ("a", "some TEXT"), ("a", "some text"), (None, "x"), ("c", None)], "licence_id string, text string")
    docs = spark.createDataFrame([(1, "SOME text!")], "doc_id long, text string")
    assert licence.find_licences(docs, known).first().licence.licences == ["a", "b"]


# -- quality -----------------------------------------------------------------------------


def _jsd(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    half = lambda x: sum(a * np.log2(a / c) for a, c in zip(x, m) if a > 0)
    return float(np.sqrt(max(0.0, (half(p) + half(q)) / 2)))


def test_distances_are_those_of_the_definition(spark):
    words = ["the", "of", "xyzzy", "and", "der"]
    rows = [("en", "The of the of and. " * 60), ("de", "der Der, die! 12 " * 60), ("en", "xyzzy ### " * 120), (None, "the " * 120)]
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    references = quality.language_references(docs)
    by_lang = {r.lang: r for r in references.collect()}
    assert sorted(by_lang) == ["de", "en"]
    found = {r.doc_id: r.quality for r in quality.assess(docs, references).collect()}
    for i, (lang, text) in enumerate(rows):
        letters = re.findall(r"[a-z\x80-\U0010ffff]+", text.lower())
        counts = {}
        rest = text
        for name, pattern in quality.CLASSES:
            counts[name] = len(rest) - len(rest := re.sub(pattern, "", rest))
        counts["other"] = len(rest)
        assert found[i].language == lang
        if lang is None:
            assert (found[i].char_distance, found[i].word_distance) == (None, None)
            continue
        r = by_lang[lang]
        chars = _jsd([n / len(text) for n in counts.values()], r.classes)
        p = [letters.count(w) / len(letters) for w in r.words]
        q = list(r.words.values())
        near = _jsd([*p, 1 - sum(p)], [*q, max(0.0, 1 - sum(q))])
        assert abs(found[i].char_distance - chars) < 1e-9 and abs(found[i].word_distance - near) < 1e-9
    assert words


def test_quality_counts_the_terms_of_a_text_once(spark):
    rows = [(1, "en", "the cat and the dog " * 30), (2, "de", "und der Hund und die Katze " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    plan = quality.assess(docs, quality.language_references(docs))._jdf.queryExecution().optimizedPlan().toString()
    compared = [line.split(".languages, lambdafunction(", 1)[1] for line in plan.splitlines() if ".languages, lambdafunction(" in line]
    assert compared
    # Words are looked up by hash; that belongs before the languages are gone through.
    assert all(" hash(" not in line and "(hash(" not in line for line in compared)


def test_repeated_words_with_few_and_many_repeats(spark):
    texts = ["a b c d a b c", "a a a a", "a b", " ".join(str(i % 40) for i in range(300)), " ".join(str(i % 100) for i in range(250))]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    hashed = docs.withColumn("h", quality.window_hashes(F.split("t", " "), 3))
    found = {r.i: r.n for r in hashed.select("i", quality.repeated_words(F.col("h")).alias("n")).collect()}
    for i, text in enumerate(texts):
        words = text.split()
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        assert found[i] == len(covered)


def test_a_rare_language_is_judged_by_its_own_reference(spark):
    # One of a thousand documents is in another language, with long words.
    prose = " ".join(f"the{i} river ran{i} over stones{i} and the{i} old mill{i} stood" for i in range(12))
    rare = " ".join(f"Geschwindigkeitsbegrenzung und{chr(97 + i)} Mühlenbesitzer am{chr(97 + i)} Wasserfall" for i in range(25))
    rows = [(i, "en", prose) for i in range(999)] + [(999, "de", rare)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = {r.doc_id: r.quality for r in quality.assess(docs, quality.language_references(docs)).where("doc_id >= 998").collect()}
    assert found[999].kept and found[999].language == "de" and found[999].word_distance < 1e-6 and found[998].kept
    words = next(r.words for r in quality.language_references(docs).collect() if r.lang == "de")
    assert "geschwindigkeitsbegrenzung" in words


def test_many_languages_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 3)
    text = " ".join(f"word{i} and some{i} more of{i} it" for i in range(40))
    docs = spark.createDataFrame([(i, f"l{i % 9}" if i % 10 else None, text) for i in range(60)], "doc_id long, lang string, text string")
    found = [r.quality for r in quality.assess(docs, quality.language_references(docs)).collect()]
    assert len(found) == 60 and all(q.kept for q in found) and sum(q.language is None for q in found) == 6


@pytest.mark.parametrize("block", [1, 16])
def test_every_document_is_compared_with_every_language(spark, monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK_LANGUAGES", block)
    prose = {lang: " ".join(f"{w}{i}" for i in range(60) for w in words) for lang, words in
             (("en", ("the", "river", "stone")), ("de", ("der", "fluss", "und")), ("fr", ("le", "et", "pierre")))}
    rows = [(lang, prose[lang]) for lang in prose for _ in range(20)]
    # A wrong label, no label, and junk without and with a label.
    junk = " ".join(f"q{i} z{i} k{i}" for i in range(60))
    rows += [("en", prose["de"]), (None, prose["fr"]), (None, junk), ("fr", junk)]
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    found = {r.doc_id: r.quality for r in quality.assess(docs, quality.language_references(docs)).collect()}
    assert [found[i].kept for i in range(60, 64)] == [True, True, False, False] and all(found[i].kept for i in range(60))
    assert [(found[i].language, found[i].nearest, found[i].n_passing) for i in (60, 61)] == [("en", "de", 1), (None, "fr", 1)]
    assert found[62].n_passing == 0 and found[62].char_distance is None and len(found) == 64


def test_quality_without_references(spark):
    docs = spark.createDataFrame([(1, None, " ".join(f"w{i}" for i in range(60)))], "doc_id long, lang string, text string")
    assert quality.without_rejected(docs).count() == 1


# -- language ------------------------------------------------------------------------------


def test_windows_cover_the_whole_text():
    for size in (0, 1, langid.WINDOW, langid.WINDOW + 1, 1_000):
        rows = langid.windows_of(b"x" * size)
        assert rows.sum() == size * ord("x") and rows.shape[1] == langid.WINDOW


def test_training_is_deterministic_and_learns():
    texts = [b"aba abba baba " * 20, b"xyz zyx yzzy " * 20]
    rows = np.concatenate([langid.windows_of(t)[:1] for t in texts] * 40)
    labels = ["a", "x"] * 40
    one, two = langid.train(rows, labels), langid.train(rows, labels)
    assert np.array_equal(one.kernel, two.kernel)
    assert langid.predict(one, ["abba baba", "zyx", None, "12 34", ""])[:2][0][0] == "a"
    assert [p[0] for p in langid.predict(one, ["zyx yzzy", None, "12", "", "½ ² Ⅻ 12"])] == ["x", "und", "und", "und", "und"]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    rows, target = rng.integers(97, 123, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net = langid.train(rows, ["a", "b", "c"] * 2, epochs=1)
    wide = {k: getattr(net, k).astype(np.float64) for k in ("embedding", "kernel", "bias", "dense", "offset")}
    loss = lambda p: -np.log(langid.probabilities(langid.Network(net.languages, **p), rows).astype(np.float64)[np.arange(6), target]).mean()
    grads = langid._gradients(langid.Network(net.languages, **wide), rows, target, langid._mask())
    for name, at in (("dense", (3, 1)), ("offset", (2,)), ("bias", (5,)), ("kernel", (4, 2)), ("embedding", (101, 3))):
        changed = {k: v.copy() for k, v in wide.items()}
        changed[name][at] += 1e-3
        slope = (loss(changed) - loss(wide)) / 1e-3
        assert abs(slope - grads[name][at]) < 2e-3 + 0.05 * abs(slope), name


def test_sample_is_made_of_usable_rows(spark):
    """Texts without a letter and repeated rows leave the sample to the others."""
    rows = [(i, "aa", None if i % 2 else "12 34") for i in range(400)] + [(1_000 + i, "aa", f"text {i}") for i in range(20)]
    one, two = [i for i in range(5_000, 5_100) if zlib.crc32(str(i).encode()) % langid.FOLDS][:2]
    rows += [(one, "bb", f"other {i}") for i in range(30)] + [(two, "bb", "same")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    windows, labels = langid.sample(docs, "doc_id", "text", "lang", per_language=5)
    assert Counter(labels) == {"aa": 5, "bb": 5} and len(windows) == 10


# -- names ----------------------------------------------------------------------------------


def test_results_replace_columns_of_their_name(spark, dirty_dir):
    """A result takes the place of a column that has its name."""
    docs = spark.read.parquet(f"{dirty_dir}/documents.parquet")
    items = spark.read.parquet(f"{dirty_dir}/benchmark.parquet")
    mix = mixture.contract_mix(docs, F.lit(1))
    made = {
        "passages": decontaminate.find_passages(docs, items), "mix": mixture.with_copies(docs, mix),
        "lines": linededup.drop_repeated_lines(docs), "licence": licence.find_licences(docs, licence.known_licences(spark)),
        "language": langid.identify(docs, None), "quality": quality.assess(docs, quality.language_references(docs)),
        "fingerprint": simhash.with_fingerprints(docs),
    }
    for name, df in made.items():
        assert sorted(df.columns) == sorted(docs.columns), name
        assert df.schema[name].dataType.simpleString() != "string" and df.count() == docs.count()
