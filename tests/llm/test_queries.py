"""The queries of the subpackage against SQL or brute force, on given and on dirty tables."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from passagekit.llm.rans import vocabulary
from tools.compare import difference

NAMES = [name for name in queries() if re.match(r"op\d+_|pipeline$", name)]
CHECKED = [name for name in NAMES if name in oracle_sql()]


def connection(folder):
    found = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "conversations"):
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return found


def test_all_are_registered():
    assert [re.match(r"op(\d+)_|", n)[1] for n in sorted(NAMES, key=lambda n: (len(n.split("_")[0]), n))][:13] == [
        str(i) for i in range(1, 14)
    ]
    assert "pipeline" in NAMES and set(NAMES) - set(CHECKED) <= {
        "op1_quality", "op3_token_files", "op5_simhash", "op10_language", "op11_alignment", "pipeline",
    }


@pytest.mark.parametrize("name", CHECKED)
@pytest.mark.parametrize("kind", ["sf_dir", "dirty_dir"])
def test_matches_sql(name, kind, spark, request):
    folder = request.getfixturevalue(kind)
    assert difference(queries()[name](spark, folder), connection(folder), oracle_sql()[name]) is None


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, spark, empty_dir):
    rows = queries()[name](spark, empty_dir).collect()
    assert [r.conv_id for r in rows] == ([-7] if name == "op2_chat" else [])


def _documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("kind", ["sf_dir", "dirty_dir"])
def test_token_files(kind, spark, request):
    folder = request.getfixturevalue(kind)
    plain = Tokenizer.from_file(vocabulary())
    rows = _documents(spark, folder)
    wanted = Counter()
    for (doc, text), coded in zip(rows, plain.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        ids = np.array([*coded.ids, 0], "<u4")
        wanted[doc, len(ids), zlib.crc32(ids.tobytes())] += 1
    found = sorted(queries()["op3_token_files"](spark, folder).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == wanted
    assert [r.start for r in found] == list(np.cumsum([0, *(r.n_tokens for r in found)])[:-1])
    order = [(r.doc_id is not None, r.doc_id) for r in found]
    assert all(a[0] <= b[0] and (not a[0] or a[1] <= b[1]) for a, b in zip(order, order[1:]))


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("kind", ["sf_dir", "dirty_dir"])
def test_simhash(kind, spark, request):
    folder = request.getfixturevalue(kind)
    rows = [(doc, _fingerprint(text)) for doc, text in _documents(spark, folder)]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                group[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        smallest.setdefault(root(i), []).append(doc)
    named = {r: min((d for d in docs if d is not None), default=None) for r, docs in smallest.items()}
    wanted = Counter((doc, f"{print_:016x}", named[root(i)]) for i, (doc, print_) in enumerate(rows))
    found = queries()["op5_simhash"](spark, folder).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == wanted


def test_language(spark, sf_dir):
    found = {r.doc_id: r for r in queries()["op10_language"](spark, sf_dir).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(found) == set(langs)
    assert all(r.held_out == (zlib.crc32(str(doc).encode()) % 5 == 0) and 0 <= r.score <= 1 for doc, r in found.items())
    held = [doc for doc, r in found.items() if r.held_out]
    assert sum(found[doc].lang_pred == langs[doc] for doc in held) >= 0.95 * len(held)


def test_language_of_dirty_rows(spark, dirty_dir):
    found = queries()["op10_language"](spark, dirty_dir).collect()
    texts = dict(_documents(spark, dirty_dir))
    assert len(found) == len(_documents(spark, dirty_dir))
    for row in found:
        text = texts[row.doc_id]
        assert (row.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
        assert row.lang_pred in ("und", "en", "fr")


def _quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat = len(inside)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat,
        len(words) < 50 or 100 * repeat > 50 * len(words),
    )


@pytest.mark.parametrize("kind", ["sf_dir", "dirty_dir"])
def test_quality_counts(kind, spark, request):
    folder = request.getfixturevalue(kind)
    wanted = Counter((doc, *_quality(text)) for doc, text in _documents(spark, folder))
    found = queries()["op1_quality"](spark, folder).collect()
    assert Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found
    ) == wanted
    assert not any(r.kept and r.base_failed for r in found)


def test_quality_keeps_good_and_rejects_junk(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = [r for r in queries()["op1_quality"](spark, sf_dir).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = ([r for r in found if labels[r.doc_id] == q] for q in (1, 0))
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.3 * len(bad)


def _shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _similar(one, two):
    return one == two or 5 * len(one & two) >= 4 * len(one | two) > 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.stage(step(spark, kept[-1], sf_dir), f"test-{name}"))
        assert kept[-1].columns == columns
    ids = [Counter(r.doc_id for r in df.select("doc_id").collect()) for df in kept]
    rules = {r.doc_id for r in queries()["op1_quality"](spark, sf_dir).collect() if r.kept}
    assert ids[1] == Counter(rules)
    sets = {d: _shingles(t, 5) for d, t in _documents(spark, sf_dir)}
    left, gone = sorted(ids[2]), sorted(set(ids[1]) - set(ids[2]))
    assert not any(_similar(sets[a], sets[b]) for i, a in enumerate(left) for b in left[:i])
    for one in gone:
        assert any(_similar(sets[one], sets[d]) for d in ids[1] if d != one)
    group = {d: d for d in ids[1]}
    for a in ids[1]:
        for b in ids[1]:
            if a < b and group[a] != group[b] and _similar(sets[a], sets[b]):
                old, new = group[b], group[a]
                group = {d: new if g == old else g for d, g in group.items()}
    assert left == sorted({min(d for d in group if group[d] == g) for g in group.values()})
    clean = {r.doc_id for r in queries()["op8_decontaminate"](spark, sf_dir).collect() if not r.contaminated}
    assert set(ids[3]) == set(ids[2]) & clean
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 3
    found = queries()["pipeline"](spark, sf_dir).collect()
    assert Counter(r.doc_id for r in found) == ids[4]


def test_pipeline_of_dirty_rows(spark, dirty_dir):
    rows = queries()["pipeline"](spark, dirty_dir).collect()
    assert all(r.n_tokens >= 1 for r in rows)
