"""Rows that must not get lost or be counted twice."""

import math
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from passagekit.functions import filters
from passagekit.operators import lexical, links, metadata, metrics, ranking, verdicts
from passagekit.plans import fixtures, reports, scans
from passagekit.scale import ALL_KEYS, CLEANUP, hash_sample, lists_by_one_sort, one_per_id, shuffles_dropped, stage
from passagekit.sources.readers import read_tolerant, read_tsv_years
from passagekit.sources.results import flatten_results, nest_results
from passagekit.streaming.incremental import read_target, run_incremental

FLAT = (
    "patent_id string, qtype string, q_idx int, question string, paper_idx int, paper_id string, para_idx int, "
    "paragraph_id string, rank int, paragraph_text string, contains_answer string, answer string, error string, rerank_score double"
)


def flat(spark, *rows):
    """Result rows from (patent, level, question, paper, text, verdict, error)."""
    full = [
        (p, level, q, "what", 0, paper, 0, f"{paper}_p0", 1, text, verdict, None, error, 0.5)
        if paper else (p, level, q, "what", *[None] * 10)
        for p, level, q, paper, text, verdict, error in rows
    ]
    return spark.createDataFrame(full, FLAT)


@pytest.mark.parametrize("passage,docs", [
    ("alpha beta", {"1", "2"}), ("alpha", {"1", "2", "3"}), ("ha be", {"1", "2"}), ("..", {"3"}), ("zeta", set()),
])
def test_short_passages_are_found(spark, passage, docs):
    texts = spark.createDataFrame(
        [(1, "one alpha beta two"), (2, "alpha beta"), (3, "alphabet .. soup"), (4, None)], "doc_id long, text string"
    )
    index = lexical.build_index(texts.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text")
    asked = spark.createDataFrame([("q", passage), ("null", None)], "pid string, passage string")
    pairs = lexical.containing_documents(index, asked, texts, "pid", "passage", "doc_id", "text")
    assert {(r.pid, r.doc_id) for r in pairs.collect()} == {("q", d) for d in docs}


def test_repeated_ids_are_indexed_once(spark):
    rows = [("a", 1, "red fish swims"), ("b", 1, "blue fish"), ("c", 1, "green bird")]
    docs = spark.createDataFrame(rows + [("b", 2, "blue fish fish"), ("b", 1, "blue fish")], "id string, shard int, text string")
    single = spark.createDataFrame(rows, "id string, shard int, text string")
    asked = spark.createDataFrame([("q", "fish")], "query_id string, question string")
    score = lambda df: lexical.bm25_topk(lexical.build_index(df, "id", "text"), asked, 9).collect()
    assert score(docs) == score(single) and len(score(docs)) == 2


@pytest.mark.parametrize("limit", [0, 500_000])
def test_hot_terms_give_the_same_scores(spark, monkeypatch, limit):
    docs = spark.range(300).select(F.col("id").cast("string"), F.concat(F.lit("the the word"), F.col("id") % 7).alias("text"))
    asked = spark.createDataFrame([("q", "the word3"), ("r", "the")], "query_id string, question string")
    index = lexical.build_index(docs, "id", "text")
    plain = lexical.bm25_topk(index, asked, 500).collect()
    monkeypatch.setattr(lexical, "ROWS_PER_SALT", 20)
    again = lexical.bm25_topk(index, asked, 500, max_broadcast_rows=limit).collect()
    assert sorted(plain) == sorted(again) and len(plain) == 600


def test_overlap_keeps_absent_and_counts_copies_once(spark):
    corpus = spark.createDataFrame([("a", "red fish"), ("a", "red"), ("b", None)], "paper_paragraph_id string, paragraph_text string")
    asked = spark.createDataFrame([("q", "red fish")], "query_id string, question string")
    candidates = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "gone")], "query_id string, doc_id string")
    got = [(r.doc_id, r.score, r["rank"]) for r in lexical.overlap_rerank(candidates, asked, corpus, 9).orderBy("rank").collect()]
    assert got == [("a", 0.5, 1), ("b", 0.0, 2), ("gone", 0.0, 3)]


def test_one_per_id(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "z"), (None, "x"), (None, "y")], "id long, t string")
    assert sorted((r.id or 0, r.t) for r in one_per_id(df, "id", ["t"]).collect()) == [(0, "x"), (0, "y"), (1, "a"), (2, "z")]


def test_half_read_files_are_reported(spark, tmp_path):
    df = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    spark.conf.set("parquet.block.size", 1 << 20)
    df.coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(f"{tmp_path}/a")
    df.coalesce(1).write.parquet(f"{tmp_path}/b")
    spark.conf.unset("parquet.block.size")
    damaged = next(Path(f"{tmp_path}/a").glob("part-*"))
    data = bytearray(damaged.read_bytes())
    for at in range(len(data) * 2 // 3, len(data) * 2 // 3 + 20_000):
        data[at] = 0xFF
    damaged.write_bytes(bytes(data))
    damaged.with_name(f".{damaged.name}.crc").unlink()
    rows, skipped = read_tolerant(spark, f"{tmp_path}/*", "id long, text string")
    found = skipped.collect()
    assert [(Path(r.path).parent.name, r.state, r.rows_promised) for r in found] == [("a", "partial", 200_000)]
    read = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id", "text"))).first().n
    assert read == 200_000 + found[0].rows_read < 400_000


def test_tsv_quotes_line_breaks_and_header_order(spark, tmp_path):
    (tmp_path / "1990.tsv").write_text('id\ttitle\n1\t"two\nlines, a ""word""\tand a tab"\n2\tplain\n')
    (tmp_path / "1991.tsv").write_text("title\tid\nswapped\t3\nbad\tx\n")
    (tmp_path / "1993.tsv").write_text("id\n4\n")
    rows, missing = read_tsv_years(spark, f"{tmp_path}/{{year}}.tsv", range(1990, 1994), "id long, title string", malformed="bad")
    got = sorted((r.source_year, r.id or 0, r.title, r.bad) for r in rows.collect())
    assert missing == [1992] and got == [
        (1990, 1, 'two\nlines, a "word"\tand a tab', 0), (1990, 2, "plain", 0), (1991, 0, "bad", 1),
        (1991, 3, "swapped", 0), (1993, 4, None, 0),
    ]


def test_a_second_source_adds_to_the_target(spark, tmp_path):
    schema = spark.range(1).schema
    place = str(tmp_path)
    for name, count in (("one", 5), ("two", 3)):
        spark.range(count).write.parquet(f"{place}/{name}")
        run = lambda: run_incremental(spark, f"{place}/{name}", schema, lambda df: df, f"{place}/out", f"{place}/state-{name}")
        run()
        run()
    assert read_target(spark, f"{place}/out", schema).count() == 8


def test_fields_outside_the_list_are_an_error(spark):
    rows = spark.createDataFrame([("A", "understanding", "cs.LG"), ("A", "understanding", "math")], "patent_section string, q_type string, paper_cat string")
    assert links.link_matrix(rows).first().asDict() == {"patent_section": "A", "cs": 1, "math": 1}
    assert links.link_matrix(rows, ["math", "cs", "bio"]).first().bio == 0
    with pytest.raises(ValueError, match="cs"):
        links.link_matrix(rows, ["math"])


def test_any_level_survives(spark):
    df = flat(
        spark, ("p", "remembering", 0, "x", "t", "Y", None), ("p", "applying", 0, "y", "t", "N", None),
        ("p", "applying", 1, None, None, None, None),
    )
    assert sorted(flatten_results(nest_results(df)).collect()) == sorted(df.collect())
    shares = links.level_shares(spark.createDataFrame([("A", "applying"), ("A", "remembering"), ("B", "applying")], "patent_section string, q_type string"))
    assert sorted(map(tuple, shares.collect())) == [("A", 0.5, 0.5), ("B", 1.0, 0.0)]
    assert verdicts.results_summary(df).first().asDict() == {"patent_id": "p", "questions": 3, "applying": 2, "remembering": 1}


def test_report_leaves_out_missing_texts(spark):
    df = flat(spark, ("p", "a", 0, "x", "text", "Y", None), ("p", "a", 1, "y", None, "N", "Paragraph text not found"))
    row = verdicts.run_report(df).first()
    assert (row.processed, row.verified, row.errors, row.missing_texts, row.yes_pct) == (2, 1, 0, 1, 100.0)


def test_patents_known_without_a_year_are_enriched(spark):
    df = flat(spark, ("p", "a", 0, "x", "t", "Y", None), ("q", "a", 0, "x", "t", "Y", None))
    patents = spark.createDataFrame([("p", None, "A")], "patent_id string, grant_year int, cpc_section string")
    papers = spark.createDataFrame([("x", 2001, "cs.LG")], "paper_id string, paper_year int, paper_category string")
    enriched = metadata.enrich(df, papers, patents)
    counts = metadata.enrichment_counts(enriched).first()
    assert (counts.enriched_patents, counts.total_patents, counts.enriched_papers) == (1, 2, 2)
    made = links.verified_links(df, patents, papers)
    assert {"patent_year", "patent_section", "q_type", "q_idx", "paper_cat"} <= set(made.columns)
    assert links.field_counts(made.withColumn("q_type", F.lit("understanding"))).first().links == 1
    assert links.lag_histogram(made).isEmpty()


def test_links_are_per_question(spark):
    df = flat(spark, *[("p", "a", q, "x", "t", "Y", None) for q in (0, 1, 1)])
    patents = spark.createDataFrame([("p", 2010, "A")], "patent_id string, grant_year int, cpc_section string")
    papers = spark.createDataFrame([("x", 2001, "cs")], "paper_id string, paper_year int, paper_category string")
    assert sorted(r.q_idx for r in links.verified_links(df, patents, papers).collect()) == [0, 1]


@pytest.mark.parametrize("question,fallback", [("what", False), ("  ", True), (None, True)])
def test_blank_questions_fall_back(spark, question, fallback):
    df = spark.createDataFrame([(1, question, "text"), (1, question, None)], "q int, asked string, paragraph_text string")
    got = filters.usable_passages(df, ["q"], asked="asked").collect()
    assert {r.fallback for r in got} == {fallback} and len(got) == (2 if fallback else 1)


def test_first_rows_of_any_number(spark, monkeypatch):
    df = spark.range(50).repartition(5)
    assert sorted(r.id for r in ranking.first_n(df, ["id"], 7).collect()) == list(range(7))
    monkeypatch.setattr(ranking, "SMALL_LIMIT", 3)
    assert sorted(r.id for r in ranking.first_n(df, ["id"], 7).collect()) == list(range(7))


def test_hash_sample_with_repeated_ids(spark):
    df = spark.range(60).select((F.col("id") % 20).alias("id"), F.lit("k").alias("k"))
    for n in (1, 10, 31, 60, 80):
        assert hash_sample(df, n, "id", "s", ["k"]).count() == hash_sample(df, n, "id", "s").count() == min(n, 60)


def test_exported_scores_have_four_decimals(spark):
    hits = spark.createDataFrame([("q", 1, "a", "p", 0.12345), ("q", 2, "b", "p", 2.0)], "q string, rank int, id string, paper string, score double")
    assert metrics.export_topk(hits, "q", "id", "paper", "score").first().top_scores == "0.1235;2.0000"
    assert math.isclose(float("0.1235"), 0.12345, abs_tol=1e-4) and stage(hits).count() == 2


def test_evidence_moves_texts_once(spark, monkeypatch):
    rows = flat(
        spark,
        ("1", "remembering", 0, "A", "red 0 gear of supplier", "Y", None),
        ("1", "understanding", 1, "B", "red 1 gear", None, None),
        ("2", "understanding", 1, "B", None, "Y", None),
        ("2", "understanding", 2, None, None, None, None),
        ("3", "understanding", 1, "A", "nothing here", "Y", None),
        (None, "understanding", 1, "A", "red 1 gear of supplier", None, None),
    )
    patents = spark.createDataFrame([("1", 2000, "O"), ("2", 1999, "F")], "patent_id string, grant_year int, cpc_section string")
    papers = spark.createDataFrame([("A", 1995, "x.y"), ("B", 1990, None)], "paper_id string, paper_year int, paper_category string")
    monkeypatch.setattr(fixtures, "reviews", lambda *_: rows)
    monkeypatch.setattr(reports, "review_facts", lambda *_: (patents, papers))
    plans = {}

    def watched(df, label, *rest):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, label, *rest)

    monkeypatch.setattr(reports, "stage", watched)
    options = [spark.conf.get(name, None) for name in (CLEANUP, ALL_KEYS)]
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {tuple(row) for row in reports.evidence_pipeline(spark, "").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert found == {
        ("links", "O", "Unknown", 1.0), ("lag", "remembering", "5", 1.0), ("lag", "understanding", "10", 1.0),
        ("level", "O", "remembering", 0.5), ("level", "O", "understanding", 0.5), ("patents", "enriched", "all", 2.0),
    }
    # Rows with a verdict, without a text and to be judged, each by one shuffle.
    moved = re.findall(r"Exchange hashpartitioning[^\n]*\n[^\n]*Project \[[^\n]*paragraph_text", plans["evidence"])
    assert len(moved) == 3
    assert [spark.conf.get(name, None) for name in (CLEANUP, ALL_KEYS)] == options


def test_shuffles_of_a_written_table_are_dropped(spark, tmp_path):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {b for b in blocks.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = files()
    rows = spark.range(10_000).groupBy((F.col("id") % 999).alias("k")).count()
    with shuffles_dropped(spark):
        rows.write.parquet(str(tmp_path / "rows"))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.read.parquet(str(tmp_path / "rows")).count() == rows.count() == 999


def test_nested_results_are_stored_compressed(spark, monkeypatch, tmp_path):
    rows = flat(
        spark,
        *[("7", "remembering", q, "A", "first line\n\"second\" \u00e9\u4e2d", "Y", None) for q in range(5)],
        ("7", "understanding", 0, None, None, None, None), ("8", "applying", 0, "B", None, None, "timeout"),
        (None, "remembering", 0, "C", "", "N", None),
    )
    monkeypatch.setattr(fixtures, "reviews", lambda *_: rows)
    monkeypatch.setattr(scans, "shared_dir", lambda _, label: str(tmp_path / label))
    key = lambda row: tuple(str(v) for v in row)
    assert sorted(scans.results_nest(spark, "").collect(), key=key) == sorted(rows.collect(), key=key)
    names = [f.name for f in (tmp_path / "documents").glob("part-*")]
    assert names and all(name.endswith(".json.gz") for name in names)


def test_nesting_sorts_rows_once(spark):
    rows = flat(spark, *[("7", "remembering", q, "A", "text", "Y", None) for q in range(5)])
    with lists_by_one_sort(spark):
        plan = nest_results(rows, questions_per_document=2)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) == 1 and "ObjectHashAggregate" not in plan
