"""Hand-written rows for the corner cases of single operators."""

import pytest
from pyspark.sql import functions as F

from passagekit import schemas
from passagekit.functions import filters, ids, parse, text
from passagekit.operators import corpus, metadata, patents, ranking, scoring, verdicts
from passagekit.sources.results import flatten_results, nest_results


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_paragraph_keys(spark):
    given = ["12_p0", "12_p5", "12", "12_x3", "12_p", "12_px", "_p4", ""]
    df = ids.with_paragraph_keys(spark.createDataFrame([(g,) for g in given], "id string"), "id")
    rows = {r.id: (r.paper_id, r.para_num, r.prev_id, r.next_id) for r in df.collect()}
    assert rows["12_p0"] == ("12", 0, None, "12_p1")
    assert rows["12_p5"] == ("12", 5, "12_p4", "12_p6")
    for name in ("12", "12_x3", "12_p", "12_px"):
        assert rows[name] == ("12", None, None, None)
    assert rows["_p4"][1] == 4 and rows[""][1] is None


def test_numeric_ids(spark):
    df = spark.createDataFrame([("7",), ("D7",), ("7a",), ("",), ("RE1",)], "patent_id string")
    assert values(ids.numeric_ids(df, "patent_id"), "patent_id") == [(7,), (None,), (None,)]


@pytest.mark.parametrize(
    "response, verdict, answer, failed",
    [
        ("CONTAINS_ANSWER: Y\nANSWER: x", "Y", "x", False),
        ("CONTAINS_ANSWER: y", "Y", None, False),
        ("CONTAINS_ANSWER: [Y]\nANSWER: x", "N", "x", False),
        ("CONTAINS_ANSWER: Y.", "N", None, False),
        ("CONTAINS_ANSWER: Yes: sure", "Y", None, False),
        ("CONTAINS_ANSWER: N\nCONTAINS_ANSWER: Y\nANSWER: a\nANSWER: b: c\nANSWER: N/A", "Y", "b: c", False),
        ("CONTAINS_ANSWER: Y\nANSWER: one\ntwo", "Y", "one", False),
        (" CONTAINS_ANSWER: Y", "Y", None, False),
        ("x\n CONTAINS_ANSWER: Y", "N", None, False),
        ("CONTAINS_ANSWER:", "N", None, False),
        ("ANSWER:", "N", "", False),
        ("\n \t", "N", None, True),
        ("", "N", None, True),
        (None, "N", None, True),
    ],
)
def test_verdict_forms(spark, response, verdict, answer, failed):
    row = parse.parse_verdicts(spark.createDataFrame([(response,)], "response string")).first()
    assert (row.contains_answer, row.answer, row.error is not None) == (verdict, answer, failed)


def test_question_and_keyword_forms(spark):
    given = [
        (1, '{"1": "a", "2": "b", "3": "c"}'),
        (2, 'text {"1": "a",\n"2": "b", "3": "c"} {"x": 1}'),
        (3, '{"1": "a", "2": "b"}'),
        (4, '{"1": "a", "2": "b", "3": "c", "4": "d"}'),
        (5, '{"1": "a", '),
        (6, "no json"),
        (7, None),
    ]
    df = spark.createDataFrame(given, "n int, response string")
    good, bad = parse.parse_questions(df)
    assert values(good.groupBy("n").count(), "n", "count") == [(1, 3), (2, 3)]
    assert values(bad, "n") == [(n,) for n in (3, 4, 5, 6, 7)]
    lists = spark.createDataFrame([("q=['a', \"b\"] [c]",), ("none",), ("[broken",), ("[]",), (None,)], "r string")
    found = [r[0] for r in lists.select(parse.keyword_list("r")).collect()]
    assert found == [["a", "b"], [], [], [], []]


def test_tokens_and_term_counts(spark):
    df = spark.createDataFrame([(1, "B a, b-A é1 é1!"), (2, ""), (3, None), (4, "?!")], "id int, t string")
    rows = {r.id: r for r in text.with_term_counts(df, "t").collect()}
    assert {(e.term, e.tf) for e in rows[1].terms} == {("a", 2), ("b", 2), ("é1", 2)}
    assert rows[1].doc_len == 6
    assert all(rows[n].doc_len == 0 and rows[n].terms is None for n in (2, 3, 4))


def test_stop_words_are_an_option(spark):
    from passagekit.operators.lexical import bm25_topk, build_index

    docs = spark.createDataFrame([("d1", "the cat"), ("d2", "the the dog"), ("d3", None)], "id string, t string")
    asked = spark.createDataFrame([(1, "The cat")], "query_id int, question string")
    plain = bm25_topk(build_index(docs, "id", "t"), asked, 5)
    assert [r.doc_id for r in plain.orderBy("rank").collect()] == ["d1", "d2"]
    analyse = text.without_words(["the"])
    index = build_index(docs, "id", "t", analyse)
    assert index.stats.first().asDict() == {"docs": 3, "total_len": 2, "avg_len": 2 / 3}
    assert [r.doc_id for r in bm25_topk(index, asked, 5, analyse=analyse).collect()] == ["d1"]


def test_head_tail(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, "a b c d")], "id int, t string")
    got = values(text.head_tail(df, "t", 4), "id", "part", "chunk", "weight")
    assert got == [(1, 0, "a b", 2), (1, 1, "d e", 2), (2, 0, "", 1), (3, 0, "a b c d", 4)]


def test_usable_passages_falls_back(spark):
    df = spark.createDataFrame(
        [(1, 1, None), (1, 2, "x"), (2, 1, " \t"), (2, 2, None)], "q int, rank int, paragraph_text string"
    )
    got = values(filters.usable_passages(df, ["q"]), "q", "rank", "fallback")
    assert got == [(1, 2, False), (2, 1, True), (2, 2, True)]


def test_many_to_one_join_raises(spark):
    left = spark.createDataFrame([(1, "a")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, r string")
    with pytest.raises(patents.DuplicateKeyError):
        patents.join_many_to_one(left, right, "k")
    nulls = spark.createDataFrame([(None, "x"), (None, "y"), (1, "z")], "k int, r string")
    assert values(patents.join_many_to_one(left, nulls, "k"), "k", "l", "r") == [(1, "a", "z")]


def test_fetch_prefers_smallest_copy_and_keeps_missing(spark):
    store = spark.createDataFrame(
        [("1_p0", 2, "late"), ("1_p0", 1, "b"), ("1_p0", 1, "a"), ("1_p1", 0, "next"), ("2_p0", 0, "other")],
        "paper_paragraph_id string, shard int, paragraph_text string",
    )
    wanted = spark.createDataFrame([("1_p0",), ("9_p9",)], "paper_paragraph_id string")
    got = values(corpus.fetch_texts(wanted, store), "paper_paragraph_id", "paragraph_text")
    assert got == [("1_p0", "a"), ("9_p9", None)]
    around = values(corpus.fetch_texts(wanted, store, neighbours=True), "paper_paragraph_id", "paragraph_text")
    assert ("1_p1", "next") in around and ("9_p8", None) in around and len(around) == 5


def test_context_uses_original_neighbours(spark):
    rows = [("1_p0", "aa"), ("1_p1", "bb"), ("1_p2", "c" * 300), ("1_p4", "dd"), ("1_p5", ""), ("1_p6", None), ("x", "zz")]
    df = spark.createDataFrame(rows, "paper_paragraph_id string, paragraph_text string")
    got = {r.paper_paragraph_id: (r.paragraph_text, r.merged) for r in corpus.merge_context(df, df).collect()}
    assert len(got) == len(rows)
    assert got["1_p0"] == ("aa\n\n[Next paragraph]: bb", True)
    assert got["1_p1"] == ("[Previous paragraph]: aa\n\nbb\n\n[Next paragraph]: " + "c" * 300, True)
    assert got["1_p2"] == ("c" * 300, False)
    assert got["1_p4"] == ("dd", False)
    assert got["1_p5"] == ("", False) and got["1_p6"] == (None, False) and got["x"] == ("zz", False)


def flat_row(patent, q, paper, para, verdict=None, text="t", error=None, answer=None, level="remembering"):
    return (patent, level, q, f"q{q}", paper, None if paper is None else f"paper{paper}", para,
            None if paper is None else f"paper{paper}_p{para}", None if paper is None else paper * 10 + para + 1,
            text if paper is not None else None, verdict, answer, error, None)


def flat(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RESULTS_FLAT)


def test_nest_and_flatten_round_trip(spark):
    rows = [flat_row("a", 0, 0, 0, "Y"), flat_row("a", 0, 0, 1), flat_row("a", 0, 1, 0), flat_row("a", 1, None, None),
            flat_row("a", 2, 0, 0, level="understanding"), flat_row("a", 0, 0, 0, level="understanding"),
            flat_row("a", 1, None, None, level="understanding"), flat_row("b", 0, None, None)]
    df = flat(spark, *rows)
    for width in (1, 2, 1000):
        nested = nest_results(df, questions_per_document=width)
        again = flatten_results(nested)
        assert values(again, *schemas.FLAT_COLUMNS) == values(df, *schemas.FLAT_COLUMNS)
    assert nest_results(df).count() == 2
    document = nest_results(df).where("patent_id = 'a'").first()
    first = document.question_types["remembering"][0]
    assert [p.paper_id for p in first.retrieved_papers] == ["paper0", "paper1"]
    assert first.stats == {"retrieved_papers": 2}


def test_prior_and_retry(spark):
    current = flat(spark, flat_row("a", 0, 0, 0), flat_row("a", 0, 0, 1), flat_row("a", 0, 1, 0, "Y", answer="own"))
    prior = flat(spark, flat_row("a", 0, 0, 0, "N", error="lost"), flat_row("a", 0, 0, 1, "Y", answer="w"),
                 flat_row("a", 0, 1, 0), flat_row("z", 0, 0, 0, "Y"))
    columns = ["paper_idx", "para_idx", "contains_answer", "answer", "error"]
    kept = values(verdicts.merge_prior(current, prior), *columns)
    assert kept == [(0, 0, "N", None, "lost"), (0, 1, "Y", "w", None), (1, 0, "Y", "own", None)]
    retried = values(verdicts.merge_prior(current, prior, retry_errors=True), *columns)
    assert retried[0] == (0, 0, None, None, None)


def test_method_merge_adds_first_yes_paper_only(spark):
    first = flat(spark, flat_row("a", 0, 0, 0, "N"), flat_row("a", 1, 0, 0, "Y"), flat_row("a", 2, None, None),
                 flat_row("a", 3, 0, 0, "N"), flat_row("b", 0, 0, 0, "N"))
    second = flat(spark, flat_row("a", 0, 0, 0, "N"), flat_row("a", 0, 1, 0, "Y"), flat_row("a", 0, 1, 1, "N"),
                  flat_row("a", 0, 2, 0, "Y"), flat_row("a", 1, 0, 0, "Y"), flat_row("a", 2, 0, 0, "Y"),
                  flat_row("a", 3, None, None))
    got = values(verdicts.merge_methods(first, second), "patent_id", "q_idx", "paper_idx", "para_idx", "paper_id", "contains_answer")
    assert got == sorted([
        ("a", 0, 0, 0, "paper0", "N"), ("a", 0, 1, 0, "paper1", "Y"), ("a", 0, 1, 1, "paper1", "N"),
        ("a", 1, 0, 0, "paper0", "Y"), ("a", 2, 0, 0, "paper0", "Y"), ("a", 3, 0, 0, "paper0", "N"),
        ("b", 0, 0, 0, "paper0", "N"),
    ], key=repr)
    report = verdicts.method_report(first, second).first()
    assert (report.compared, report.first_only, report.second_only, report.both, report.neither) == (3, 0, 2, 1, 0)


def test_statistics_on_nothing(spark):
    empty = flat(spark)
    row = verdicts.verification_stats(empty).first()
    assert (row.questions, row.paragraphs, row.pct_of_questions) == (0, 0, None)
    assert verdicts.run_report(empty).first().yes_pct == 0
    assert verdicts.method_report(empty, empty).first().combined_pct is None
    assert corpus.short_counts(corpus.length_counts(spark.createDataFrame([], "paragraph_text string"))).first().pct is None


def test_metadata_completes_unknown_targets(spark):
    targets = spark.createDataFrame([("1",), ("2",), ("3",)], "paper_id string")
    store = spark.createDataFrame([("1", "k1"), ("1", "k1"), ("2", ""), ("3", None), ("8", "k8")], "paper_id string, arxiv_id string")
    mapping = metadata.map_ids(store, targets, "paper_id", "arxiv_id")
    assert values(mapping, "paper_id", "arxiv_id") == [("1", "k1")]
    facts = spark.sql("select 'k1' id, 'cs.AI math.CO' categories, date'2011-05-06' update_date")
    got = values(metadata.paper_metadata(targets, mapping, facts), "paper_id", "year", "category", "arxiv_id")
    assert got == [("1", "2011", "cs.AI", "k1"), ("2", None, None, None), ("3", None, None, None)]


def test_group_by_paper(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "a", 2), (1, "b", 4)], "q int, paper_id string, rank int")
    got = values(ranking.group_by_paper(df, ["q"]), "rank", "paper_id", "paper_idx", "para_idx")
    assert got == [(1, "b", 0, 0), (2, "a", 1, 0), (3, "a", 1, 1), (4, "b", 0, 1)]


def test_generate_retries_until_three_questions(spark):
    rows = [("1", "one two three", "x", "c"), ("2", "one two", "x", "c"), ("3", "t", None, "c"), ("1", "one two three", "x", "b")]
    df = spark.createDataFrame(rows, "patent_id string, patent_title string, patent_abstract string, cpc_class string")
    done = spark.createDataFrame([], "patent_id string")
    good, bad = scoring.generate(df, done, scoring.template_writer("remembering"), "remembering")
    assert values(good, "patent_id", "question_id") == [("1", "1"), ("1", "2"), ("1", "3")]
    assert values(bad, "patent_id") == [("2",)]


def test_verify_skips_scorer_for_known_verdicts(spark):
    def refuse(batches):
        for batch in batches:
            assert list(batch["paragraph_id"]) in ([], ["paper0_p1"])
            yield batch.assign(response=["CONTAINS_ANSWER: Y\nANSWER: z"] * len(batch))

    df = flat(spark, flat_row("a", 0, 0, 0, "N", answer="kept"), flat_row("a", 0, 0, 1), flat_row("a", 0, 1, 0, text=None),
              flat_row("a", 1, None, None))
    facts = spark.createDataFrame([("a", "t", "u")], "patent_id string, patent_title string, patent_abstract string")
    got = values(scoring.verify(df, facts, refuse), "paragraph_id", "contains_answer", "answer", "error")
    assert got == [("paper0_p0", "N", "kept", None), ("paper0_p1", "Y", "z", None),
                   ("paper1_p0", "N", None, "Paragraph text not found")]


def test_domain_flag_defaults(spark):
    df = spark.createDataFrame([("G06", "G06F"), ("A01", "H04L"), ("A01", "A01B"), (None, None)], "cpc_class string, cpc_subclass string")
    flags = [r.is_computer_science_patent for r in patents.flag_domain(df).collect()]
    assert flags == [True, True, False, False]
    assert sum(len(codes) for codes in patents.COMPUTING_CODES.values()) == 17


def test_lag_histogram_edges(spark):
    from passagekit.operators.links import lag_histogram

    lags = [-6, -5, 0, 28, 29, 30]
    df = spark.createDataFrame([("u", 2000 + lag, 2000) for lag in lags] + [("u", None, 1)], "q_type string, patent_year int, paper_year int")
    got = {r.lag_bin: r.links for r in lag_histogram(df).collect()}
    assert len(got) == 34 and got[-5] == 1 and got[0] == 1 and got[28] == 2 and sum(got.values()) == 4


def test_box_and_histogram_of_known_lengths(spark):
    df = spark.createDataFrame([("x" * n,) for n in (1, 2, 3, 4, 100, 3000)], "paragraph_text string")
    counts = corpus.length_counts(df)
    box = corpus.length_box(counts).first()
    assert (box.n, box.q1, box.median, box.q3, box.low_whisker, box.high_whisker, box.excluded) == (5, 2, 3, 4, 1, 4, 1)
    bins = corpus.length_histogram(counts, 2000, inclusive=True).collect()
    assert len(bins) == 100 and sum(r.n for r in bins) == 5
    assert max(r.bin for r in bins if r.n) == 99


def test_truncated_file_is_reported(spark, tmp_path):
    from passagekit.sources.readers import read_tolerant

    path = str(tmp_path / "table")
    spark.range(100).repartition(4).write.parquet(path)
    spark.range(0).coalesce(1).write.mode("append").parquet(path)
    files = sorted(f for f in (tmp_path / "table").iterdir() if f.suffix == ".parquet")
    broken = max(files, key=lambda f: f.stat().st_size)
    broken.write_bytes(broken.read_bytes()[: broken.stat().st_size // 2])
    df, skipped = read_tolerant(spark, path, "id long")
    assert 0 < df.count() < 100
    got = skipped.collect()
    assert len(got) == 1 and got[0].path.endswith(broken.name) and got[0].state == "unreadable"


def test_corpus_scan_prunes_and_pushes(spark, tmp_path, capsys):
    from passagekit.sources.readers import read_paragraphs

    rows = [("1_p0", "a", 1, None, 0), ("1_p1", None, 1, None, 1)]
    path = str(tmp_path / "corpus")
    spark.createDataFrame(rows, schemas.PARAGRAPHS).write.partitionBy("shard").parquet(path)
    df = read_paragraphs(spark, path, ["paragraph_text"])
    assert [r.paragraph_text for r in df.collect()] == ["a"]
    df.explain()
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(paragraph_text)]" in plan
    assert "ReadSchema: struct<paragraph_text:string>" in plan


def test_left_join_spreads_missing_keys(spark):
    from passagekit.scale import left_join

    left = spark.range(1000).select("id", F.when(F.col("id") < 3, F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("0", "a"), ("2", "b"), (None, "never")], "k string, v string")
    got = left_join(left, right, "k", ["id"])
    assert got.count() == 1000 and got.where("v is not null").count() == 2
    assert {(r.id, r.v) for r in got.where("v is not null").collect()} == {(0, "a"), (2, "b")}


def test_merged_shards_move_no_documents(spark, sf_dir):
    """Paragraphs are counted before versions are joined, and documents are nested once."""
    import duckdb
    from passagekit.plans import scans
    from passagekit.plans.registry import ORACLES

    result = scans.shard_merge(spark, sf_dir)
    moved, open_ = [], [result._jdf.queryExecution().optimizedPlan()]
    while open_:
        node = open_.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        open_ += below
        if node.nodeName() in ("Join", "Aggregate"):
            moved += [column.name() for b in below for column in (b.output().apply(i) for i in range(b.output().size()))]
    assert "paragraph_id" in moved and "question_types" not in moved
    con = duckdb.connect()
    for name in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    columns = result.columns
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['shard_merge']})").fetchall()
    assert values(result, *columns) == sorted(wanted, key=repr)


def test_documents_without_verdicts(spark):
    from passagekit.sources.results import without_verdicts

    rows = [("1", level, q, "why", 0, "a", p, f"a_p{p}", p + 1, "text", "Y", "x", None, 1.0) for level in ("r", "u") for q in (0, 1) for p in (0, 1)]
    rows += [("2", "r", 0, "none", None, None, None, None, None, None, None, None, None, None)]
    flat = spark.createDataFrame(rows, schemas.RESULTS_FLAT)
    documents = nest_results(flat)
    bare = flatten_results(documents.withColumn("question_types", without_verdicts(documents)).withColumn("shard", F.lit(3)), ["shard"])
    assert bare.columns == [*schemas.FLAT_COLUMNS, "shard"] and bare.where("shard = 3").count() == 9
    wanted = flatten_results(nest_results(flat.withColumn("contains_answer", F.lit(None).cast("string"))))
    assert values(bare, *schemas.FLAT_COLUMNS) == values(wanted, *schemas.FLAT_COLUMNS)
