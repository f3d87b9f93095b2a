"""Properties that hold on any data, and the ways taken beyond a size bound."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagekit.functions import vectors as kernel
from passagekit.operators import corpus, lexical, metrics, patents, quantise, ranking, scoring, vector
from passagekit.plans import fixtures as fx
from passagekit.scale import hash_sample, row_index
from passagekit.streaming.incremental import read_errors, read_target, run_incremental


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def base(spark):
    rng = np.random.default_rng(3)
    data = [(f"v{i:03d}", [float(x) for x in rng.normal(size=8)], int(i % 5)) for i in range(300)]
    copies = [(f"w{i:03d}", data[0][1], 0) for i in range(150)]  # a third are equal
    return spark.createDataFrame(data + copies, "vec_id string, vector array<float>, label int").cache()


@pytest.fixture(scope="module")
def asked(base):
    return base.select(F.col("vec_id").alias("query_id"), "vector")


@pytest.fixture(scope="module")
def brute(base):
    local = base.toPandas()
    names, matrix = local["vec_id"].to_numpy(), kernel.stack(local["vector"])
    gaps = np.round(((matrix[:, None, :] - matrix[None, :, :]) ** 2).sum(axis=2), 6)
    expected = []
    for i, name in enumerate(names):
        order = sorted((gaps[i, j], names[j]) for j in range(len(names)) if j != i)[:7]
        expected += [(name, other, rank + 1) for rank, (_, other) in enumerate(order)]
    return sorted(expected)


def test_exact_search_matches_brute_force(asked, base, brute):
    hits = vector.knn_exact(asked, base, 7, skip_same_id=True)
    assert rows(hits, "query_id", "vec_id", "rank") == brute


def test_block_join_equals_broadcast(asked, base, brute, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vector, "QUERY_ROWS", 120)
    hits = vector.knn_exact(asked, base, 7, skip_same_id=True, max_query_bytes=0)
    assert rows(hits, "query_id", "vec_id", "rank") == brute


def test_probing_every_list_is_exact(asked, base, brute, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vector, "QUERY_ROWS", 30)
    centroids = vector.label_centroids(base, "label")
    lists = vector.ivf_assign(base, centroids)
    hits = vector.ivf_search(asked, lists, centroids, 5, 7, skip_same_id=True)
    assert rows(hits, "query_id", "vec_id", "rank") == brute


def test_recall_grows_with_probes(asked, base):
    centroids = vector.label_centroids(base, "label")
    lists = vector.ivf_assign(base, centroids)
    exact = vector.knn_exact(asked, base, 10, skip_same_id=True)
    found = [
        metrics.ann_recall(
            vector.ivf_search(asked, lists, centroids, n, 10, skip_same_id=True), exact, "query_id", "vec_id", 10
        ).agg(F.sum("found")).first()[0]
        for n in (1, 3, 5)
    ]
    assert found[0] <= found[1] <= found[2] == exact.count()


def test_own_code_words_make_quantised_search_exact(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(60)]
    base = spark.createDataFrame(data, "vec_id long, vector array<float>, label int")
    asked = base.select(F.col("vec_id").alias("query_id"), "vector")
    centroids = vector.label_centroids(base, "label")
    lists = vector.ivf_assign(base, centroids)
    names, centres = vector._centres(centroids)
    local = lists.toPandas().sort_values("vec_id")
    rest = kernel.stack(local["vector"]) - centres[0]
    books = rest.reshape(60, 4, 2).transpose(1, 0, 2)
    coded = quantise.pq_encode(lists, centroids, books)
    assert [list(r.codes) for r in coded.orderBy("vec_id").collect()] == [[i] * 4 for i in range(60)]
    hits = quantise.pq_search(asked, coded, centroids, books, 1, 5, skip_same_id=True)
    exact = vector.knn_exact(asked, base, 5, skip_same_id=True)
    assert rows(hits, "query_id", "vec_id", "rank") == rows(exact, "query_id", "vec_id", "rank")


def test_trained_codes_keep_neighbours(spark, sf_dir):
    base = fx.vectors(spark, sf_dir)
    asked = fx.vector_queries(spark, sf_dir)
    centroids = vector.ivf_fit(vector.training_sample(base), 4)
    lists = vector.ivf_assign(base, centroids)
    books = quantise.pq_fit(lists, centroids, 16, 64, iterations=4)
    coded = quantise.pq_encode(lists, centroids, books)
    near = quantise.pq_search(asked, coded, centroids, books, 4, 10, skip_same_id=True)
    exact = vector.knn_exact(asked, base, 10, skip_same_id=True)
    overlap = metrics.ann_recall(near, exact, "query_id", "vec_id", 10).agg(F.avg("overlap")).first()[0]
    assert overlap > 0.4


def test_vector_pool_keeps_zero(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 0.0], 1), ("a", [0.0, 1.0], 3), ("z", [0.0, 0.0], 2)], "owner string, vector array<float>, weight int"
    )
    got = {r.owner: r.vector for r in vector.pool_vectors(df, "owner").collect()}
    assert got["z"] == [0.0, 0.0]
    assert got["a"] == pytest.approx([0.25 / 0.625**0.5, 0.75 / 0.625**0.5])


def test_salted_lexical_search_equals_broadcast(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lexical, "ROWS_PER_SALT", 50)
    index, asked = fx.paragraph_index(spark, sf_dir), fx.questions(spark, sf_dir)
    small = lexical.bm25_topk(index, asked, 20)
    large = lexical.bm25_topk(index, asked, 20, max_broadcast_rows=10)
    columns = ["query_id", "doc_id", "score", "rank"]
    assert rows(small, *columns) == rows(large, *columns)


def test_cascade_without_cuts_is_its_last_stage(spark, sf_dir):
    from passagekit.plans.lexical import question_coverage

    index, asked, texts = fx.paragraph_index(spark, sf_dir), fx.questions(spark, sf_dir), fx.paragraphs(spark, sf_dir)
    last = question_coverage(spark, sf_dir)
    wide = lexical.cascade(index, asked, texts, last, (1_000_000, 1_000_000))
    everything = last(lexical.bm25_topk(index, asked, 1_000_000))
    columns = ["query_id", "doc_id", "rerank_score", "rank"]
    assert rows(wide, *columns) == rows(everything, *columns)
    unstaged = lexical.cascade(index, asked, texts, last, (50, 20), staged=False)
    staged = lexical.cascade(index, asked, texts, last, (50, 20))
    assert rows(unstaged, *columns) == rows(staged, *columns)


@pytest.mark.parametrize("n", [1, 37, 500, 5000])
def test_hash_sample_is_exact_under_skew(spark, n):
    df = spark.range(1200).select(
        "id", F.when(F.col("id") < 1100, "hot").when(F.col("id") < 1199, "cold").alias("k")
    )
    got = hash_sample(df, n, "id", "s", by=["k"], digits=1)
    counts = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
    assert counts == {"hot": min(n, 1100), "cold": min(n, 99)}
    ordered = sorted((r.h, r.id) for r in df.where("k = 'hot'").select("id", F.md5(F.concat(F.lit("s"), F.col("id"))).alias("h")).collect())
    assert {i for _, i in ordered[:n]} == {r.id for r in got.where("k = 'hot'").collect()}
    whole = hash_sample(df, n, "id", "s", digits=1)
    assert whole.count() == min(n, 1200)


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(5000).select(F.xxhash64("id").cast("string").alias("name"), F.lit("same").alias("hot"))
    got = row_index(df.repartition(7), ["hot", "name"]).orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(5000))
    assert [r.name for r in got] == sorted(r.name for r in got)


def test_shards_are_disjoint_and_complete(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("patent_id"))
    got = ranking.assign_shards(df.union(df), "patent_id", 10)
    sizes = [r["count"] for r in got.groupBy("shard").count().orderBy("shard").collect()]
    assert sum(sizes) == 103 and set(sizes[:-1]) == {11} and sizes[-1] <= 11
    spans = got.groupBy("shard").agg(F.min("patent_id").alias("a"), F.max("patent_id").alias("b")).orderBy("shard").collect()
    assert all(left.b < right.a for left, right in zip(spans, spans[1:]))


def test_every_nth_and_first(spark):
    df = spark.range(100).select(F.col("id").alias("n"))
    assert [r.n for r in ranking.every_nth(df, ["n"], 8).orderBy("n").collect()] == [12 * i for i in range(8)]
    assert ranking.every_nth(df, ["n"], 300).count() == 100
    assert [r.n for r in ranking.first_n(df, ["n"], 3).orderBy("n").collect()] == [0, 1, 2]


def test_single_copy_survives_a_hot_id(spark):
    hot = spark.range(3000).select(
        F.when(F.col("id") < 2000, "1_p0").otherwise(F.concat(F.col("id"), F.lit("_p0"))).alias("paper_paragraph_id"),
        (F.col("id") % 7).cast("int").alias("shard"), F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("paragraph_text"),
    )
    got = corpus.single_copy(hot)
    assert got.count() == 1001
    assert got.where("paper_paragraph_id = '1_p0'").first().paragraph_text == "t00000"


def test_class_mark_needs_the_whole_sample(spark):
    df = spark.createDataFrame(
        [("a", 1, True), ("a", 2, True), ("b", 3, True), ("b", 4, False), (None, 5, True), ("c", 6, None)],
        "cpc_class string, patent_id long, is_computer_science_patent boolean",
    )
    got = patents.stratified_cap(df, "cpc_class")
    assert {(r.cpc_class, r.class_is_cs) for r in got.collect()} == {("a", True), ("b", False), ("c", False)}


def test_embedding_resumes(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    inner = scoring.hashing_encoder()

    def counting(batches):
        for batch in inner(batches):
            calls.add(len(batch))
            yield batch

    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None), (4, "")], "id int, text string")
    path = str(tmp_path / "vectors")
    scoring.embed_batches(df.where("id = 1"), path, counting, "id")
    stored = scoring.embed_batches(df, path, counting, "id")
    assert sorted(r.id for r in stored.collect()) == [1, 2, 4]
    assert calls.value == 3


def test_stream_in_two_steps_equals_batch(spark, tmp_path):
    source = spark.range(60).select(F.col("id"), F.when(F.col("id") % 10 == 0, "lost").alias("error"))
    process = lambda df: df.withColumn("twice", F.col("id") * 2)
    place = {name: str(tmp_path / name) for name in ("in", "out", "state")}
    run = lambda: run_incremental(spark, place["in"], source.schema, process, place["out"], place["state"], files_per_batch=1)
    source.where("id < 25").repartition(2).write.mode("append").parquet(place["in"])
    run()
    source.where("id >= 25").repartition(3).write.mode("append").parquet(place["in"])
    run()
    run()
    schema = process(source).schema
    assert rows(read_target(spark, place["out"], schema), "id", "twice") == rows(process(source), "id", "twice")
    assert read_errors(spark, place["out"], schema).count() == 6


def test_repeated_batch_replaces_itself(spark, tmp_path):
    """A batch whose commit was lost is run again and leaves no double row."""
    source = spark.range(10)
    place = {name: str(tmp_path / name) for name in ("in", "out", "state")}
    source.write.parquet(place["in"])
    run = lambda: run_incremental(spark, place["in"], source.schema, lambda df: df, place["out"], place["state"])
    run()
    for commit in (tmp_path / "state" / "commits").iterdir():
        commit.unlink()
    run()
    assert read_target(spark, place["out"], source.schema).count() == 10


def test_top_k_is_limited_before_the_shuffle(spark, sf_dir, capsys):
    lexical.bm25_topk(fx.paragraph_index(spark, sf_dir), fx.questions(spark, sf_dir), 30_000).explain()
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") == 2
    assert "BroadcastHashJoin" in plan


def test_wanted_ids_filter_the_corpus_scan(spark, sf_dir, capsys):
    wanted = spark.createDataFrame([("1_p0",)], "paper_paragraph_id string")
    corpus.fetch_texts(wanted, fx.paragraphs(spark, sf_dir)).explain()
    assert "LeftSemi" in capsys.readouterr().out


def test_search_opens_only_the_buckets_of_its_terms(spark, sf_dir, capsys):
    index = fx.paragraph_index(spark, sf_dir)
    word = index.terms.orderBy("term").first().term
    asked = spark.createDataFrame([(1, word)], "query_id int, question string")
    hits = lexical.bm25_topk(index, asked, 5)
    assert 0 < hits.count() <= 5
    hits.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan, plan


def test_search_opens_only_probed_lists(spark, base, asked, tmp_path, capsys):
    centroids = vector.label_centroids(base, "label")
    path = str(tmp_path / "lists")
    vector.write_lists(vector.ivf_assign(base, centroids).select("vec_id", "vector", "cid"), path)
    one = asked.where("query_id = 'v000'")
    hits = vector.ivf_search(one, spark.read.parquet(path), centroids, 1, 5, skip_same_id=True)
    assert hits.count() == 5
    hits.explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(cid" in plan or "PartitionFilters: [(cid" in plan, plan


def test_scores_below_the_bound_stay_in_their_task(spark):
    from passagekit.scale import stage

    docs = spark.range(3_000).select(
        F.concat(F.lit("d"), "id").alias("id"),
        F.concat(F.lit("all w"), F.col("id") % 7, F.lit(" x"), F.col("id") % 500, F.repeat(F.lit(" pad"), (F.col("id") % 40).cast("int"))).alias("t"),
    ).unionByName(spark.createDataFrame([(None, "all w1 x2"), (None, "w1")], "id string, t string"))
    asked = spark.createDataFrame([(1, "all w1 x2 x2"), (2, "pad all w3"), (None, "x7"), (4, "nowhere")], "query_id int, question string")
    index = lexical.build_index(docs, "id", "t")
    weights = stage(lexical.query_weights(index, asked, "query_id", "question"), "weights")
    postings = index.postings.select("term", "doc_id", (F.col("tf") / (F.col("tf") + 1)).alias("part"))
    assert lexical._scored_by_document(weights, postings, 10, "query_id").count() < 1_000
    columns = ["query_id", "doc_id", "score", "rank"]
    for k in (1, 10, 100, 5_000):
        few = lexical.bm25_topk(index, asked, k)
        assert "HashAggregate(keys=[query_id#" not in few._jdf.queryExecution().executedPlan().toString().split("Union")[0]
        wide = lexical.bm25_topk(index, asked, k, max_broadcast_rows=1)
        assert sorted(few.select(columns).collect(), key=repr) == sorted(wide.select(columns).collect(), key=repr)


@pytest.mark.parametrize("bound", [1, 20, 500_000])
def test_postings_with_frequencies_equal_the_join(spark, sf_dir, bound):
    index = fx.paragraph_index(spark, sf_dir)
    columns = ["term", "doc_id", "tf", "doc_len", "df"]
    assert rows(lexical.with_frequencies(index, bound), *columns) == rows(index.postings.join(index.terms, "term"), *columns)


def test_held_hits_are_bounded_by_the_byte_limit(spark, monkeypatch):
    """Many queries with many hits stream past the base instead of being held by every task."""
    values = np.random.default_rng(7).normal(size=(300, 4)).round(1).tolist()
    rows_ = spark.createDataFrame([(i if i else None, v) for i, v in enumerate(values)], "vec_id long, vector array<double>").where("vec_id IS NOT NULL")
    asked = rows_.withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(vector, "QUERY_ROWS", 40)
    columns = ["query_id", "vec_id", "distance", "rank"]
    held = vector.knn_exact(asked, rows_, 30, True)
    # 300 queries of 32 bytes fit into this limit, their hits do not.
    streamed = vector.knn_exact(asked, rows_, 30, True, max_query_bytes=32 * 300)
    assert "MapInArrow" in streamed._jdf.queryExecution().executedPlan().toString()
    assert rows(streamed, *columns) == rows(held, *columns) and streamed.count() == 299 * 30


def test_papers_are_placed_without_another_shuffle(spark):
    from pyspark.sql.window import Window as W

    hits = spark.range(200).select((F.col("id") % 9).alias("q"), F.concat(F.lit("p"), F.col("id") % 5).alias("paper_id"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("id")))
    placed = ranking.group_by_paper(ranked, ["q"])
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(q") == 1 and plan.count("Exchange") == 1, plan
    assert placed.where("para_idx = 0").count() == 45


def test_few_papers_of_many_rows_do_not_meet_in_few_tasks(spark, sf_dir):
    from passagekit.plans.joins import _enriched

    plan = _enriched(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key" not in plan


def cells_compared(monkeypatch):
    """Sizes of all whole distance matrices from now on."""
    sizes, plain = [], kernel.nearest
    monkeypatch.setattr(kernel, "nearest", lambda distances, *rest, **named: sizes.append(distances.size) or plain(distances, *rest, **named))
    return sizes


@pytest.mark.parametrize("kind", ["normal", "ties", "equal", "far first", "tiny", "odd"])
def test_screened_search_equals_brute_force(kind):
    """What a product in single precision leaves out is no hit, whatever the vectors are."""
    rng = np.random.default_rng(3)
    base = {
        "normal": lambda: rng.normal(size=(5_000, 16)),
        "ties": lambda: rng.normal(size=(3_000, 3)).round(1),
        "equal": lambda: np.ones((1_500, 4)),
        "far first": lambda: (rng.normal(size=(2_000, 8)).T * np.linspace(9, 1, 2_000)).T,
        "tiny": lambda: rng.normal(size=(1_500, 4)) * 1e-25,
        "odd": lambda: np.r_[rng.normal(size=(1_500, 4)), [[1e20] * 4, [np.inf] * 4, [np.nan] * 4]],
    }[kind]()
    names = rng.permutation(len(base))
    best = [kernel.Best(names[-20:], base[-20:], 9, True)]
    with np.errstate(all="ignore"):
        for start in range(0, len(base), 1_100):
            kernel.offer_vectors(best, names[start:start + 1_100], base[start:start + 1_100])
        ids, found, values = best[0].found()
        for name, left in zip(names[-20:], base[-20:]):
            gaps = np.round(((base - left) ** 2).sum(axis=1), 6)
            expected = sorted((g, n) for g, n in zip(gaps, names) if n != name and np.isfinite(g))[:9]
            assert [n for _, n in expected] == found[ids == name].tolist()
            assert values[ids == name] == pytest.approx([g for g, _ in expected], rel=1e-9, abs=1e-6)


def test_most_vectors_are_screened_out(monkeypatch):
    base = np.random.default_rng(4).normal(size=(20_000, 32))
    search = vector._block_search(10, True)
    sizes = cells_compared(monkeypatch)
    asked = pd.DataFrame({"query_id": range(300), "vector": list(base[:300])})
    hits = search(asked, pd.DataFrame({"vec_id": range(20_000), "vector": list(base)}))
    assert len(hits) == 3_000
    # The whole matrix has six million cells.
    assert sum(sizes) < 300_000


def test_each_chunk_of_queries_has_a_task_of_its_own(spark, asked, base, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_ROWS", 20)
    plan = vector.knn_exact(asked, base, 7, max_query_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(chunk" not in plan, plan


def test_most_codes_are_screened_out(monkeypatch):
    """Sums of table entries are worked out only for codes that may be near; the hits are the same."""
    from types import SimpleNamespace

    rng = np.random.default_rng(6)
    books, codes, asked = rng.normal(size=(4, 16, 3)), rng.integers(0, 16, (20_000, 4)), rng.normal(size=(300, 12))
    shared = SimpleNamespace(value=(np.array([0]), np.zeros((1, 12)), books))
    sizes = cells_compared(monkeypatch)
    hits = quantise._code_search(shared, 10, True)(
        pd.DataFrame({"query_id": range(300), "vector": list(asked), "cid": 0}),
        pd.DataFrame({"vec_id": range(20_000), "codes": list(codes), "cid": 0}),
    )
    assert sum(sizes) < 300_000
    meant = np.concatenate([books[m][codes[:, m]] for m in range(4)], axis=1)
    for query in range(0, 300, 37):
        gaps = np.round(((meant - asked[query]) ** 2).sum(axis=1), 6)
        expected = sorted((g, i) for i, g in enumerate(gaps) if i != query)[:10]
        assert hits.vec_id[hits.query_id == query].tolist() == [i for _, i in expected]


def test_texts_meet_before_their_words_are_listed(spark):
    """Only texts are shuffled; the sets of words are made where a document's copies have met."""
    from passagekit.functions.text import word_set

    corpus_ = spark.createDataFrame(
        [("a", 1, "late copy"), ("a", 0, "zebra Zebra first"), ("b", 0, None), ("c", 0, "unasked")], "id string, shard int, paragraph_text string"
    )
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("x", 1)], "doc_id string, query_id long")
    found = lexical.with_document_values(asked, corpus_, "id", word_set("paragraph_text"), "words")
    got = {(r.doc_id, r.query_id): r.words for r in found.collect()}
    assert got == {("a", 1): ["zebra", "first"], ("a", 2): ["zebra", "first"], ("b", 1): None, ("x", 1): None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("array_distinct") < plan.index("Window [row_number"), plan
    bare = lexical.with_document_values(asked, corpus_.select("id", F.length("paragraph_text").alias("n")), "id", F.col("n"), "size")
    assert {r.doc_id: r.size for r in bare.collect()} == {"a": 9, "b": None, "x": None}
