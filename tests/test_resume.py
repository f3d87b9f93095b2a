"""Runs that break off, lost checkpoints, stored sketches, neighbours across blocks."""

import random

import pytest
from pyspark.sql import functions as F

from passagekit.operators import corpus, scoring
from passagekit.streaming.incremental import read_errors, read_ledger, read_target, run_incremental


def _counting(folder, bad=None):
    """A scorer that notes each row it gets, and breaks at ``bad`` while a mark is there."""

    def score(batches):
        import os
        import uuid

        for batch in batches:
            for key in batch["id"]:
                if key == bad and os.path.exists(f"{folder}/break"):
                    raise RuntimeError("lost")
                open(f"{folder}/call-{key}-{len(batch)}-{uuid.uuid4().hex}", "w").close()
            yield batch.assign(vector=[[float(k)] for k in batch["id"]])

    return score


def test_a_broken_run_goes_on_with_the_bucket_it_lost(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    (calls / "break").touch()
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(99, None)], "id int, text string")
    by_bucket = {}
    for row in df.where("text IS NOT NULL").withColumn("b", scoring.salt(["id"], 4)).collect():
        by_bucket.setdefault(row.b, []).append(row.id)
    order = sorted(by_bucket)
    bad = by_bucket[order[2]][0]
    path = str(tmp_path / "vectors")
    with pytest.raises(Exception):
        scoring.embed_batches(df, path, _counting(str(calls), bad), "id", buckets=4, batch_rows=3)
    schema = df.select("id", F.array(F.lit(1.0).cast("float")).alias("vector"))
    kept = {r.id for r in scoring.committed(schema, path).collect()}
    assert kept == {*by_bucket[order[0]], *by_bucket[order[1]]}
    (calls / "break").unlink()
    stored = scoring.embed_batches(df, path, _counting(str(calls), bad), "id", buckets=4, batch_rows=3)
    assert sorted((r.id, r.vector[0]) for r in stored.collect()) == [(i, float(i)) for i in range(40)]
    made = [p.name.split("-") for p in calls.iterdir()]
    assert all(int(size) <= 3 for _, _, size, _ in made)
    times = {i: sum(int(key) == i for _, key, *_ in made) for i in range(40)}
    # Finished buckets are scored once; the scorer meets no row of theirs again.
    assert all(times[i] == 1 for b in (order[0], order[1], order[3]) for i in by_bucket[b])
    assert all(times[i] in (1, 2) for i in by_bucket[order[2]])
    again = scoring.embed_batches(df, path, _counting(str(calls), bad), "id", buckets=4)
    assert again.count() == 40 and len(list(calls.iterdir())) == len(made)


def test_verdicts_in_buckets(spark, tmp_path):
    columns = "patent_id string, question string, paragraph_id string, paragraph_text string, contains_answer string, answer string, error string"
    rows = [("p", "what is it", f"x_p{i}" if i else None, f"it is what {i}" if i % 3 else None, None, None, None) for i in range(20)]
    flat = spark.createDataFrame(rows, columns)
    patents = spark.createDataFrame([("p", "t", "a")], "patent_id string, patent_title string, patent_abstract string")
    keys = ["patent_id", "question", "paragraph_id"]
    found = scoring.verify_in_buckets(flat, patents, scoring.overlap_judge(), str(tmp_path / "v"), keys, buckets=3, batch_rows=2)
    whole = scoring.verify(flat, patents, scoring.overlap_judge())
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    assert found.count() == 19


def test_a_lost_checkpoint_repeats_no_row(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], "id int, error string").schema

    def arrive(low, high):
        rows = [(i, "bad" if i % 4 == 0 else None) for i in range(low, high)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run(state):
        run_incremental(spark, source, schema, lambda df: df, target, str(tmp_path / state), files_per_batch=1)
        return sorted(r.id for r in read_target(spark, target, schema).collect())

    arrive(0, 8)
    assert run("one") == list(range(8))
    arrive(8, 12)
    # The checkpoint is gone: all files arrive again, but only the new one counts.
    assert run("two") == list(range(12))
    assert run("two") == list(range(12))
    assert sorted(r.id for r in read_errors(spark, target, schema).collect()) == [0, 4, 8]
    assert read_ledger(spark, target).count() == 2


def test_merged_sketches(spark):
    random.seed(3)
    lengths = [int(random.paretovariate(1.2) * 20) % 5_000 for _ in range(6_000)]
    df = spark.createDataFrame([(i % 7, "x" * n) for i, n in enumerate(lengths)], "shard int, paragraph_text string")
    sketches = corpus.length_sketches(df).collect()
    ordered = sorted(lengths)
    for seed in range(3):
        random.seed(seed)
        random.shuffle(sketches)
        first, later = spark.createDataFrame(sketches[:3]), spark.createDataFrame(sketches[3:])
        found = corpus.sketch_quantiles(first.unionByName(later)).first()
        for p, value in zip(corpus.PERCENTILES, found):
            low = sum(x < value for x in ordered) / len(ordered)
            high = sum(x <= value for x in ordered) / len(ordered)
            assert low - 0.01 <= p <= high + 0.01
    assert corpus.length_quantiles_approx(df.where("shard > 9")).first()[0] is None


def test_context_across_blocks_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(corpus, "CONTEXT_BLOCK", 3)
    ids = [f"a_p{i}" for i in (0, 1, 2, 3, 4, 6, 7, 8, 9)] + ["b_p2", "odd", "odd", "a_p05", "a_p-1", "c_p1", "c_p1"]
    rows = [(x, f"text {x}") for x in ids[:-1]] + [("c_p1", "a copy"), ("c_p2", "after"), ("d_p1", None), ("d_p2", "")]
    df = spark.createDataFrame(rows, "paper_paragraph_id string, paragraph_text string")
    found = corpus.merge_context(df, df)
    texts = {}
    for i, t in rows:
        if t:
            texts[i] = min(t, texts.get(i, t))
    wanted = []
    for i, t in rows:
        paper, _, number = i.partition("_p")
        near = [None, None]
        if t and number:
            n = int(number)
            near = [texts.get(f"{paper}_p{n - 1}") if n > 0 else None, texts.get(f"{paper}_p{n + 1}")]
        parts = [near[0] and f"[Previous paragraph]: {near[0]}", t, near[1] and f"[Next paragraph]: {near[1]}"]
        wanted.append((i, "\n\n".join(x for x in parts if x) if t else t, bool(near[0] or near[1])))
    got = [tuple(r) for r in found.select("paper_paragraph_id", "paragraph_text", "merged").collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_context_shuffles_texts_once(spark):
    df = spark.createDataFrame([("a_p0", "x")], "paper_paragraph_id string, paragraph_text string")
    plan = corpus.merge_context(df, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
