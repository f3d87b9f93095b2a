"""Batch scorers: reranking, vector production, verdicts and questions.

A scorer is a function from an iterator of pandas batches to an iterator of
pandas batches; Spark partitions the rows and streams the batches through it.
The scorers below are deterministic stand-ins that run without any model.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from passagekit.functions.parse import MISSING_TEXT, parse_questions, parse_verdicts
from passagekit.functions.prompts import question_prompt, verdict_prompt
from passagekit.operators.verdicts import pending
from passagekit.scale import salt, shared_dir, stage, top_k

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

#: Buckets of a run; each is committed when it is finished.
RUN_BUCKETS = 16


def apply_scorer(df: DataFrame, scorer: Scorer, columns: str, batch_rows: int | None = None) -> DataFrame:
    """Rows of ``df`` with the scorer's ``columns`` added.

    The scorer gets at most ``batch_rows`` rows at once, or as many as Spark sends.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                yield batch.iloc[start:start + batch_rows].reset_index(drop=True)

    run = scorer if batch_rows is None else lambda batches: scorer(sliced(batches))
    return df.mapInPandas(run, ", ".join([*fields, columns]))


# -- runs that can be resumed -------------------------------------------------


def committed(df: DataFrame, path: str) -> DataFrame:
    """What the finished buckets of all runs at ``path`` hold, in the schema of ``df``.

    Their names are few: buckets times runs.
    """
    spark = df.sparkSession
    # Appending nothing creates the list for the first run.
    listed = spark.createDataFrame([], "part string, bucket int")
    listed.write.mode("append").parquet(f"{path}/commits")
    parts = [row.part for row in spark.read.schema(listed.schema).parquet(f"{path}/commits").collect()]
    if not parts:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*[f"{path}/rows/{part}" for part in parts])


def run_in_buckets(
    todo: DataFrame, path: str, keys: str | Sequence[str], work: Callable[[DataFrame], DataFrame], buckets: int = RUN_BUCKETS
) -> DataFrame:
    """What ``work`` makes of all rows of ``todo``, kept at ``path`` across runs.

    Rows whose keys an earlier run has finished are skipped; null keys are equal here.
    The others are dealt into buckets by their keys. Each bucket is written under a name
    of its own, and counts from the moment a row in the list of commits names it. A run
    that breaks off has lost no finished bucket, and what it left unfinished is never
    read. ``work`` must keep the key columns.
    """
    spark = todo.sparkSession
    names = [keys] if isinstance(keys, str) else list(keys)
    result = work(todo)
    done = committed(result, path).select(*[F.col(n).alias(f"_done_{n}") for n in names]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_done_{n}")) for n in names])
    open_rows = todo.join(done, same, "left_anti").withColumn("_bucket", salt(names, buckets))
    # Dealt once, so that a bucket reads its own rows only.
    dealt = shared_dir(spark, "run-input")
    open_rows.write.partitionBy("_bucket").parquet(dealt)
    rows = spark.read.schema(open_rows.schema).parquet(dealt)
    for bucket in sorted(row._bucket for row in rows.select("_bucket").distinct().collect()):
        part = uuid.uuid4().hex
        work(rows.where(F.col("_bucket") == bucket).drop("_bucket")).write.parquet(f"{path}/rows/{part}")
        spark.createDataFrame([(part, bucket)], "part string, bucket int").write.mode("append").parquet(f"{path}/commits")
    return committed(result, path)


# -- reranking --------------------------------------------------------------


def rerank(
    pairs: DataFrame,
    scorer: Column | Scorer,
    k: int,
    query: Sequence[str] = ("query_id",),
    id_col: str = "doc_id",
) -> DataFrame:
    """Best ``k`` rows per query by score, with new ranks and the score kept.

    The scorer is a column expression or a batch scorer adding ``score``.
    Wide columns stay behind: only ids and scores are shuffled.
    """
    if isinstance(scorer, Column):
        scored = pairs.withColumn("_new", scorer)
    else:
        scored = apply_scorer(pairs.drop("score"), scorer, "score double").withColumn("_new", F.col("score"))
    slim = scored.select(*query, id_col, F.round(F.col("_new"), 6).alias("rerank_score"))
    return top_k(slim, list(query), [F.desc("rerank_score"), F.asc(id_col)], k)


# -- vectors ----------------------------------------------------------------


def hashing_encoder(text: str = "text", dims: int = 64) -> Scorer:
    """Stand-in encoder: signed feature hashing of words, unit length."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            matrix = np.zeros((len(batch), dims))
            for row, value in enumerate(batch[text]):
                words = (value or "").lower().split()
                codes = np.fromiter(
                    (known.get(w) if w in known else known.setdefault(w, zlib.crc32(w.encode())) for w in words),
                    dtype=np.int64, count=len(words),
                )
                np.add.at(matrix[row], codes % dims, np.where(codes // dims % 2 == 0, 1.0, -1.0))
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            norms[norms == 0] = 1.0
            if len(known) > 1_000_000:
                known.clear()
            yield batch.assign(vector=list((matrix / norms).astype(np.float32)))

    return encode


def embed_batches(
    df: DataFrame, path: str, encoder: Scorer, key: str, text: str = "text", buckets: int = RUN_BUCKETS,
    batch_rows: int | None = None,
) -> DataFrame:
    """Vectors of all rows of ``df`` in the table at ``path``.

    Rows whose key is already stored are skipped, and a run that broke off goes on with
    the first bucket it had not finished. Rows without text get no vector.
    """
    todo = df.select(key, text).where(F.col(text).isNotNull())
    work = lambda rows: apply_scorer(rows, encoder, "vector array<float>", batch_rows).select(key, "vector")
    return run_in_buckets(todo, path, key, work, buckets)


# -- verdicts ---------------------------------------------------------------


def overlap_judge(threshold: float = 0.5) -> Scorer:
    """Stand-in judge: yes when the paragraph has enough of the question's words."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = []
            for question, text in zip(batch["question"], batch["paragraph_text"]):
                asked = set((question or "").lower().split())
                shared = len(asked & set(text.lower().split()))
                yes = bool(asked) and shared >= threshold * len(asked)
                reply = f"shares {shared} of {len(asked)} words" if yes else "N/A"
                replies.append(f"CONTAINS_ANSWER: {'Y' if yes else 'N'}\nANSWER: {reply}")
            yield batch.assign(response=replies)

    return judge


def verify(flat: DataFrame, patents: DataFrame, scorer: Scorer, batch_rows: int | None = None) -> DataFrame:
    """Verdicts for all paragraph rows of ``flat``.

    Verdicts already present are kept without calling the scorer; a paragraph
    without text becomes an N with an error. ``patents`` is (patent_id,
    patent_title, patent_abstract).
    """
    columns = flat.columns
    rows = flat.where(F.col("paragraph_id").isNotNull())
    open_rows = rows.where(F.col("contains_answer").isNull())
    texts = open_rows.where(F.col("paragraph_text").isNotNull())
    asked = texts.drop("contains_answer", "answer", "error").join(patents, "patent_id", "left")
    prompted = asked.withColumn(
        "prompt",
        verdict_prompt(F.col("patent_title"), F.col("patent_abstract"), F.col("question"), F.col("paragraph_text")),
    ).drop("patent_title", "patent_abstract")
    judged = parse_verdicts(apply_scorer(prompted, scorer, "response string", batch_rows)).select(*columns)
    missing = (
        open_rows.where(F.col("paragraph_text").isNull())
        .withColumn("contains_answer", F.lit("N"))
        .withColumn("answer", F.lit(None).cast("string"))
        .withColumn("error", F.lit(MISSING_TEXT))
    )
    done = rows.where(F.col("contains_answer").isNotNull())
    return done.unionByName(missing).unionByName(judged)


def verify_in_buckets(
    flat: DataFrame, patents: DataFrame, scorer: Scorer, path: str, keys: Sequence[str], buckets: int = RUN_BUCKETS,
    batch_rows: int | None = None,
) -> DataFrame:
    """As ``verify``, kept at ``path`` and resumed there after a failure."""
    rows = flat.where(F.col("paragraph_id").isNotNull())
    return run_in_buckets(rows, path, keys, lambda part: verify(part, patents, scorer, batch_rows), buckets)


# -- questions --------------------------------------------------------------


def template_writer(level: str) -> Scorer:
    """Stand-in writer: three questions from the words of the title."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verb = "is" if level == "remembering" else "does one explain"
        for batch in batches:
            replies = []
            for title in batch["patent_title"]:
                words = [w for w in title.split() if w.isalnum()]
                asked = [f'"{n}": "What {verb} {w}?"' for n, w in enumerate(words[:3], start=1)]
                replies.append("{" + ", ".join(asked) + "}")
            yield batch.assign(response=replies)

    return write


def generate(
    patents: DataFrame, done: DataFrame, scorer: Scorer, level: str, attempts: int = 3, expected: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Questions for the patents that have none yet, and the failed responses.

    Patents without title or abstract are left out and each patent is asked
    once. A response without exactly ``expected`` questions is asked again in
    the next attempt; each attempt is a written table, so a scorer that
    answers differently each time is called once per attempt.
    """
    once = (
        patents.where(F.col("patent_title").isNotNull() & F.col("patent_abstract").isNotNull())
        .groupBy("patent_id")
        .agg(F.min_by(F.struct("patent_title", "patent_abstract", "cpc_class"),
                      F.struct("cpc_class", "patent_title", "patent_abstract")).alias("_p"))
        .select("patent_id", "_p.*")
    )
    todo = pending(once, done, "patent_id")
    prompt = question_prompt(F.col("patent_title"), F.col("patent_abstract"), F.lit(level), expected)
    accepted, rejected = [], None
    for attempt in range(attempts):
        asked = todo.withColumn("prompt", prompt)
        replies = stage(apply_scorer(asked, scorer, "response string").drop("prompt"), f"questions-{attempt}")
        good, rejected = parse_questions(replies, expected=expected)
        accepted.append(good)
        todo = rejected.drop("response")
        if rejected.isEmpty():
            break
    questions = accepted[0]
    for more in accepted[1:]:
        questions = questions.unionByName(more)
    return questions.withColumn("level", F.lit(level)), rejected
