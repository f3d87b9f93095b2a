"""Language identification by a convolutional network over bytes.

Bytes are embedded, filters of several widths run over fixed-length windows, each
filter keeps its largest response, and a softmax over these gives the language. The
network is trained in numpy on a bounded, documented sample of labelled rows and then
applied to all windows of every whole text, in batches.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is
every text when nothing can be learned from; a null id counts as held out; rows
without a language are never learned from; each input row gives one output row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from passagekit.llm.common import table
from passagekit.plans.registry import query
from passagekit.scale import broadcast_if_small, hash_sample, stage

UNKNOWN = "und"

#: Fixed value of the result contract: one in so many ids is held out.
FOLDS = 5

WINDOW = 192
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
REACH = max(WIDTHS)

#: Bound of the training sample: languages (those with most documents), documents per
#: language and windows per document.
SAMPLE_LANGUAGES = 500
SAMPLE_DOCS = 300
SAMPLE_WINDOWS = 3
EPOCHS = 8
BATCH = 64
SEED = 7

_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Network:
    """Weights; ``kernel`` holds the filters of all widths, narrow ones padded."""

    languages: tuple[str, ...]
    embedding: np.ndarray  # (256, EMBED); byte 0 is padding and stays 0
    kernel: np.ndarray  # (REACH * EMBED, filters)
    bias: np.ndarray
    dense: np.ndarray  # (filters, languages)
    offset: np.ndarray


def windows_of(data: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text as rows of ``size`` bytes, the last one filled with zeros."""
    count = max(1, -(-len(data) // size))
    out = np.zeros(count * size, np.uint8)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(count, size)


def _patches(net: Network, windows: np.ndarray) -> np.ndarray:
    """Embedded bytes below each filter position: (n, positions, REACH * EMBED)."""
    padded = np.pad(windows, ((0, 0), (0, REACH - 1)))
    embedded = net.embedding[padded].reshape(len(windows), -1)
    view = sliding_window_view(embedded, REACH * EMBED, axis=1)[:, ::EMBED]
    return np.ascontiguousarray(view)


def _pooled(net: Network, patches: np.ndarray) -> np.ndarray:
    return patches.reshape(-1, patches.shape[2]) @ net.kernel


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def probabilities(net: Network, windows: np.ndarray, at_once: int = BATCH) -> np.ndarray:
    """(windows, languages)."""
    out = np.empty((len(windows), len(net.languages)), np.float32)
    for start in range(0, len(windows), at_once):
        patches = _patches(net, windows[start:start + at_once])
        responses = _pooled(net, patches).reshape(len(patches), -1, len(net.bias)).max(axis=1)
        hidden = np.maximum(responses + net.bias, 0)
        out[start:start + at_once] = _softmax(hidden @ net.dense + net.offset)
    return out


def _mask() -> np.ndarray:
    """Which weights each width may use."""
    mask = np.zeros((REACH, EMBED, len(WIDTHS) * FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width, :, i * FILTERS:(i + 1) * FILTERS] = 1
    return mask.reshape(REACH * EMBED, -1)


def train(windows: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit a network by Adam on (n, WINDOW) bytes; deterministic."""
    languages = tuple(sorted(set(labels)))
    target = np.searchsorted(languages, labels)
    rng, mask = np.random.default_rng(seed), _mask()
    filters = mask.shape[1]
    params = {
        "embedding": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "kernel": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        "bias": np.zeros(filters, np.float32),
        "dense": rng.normal(0, 0.2, (filters, len(languages))).astype(np.float32),
        "offset": np.zeros(len(languages), np.float32),
    }
    params["embedding"][0] = 0
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            chosen = order[start:start + BATCH]
            grads = _gradients(Network(languages, **params), windows[chosen], target[chosen], mask)
            step += 1
            for name, grad in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad * grad
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                params[name] = (params[name] - rate * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
            params["embedding"][0] = 0
    return Network(languages, **params)


def _gradients(net: Network, windows: np.ndarray, target: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    count, filters = len(windows), len(net.bias)
    patches = _patches(net, windows)
    responses = _pooled(net, patches).reshape(count, -1, filters)
    best = responses.argmax(axis=1)
    raw = np.take_along_axis(responses, best[:, None], axis=1)[:, 0] + net.bias
    hidden = np.maximum(raw, 0)
    error = _softmax(hidden @ net.dense + net.offset)
    error[np.arange(count), target] -= 1
    error /= count
    back = (error @ net.dense.T) * (raw > 0)
    taken = patches[np.arange(count)[:, None], best]  # (count, filters, REACH * EMBED)
    under = (back[:, :, None] * net.kernel.T[None]).reshape(-1, EMBED)
    padded = np.pad(windows, ((0, 0), (0, REACH - 1)))
    bytes_ = padded[np.arange(count)[:, None, None], best[:, :, None] + np.arange(REACH)]
    embedding = np.zeros_like(net.embedding)
    np.add.at(embedding, bytes_.ravel(), under)
    return {
        "embedding": embedding,
        "kernel": np.einsum("nf,nfk->kf", back, taken) * mask,
        "bias": back.sum(axis=0),
        "dense": hidden.T @ error,
        "offset": error.sum(axis=0),
    }


def held_out(id_col: str | Column, folds: int = FOLDS) -> Column:
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == 0


def sample(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = SAMPLE_DOCS,
    per_document: int = SAMPLE_WINDOWS, languages: int = SAMPLE_LANGUAGES,
) -> tuple[np.ndarray, list[str]]:
    """Windows and labels of at most ``per_language`` documents of each language.

    Of more than ``languages`` languages those with most documents are learned. The
    documents are those with the smallest hash of id and text among the ones that
    have a letter and are not held out; a row that repeats with id, language and text
    counts once. Their windows are spread over the whole text.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    ).where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("print", F.xxhash64("text"))
    # Only narrow rows meet; a repeated row must not use up the sample.
    key = F.concat_ws(":", F.col("id").cast("string"), F.col("print").cast("string")).alias("key")
    ordered = stage(rows.select("id", "lang", "print", key).distinct(), "labelled")
    learned = ordered.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    # At most ``languages`` rows.
    ordered = ordered.join(F.broadcast(learned.select("lang")), "lang", "left_semi")
    chosen = broadcast_if_small(hash_sample(ordered, per_language, "key", "language", ["lang"]).select("id", "lang", "print"))
    texts = rows.join(chosen, ["id", "lang", "print"], "left_semi").dropDuplicates(["id", "lang", "print"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows_ = windows_of(text.encode())
                for i in np.unique(np.linspace(0, len(rows_) - 1, per_document).astype(int)):
                    langs.append(lang)
                    parts.append(rows_[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "window"])

    found = texts.select("lang", "text").mapInArrow(run, "lang string, window binary").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.window)))
    data = np.frombuffer(b"".join(bytes(r.window) for r in found), np.uint8).reshape(-1, WINDOW)
    return data, [r.lang for r in found]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> Network | None:
    """A network from the labelled rows of ``docs``; None if there are none."""
    windows, labels = sample(docs, id_col, text_col, lang_col, **bounds)
    return train(windows, labels) if labels else None


def predict(net: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and mean probability over all windows of each whole text."""
    known = [i for i, t in enumerate(texts) if net is not None and t is not None and _LETTER.search(t)]
    out = [(UNKNOWN, 0.0)] * len(texts)
    if not known:
        return out
    parts = [windows_of(texts[i].encode()) for i in known]
    sizes = np.array([len(p) for p in parts])
    found = probabilities(net, np.concatenate(parts))
    means = np.add.reduceat(found.astype(np.float64), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
    for i, row in zip(known, means):
        best = int(row.argmax())
        out[i] = (net.languages[best], float(min(1.0, max(0.0, row[best]))))
    return out


def identify(docs: DataFrame, net: Network | None, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out``: lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    source = docs.drop(out)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*source.schema, T.StructField(out, kind)])
    at = source.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            # A few texts at a time bound the windows held, whatever their length.
            for start in range(0, batch.num_rows, 64):
                found += predict(shared.value, batch.column(at).slice(start, 64).to_pylist())
            made = pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["lang_pred", "score"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [f.name for f in schema])

    return source.mapInArrow(run, schema)


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select(
        "doc_id", held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score"
    )
