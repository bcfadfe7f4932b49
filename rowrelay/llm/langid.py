"""Language identification: averaged hashed subword embeddings and a linear softmax.

A document is the mean of the embeddings of its byte n-grams (2 to 4 bytes of the lower-cased text,
letters only, white space and all else as one separator), each hashed to one of ``BUCKETS`` rows. The
embeddings and the softmax above them are trained together by stochastic gradient descent in numpy,
on a bounded sample: about ``SAMPLE`` labelled documents, as many of each language and ``LEAST_OF_EACH`` at
least where there are as many, the first in the order of a hash of text. Temperature and rejection level are fitted on a part of the sample that
training has not seen. Prediction is a narrow pass over whole texts; nothing is shuffled.

Defined results: NULL text and text without a letter give ``und`` with score 0; documents with NULL
language are predicted but never learned from; an empty training set predicts ``und`` everywhere.
Equal texts get equal results, whatever their number. Every language is learned; more than
``MOST_LANGUAGES`` values of ``lang`` are refused, as the sample cannot hold them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowrelay.llm.common import map_batches, slices

BUCKETS = 1 << 13
SAMPLE = 1_024  # documents to learn from; one task holds 4 * BUCKETS bytes for each
LEAST_OF_EACH = 4
MOST_LANGUAGES = 1_024
SIZES = (2, 3, 4)
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def bucket_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the n-grams of a text; zeros without a letter."""
    plain = OTHER.sub(" ", text.lower()).strip()
    if not plain:
        return np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(f" {plain} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    gram = data
    for size in range(2, max(SIZES) + 1):
        gram = gram[:-1] * np.uint32(0x01000193) ^ data[size - 1 :]
        mixed = (gram ^ np.uint32(size)) * np.uint32(0x9E3779B1)
        total += np.bincount(mixed >> np.uint32(32 - 13), minlength=BUCKETS)
    return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (buckets, languages): embeddings times the softmax layer
    bias: np.ndarray
    temperature: float
    reject_below: float  # calibrated score under which a document is rejected

    def scores(self, counts: np.ndarray) -> np.ndarray:
        z = (counts @ self.weights / max(1, counts.sum()) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(counts: np.ndarray, labels: list[str], dim: int = 16, epochs: int = 60, rate: float = 2.0, seed: int = 7, rejected: float = 0.001) -> Model:
    """Fit on rows of bucket counts (float32 ones are used up). Every fifth row calibrates instead of training."""
    languages = tuple(sorted(set(labels)))
    y = np.array([languages.index(x) for x in labels])
    x = np.asarray(counts, np.float32)
    x /= np.maximum(1, x.sum(axis=1, keepdims=True))  # in place: the caller's copy is not needed again
    rng = np.random.default_rng(seed)
    calibrate = np.arange(len(y)) % 5 == 4 if len(y) >= 20 else np.zeros(len(y), bool)
    calibrate &= np.isin(y, y[~calibrate])  # every language has a row to learn from
    rows = np.flatnonzero(~calibrate)
    embed = rng.normal(0, 1, (BUCKETS, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages))
    share = np.bincount(y[rows], minlength=len(languages)) / len(rows)
    weight = 1 / np.maximum(share, 1e-9)[y] / len(languages)  # languages count alike
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(rows), max(1, len(rows) // 64)):
            hidden = x[batch] @ embed
            off = _softmax(hidden @ layer + bias)
            off[np.arange(len(batch)), y[batch]] -= 1
            off *= weight[batch, None] / len(batch)
            back = off @ layer.T
            layer -= step * (hidden.T @ off)
            bias -= step * off.sum(axis=0)
            # A document is spread over many buckets: each embedding gets its share, scaled up.
            embed -= step * 100 * (x[batch].T @ back)
    weights = embed @ layer
    logits = x @ weights + bias
    held = np.flatnonzero(calibrate) if calibrate.any() else rows

    def loss(temperature: float) -> float:
        p = _softmax(logits[held] / temperature)[np.arange(len(held)), y[held]]
        return float(-np.log(np.maximum(p, 1e-12)).mean()) + 1e-4 * abs(np.log(temperature))

    temperature = min(np.geomspace(0.1, 10, 81), key=loss)
    best = _softmax(logits[held] / temperature).max(axis=1)
    # Rejection: what scores below all but a small share of labelled text and is hardly better than a draw.
    level = min(0.5, 1.5 / len(languages), float(np.quantile(best, rejected)))
    return Model(languages, weights, bias, float(temperature), level)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        packed = [bucket_counts(t).astype("<u4").tobytes() for t in part.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(1), pa.array(packed, pa.binary())], names=["lang", "counts"])


def _trained(sample: pa.Table) -> pa.Table:
    rows = sorted(zip(sample.column("lang").to_pylist(), sample.column("counts").to_pylist(), strict=True))
    shuffled = np.random.default_rng(3).permutation(len(rows)).tolist()
    counts = np.empty((len(rows), BUCKETS), np.float32)
    for place, i in enumerate(shuffled):
        counts[place] = np.frombuffer(rows[i][1], "<u4")
    return pa.table({"model": pa.array([pickle.dumps(train(counts, [rows[i][0] for i in shuffled]))], pa.binary())})


def fit(docs: DataFrame, usable: Column, sample_rows: int = SAMPLE, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """Learn from the rows where ``usable`` holds; None when there is nothing to learn from.

    A task gets about ``sample_rows`` rows of ``4 * BUCKETS`` bytes, or ``LEAST_OF_EACH`` for each language if that is more.
    """
    labelled = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.xxhash64("text")
    n_languages = labelled.select("lang").distinct().limit(most_languages + 1).count()
    if not n_languages:
        return None
    if n_languages > most_languages:
        raise ValueError(f"lang has more than {most_languages} values, too many for a sample on the driver")
    per_language = max(LEAST_OF_EACH, sample_rows // n_languages)
    # Narrow rows first: the sample is the hashes below each language's bound, then texts are read once.
    ranked = labelled.select("lang", order.alias("_order"))
    # In two steps, so that the last one gets a bounded number of rows whatever the number of tasks.
    for parts in (["lang", F.pmod("_order", F.lit(16))], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*parts).orderBy("_order"))
        ranked = ranked.withColumn("_place", place).filter(F.col("_place") <= per_language).drop("_place")
    bounds = ranked.groupBy("lang").agg(F.max("_order").alias("_bound"))
    # A table of one row for each language.
    limits = docs.sparkSession.createDataFrame([tuple(r) for r in bounds.collect()], "lang string, _bound bigint")
    inside = labelled.join(F.broadcast(limits), "lang").filter(order <= F.col("_bound"))
    # Equal texts have equal order and count once, so a bound admits about per_language distinct texts.
    sample = inside.groupBy("lang", order.alias("_order")).agg(F.min("text").alias("text"))
    counted = map_batches(sample.select("text", "lang"), _counted, "lang string, counts binary")
    # One task has the sample, which is bounded; the driver gets the model only.
    return pickle.loads(counted.groupBy().applyInArrow(_trained, "model binary").first()["model"])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, lang_pred, score, rejected) of every row: ``row`` has all columns of ``docs``."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("_text"))
    kind = packed.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            found, scores = [], []
            for text in part.column(1).to_pylist():
                if model is None or not text or not LETTER.search(text):
                    found.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    p = model.scores(bucket_counts(text))
                    found.append(model.languages[int(p.argmax())])
                    scores.append(min(1.0, float(p.max())))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"])

    level = 2.0 if model is None else model.reject_below
    out = map_batches(packed, run, f"row {kind}, lang_pred string, score double")
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < F.lit(level)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept from training: crc32 of the id as text leaves 2 when divided by 4. No id: not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from the others."""
    narrow = docs.select("doc_id", "text", "lang")
    model = fit(narrow, ~held_out())
    return predict(narrow.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "lang_pred", "score"
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with all their columns."""
    model = fit(docs.select("doc_id", "text", "lang"), ~held_out())
    return predict(docs, model).filter(~F.col("rejected")).select("row.*")
