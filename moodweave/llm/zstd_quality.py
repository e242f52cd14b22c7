"""Quality classifier from compression.

Two zstandard dictionaries are trained, one from good and one from bad
labelled texts.  A text's evidence is the normalised difference of its sizes
compressed with either, (bad - good) / max(bad, good).  A logistic calibration
turns it into the probability of label 1; its covariates are the text's plain
compression ratio and the log of its length, which tell a small difference of
a repetitive or short text from one of ordinary prose.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled rows per
class, in order of a hash of their id, of texts of at most ``SAMPLE_BYTES``
bytes; half of them train the dictionaries, half the calibration.  Every whole
text is scored.

Defined results: null and empty texts get the calibrated prior (the score of
no evidence); labels that are null are not used; with labels of one class or
none the score is their smoothed share; repeated and null ids are scored like
any other row; extra columns are ignored; an empty table gives no scores.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 3_000
SAMPLE_BYTES = 64_000
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3


class Model(NamedTuple):
    good: bytes | None          # trained dictionary, or raw content where samples are too few
    bad: bytes | None
    mean: tuple
    scale: tuple
    weights: tuple              # intercept first
    prior: float


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; with too few samples to train, their raw content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes | None):
    options = {"level": LEVEL, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
    if dictionary is None:
        return zstandard.ZstdCompressor(**options)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, **options)


class Evidence:
    """Evidence and covariates of texts under a pair of dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.plain = _compressor(good), _compressor(bad), _compressor(None)

    def __call__(self, text: bytes) -> tuple[float, float, float]:
        a, b = len(self.good.compress(text)), len(self.bad.compress(text))
        return (b - a) / max(a, b), len(self.plain.compress(text)) / len(text), float(np.log1p(len(text)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the first column of ``x`` is the intercept."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(good: list[bytes], bad: list[bytes], n_good: int, n_bad: int) -> Model:
    """Model from sampled texts; ``n_good`` and ``n_bad`` are the class sizes they stand for."""
    prior = (n_good + 1) / (n_good + n_bad + 2)
    good, bad = [t for t in good if t], [t for t in bad if t]
    if len(good) < 2 or len(bad) < 2:
        return Model(None, None, (), (), (), prior)
    d_good, d_bad = build_dictionary(good[::2]), build_dictionary(bad[::2])
    seen = set(good[::2]) | set(bad[::2])
    held = [[t for t in part[1::2] if t not in seen] or part[1::2] for part in (good, bad)]
    evidence = Evidence(d_good, d_bad)
    x = np.array([evidence(t) for part in held for t in part])
    y = np.repeat([1.0, 0.0], [len(held[0]), len(held[1])])
    weight = np.where(y == 1, n_good / len(held[0]), n_bad / len(held[1])) * len(y) / (n_good + n_bad)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    beta = fit_logistic(np.column_stack([np.ones(len(x)), (x - mean) / scale]), y, weight)
    return Model(d_good, d_bad, tuple(mean), tuple(scale), tuple(beta), prior)


def train(docs: DataFrame, labels: DataFrame, usable=None, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of labelled rows; ``usable`` is a condition on the labels' columns."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (F.lit(True) if usable is None else usable)) \
        .select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    parts = [rows.where(F.col("label") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")) \
        .where(F.octet_length("text") <= SAMPLE_BYTES)
    # at most 2 * sample ids, and of each the text with the smallest hash, however many rows repeat it
    chosen = texts.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").groupBy("doc_id", "label") \
        .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    got = chosen.select(order.alias("o"), "doc_id", "label", F.encode("t.text", "utf-8").alias("raw")).collect()
    got.sort(key=lambda r: (r["o"], r["doc_id"], bytes(r["raw"])))
    by = {k: [bytes(r["raw"]) for r in got if r["label"] == k] for k in (0, 1)}
    return fit(by[1], by[0], size.get(1, 0), size.get(0, 0))


def _scorer(model: Model):
    def run(batches):
        mean, scale, beta = np.array(model.mean), np.array(model.scale), np.array(model.weights)
        evidence = Evidence(model.good, model.bad) if model.weights else None
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            score = np.full(len(texts), model.prior)
            if evidence:
                at = [k for k, t in enumerate(texts) if t]
                if at:
                    x = (np.array([evidence(texts[k]) for k in at]) - mean) / scale
                    score[at] = 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scorer(model), "doc_id long, score double")
