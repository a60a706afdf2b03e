"""Toxicity scores from a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a text and their leading 5 and 6 letters, hashed. A factorization machine
gives each term a weight and a short vector; a text's logit is the sum of its weights plus the dot products of all pairs
of its vectors, so that a pair (an insult and a group mention) can count where neither does alone. It is trained on a
sample of labelled rows of at most about ``Limits.rows``; the terms it uses are those that the sample ties most to the
label, by the G2 statistic. The model is a few hundred kilobytes whatever the corpus; every row's whole text is scored.

Defined cases: a null text counts as empty and scores as the bias says; a label that is null is no label; of repeated
labels of an id the highest counts; without labels of both kinds every score is the share of toxic labels (0 if none).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelode.llm.common import checkpoint, give_back

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 22
THRESHOLD = 0.3


@dataclass(frozen=True)
class Limits:
    """Bounds of the training: labelled rows (expected), terms kept and their G2 at least (chance gives 24 once in a
    million terms, and long texts have many), factors, passes and steps at least."""

    rows: int = 16_000
    terms: int = 1024
    least_g2: float = 24.0
    factors: int = 8
    epochs: int = 40
    steps: int = 1500


class _Terms(dict):
    """Word to its hashed terms; forgets everything at a bound, so a task's memory is bounded too."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        data = [word] + [word[:k] + "^" for k in (5, 6) if len(word) > k]
        self[word] = found = tuple(zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in data)
        return found


def terms_of(text: str | None, known: _Terms) -> set[int]:
    found: set[int] = set()
    for word in set(WORD.findall((text or "").lower())):
        found.update(known[word])
    return found


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted buckets
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of rows of a 0/1 matrix over ``terms``."""
        sums = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * ((sums**2).sum(axis=1) - x @ (self.factors**2).sum(axis=1))


class Scorer:
    """A model with the terms that a worker has met."""

    def __init__(self, model: FactorizationMachine):
        self.model, self.known = model, _Terms()
        self.place = {int(t): i for i, t in enumerate(model.terms)}

    def score(self, text: str | None) -> float:
        at = sorted(self.place[t] for t in terms_of(text, self.known) if t in self.place)
        part = self.model.factors[at].astype(np.float64)
        sums = part.sum(axis=0)
        logit = self.model.bias + float(self.model.weights[at].sum()) + 0.5 * float((sums**2).sum() - (part**2).sum())
        return 1 / (1 + math.exp(-min(max(logit, -30.0), 30.0)))


def fit(x: np.ndarray, y: np.ndarray, terms: np.ndarray, limits: Limits, seed: int = 7) -> FactorizationMachine:
    """Logistic loss, Adam, weight decay; the same rows give the same model."""
    rate = float(y.mean()) if len(y) else 0.0
    rng = np.random.default_rng(seed)
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    model = FactorizationMachine(
        terms, float(np.log(rate / (1 - rate))), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.05, (x.shape[1], limits.factors)).astype(np.float32)
    )
    if not x.shape[1] or y.min() == y.max():
        return model
    params = [np.array([model.bias], np.float32), model.weights, model.factors]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(max(limits.epochs, -(-limits.steps // -(-len(y) // 256)))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            rows = order[at : at + 256]
            part = x[rows].astype(np.float32)
            model.bias = float(params[0][0])
            sums = part @ model.factors
            logit = model.bias + part @ model.weights + 0.5 * ((sums**2).sum(axis=1) - part @ (model.factors**2).sum(axis=1))
            err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            pull = part.T @ err
            grads = [np.array([err.sum()]), pull + 1e-4 * model.weights, part.T @ (err[:, None] * sums) - pull[:, None] * model.factors + 1e-3 * model.factors]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.bias = float(params[0][0])
    return model


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Fit on rows of ``labels`` (``id_col``, ``label_col``) that have a text in ``docs``.

    The sample of ids is of bounded size and is broadcast; texts are turned into terms where they lie.
    """
    marked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("__id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    )
    share = min(1.0, limits.rows / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms()
        for batch in batches:
            found = [sorted(terms_of(t.as_py(), known)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["y", "terms"])

    rows = checkpoint(
        docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
        .join(F.broadcast(chosen), "__id")
        .select("__y", "__text")
        .mapInArrow(extract, "y int, terms array<int>")
    )
    n1, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    by_term = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("t"))

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n0, n1 = n - n1, int(n1)
    a, t = F.col("a"), F.col("t")
    g2 = 2 * (cell(a, t * (n1 / max(n, 1))) + cell(t - a, t * (n0 / max(n, 1))) + cell(n1 - a, (n - t) * (n1 / max(n, 1))) + cell(n0 - (t - a), (n - t) * (n0 / max(n, 1))))
    best = by_term.where((t >= 3) & (t < n) & (g2 >= limits.least_g2)).orderBy(F.desc(g2), "term").limit(limits.terms).select("term") if n1 and n0 else by_term.limit(0).select("term")
    terms = np.sort(np.array([r[0] for r in best.collect()], dtype=np.int32))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.flatnonzero(np.isin(terms, np.asarray(x.values), kind="sort")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["y", "at"])

    sample = rows.mapInArrow(keep, "y int, at array<int>").toArrow()
    order = sorted(zip(sample["y"].to_pylist(), sample["at"].to_pylist()))  # the same whatever the partitions
    x = np.zeros((len(order), len(terms)), np.uint8)
    for i, (_, at) in enumerate(order):
        x[i, at] = 1
    return fit(x, np.array([y for y, _ in order], np.float32), terms, limits)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``score`` in 0 to 1, ``predicted`` (score at least ``THRESHOLD``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = np.array([scorer.score(t.as_py()) for t in batch.column(1)], np.float64)
            predicted = pa.array((scores >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), predicted], ["doc_id", "score", "predicted"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(scored, "doc_id long, score double, predicted int").withColumnRenamed("doc_id", id_col)


def keep_clean(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``THRESHOLD``; each is judged where it lies, by no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(place).cast(pa.string())
            yield batch.filter(pa.array([scorer.score(t.as_py()) < THRESHOLD for t in texts], pa.bool_()))
        del scorer
        give_back()

    return docs.mapInArrow(clean, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Train on the labels that aren't held out, score all of ``docs``: doc_id, held_out, score, predicted."""
    model = train(docs, labels.where(~is_held_out()), limits)
    return score(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
