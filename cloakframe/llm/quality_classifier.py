"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (poor), 1 (good but toxic) and 2 (good).  One weight vector over hashed text features is
shared by all grades, and ordered thresholds cut its score: P(grade <= k) = sigmoid(cut_k - w.x).  The
model gives each document its expected grade and the tail probability P(grade >= 1), by which documents
are selected.

Features of a text: roots of the shares of its words by hashed word, by hashed first three and last three bytes, each
in its own range of ``buckets``, and a few dense measures (length, distinct words, repeated neighbours,
symbols, upper case, digits, repeated lines).

The model is fitted on at most ``max_rated`` rated documents of at most ``max_bytes`` of text together (those
with the least hashes of their ids; a text of over ``max_bytes`` is never among them), so what reaches the driver has a fixed
bound: no more entries than three for each two bytes; scoring is a map over the whole table, without a shuffle.

Defined results: null, empty and blank texts have only the dense features of an empty text; ratings
without a quality are not used, a missing toxic rating counts as 0; a table without usable ratings, or
with one grade alone, gives the smoothed shares of the grades for every document; repeated rows get
equal results; an empty table gives an empty result; extra columns pass through (outputs replace columns
of the same name, working columns get free names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .storage import scratch

GRADES = 3
DENSE = 19
OUTPUTS = ("expected_grade", "tail_probability", "selected")


@dataclass(frozen=True)
class QualityClassifier:
    buckets: int = 1 << 14
    max_rated: int = 8000
    max_bytes: int = 32 << 20
    steps: int = 400
    rate: float = 1.0
    ridge: float = 1e-5
    select_at: float = 0.5


@dataclass
class Features:
    """Sparse rows: bucket and value of each entry, entry offsets by row, and the dense measures."""

    index: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    dense: np.ndarray


def _shares(row: np.ndarray, n: int, flags: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.bincount(row[flags], minlength=n) / np.maximum(total, 1)


def features(texts: pa.Array, p: QualityClassifier) -> Features:
    w = W.split(texts)
    n, m = len(texts), len(w.start)
    counts, row = w.counts(), w.row_of()
    h = w.hashes()
    size = w.end - w.start
    runs = W.Ranges(W.lane(3)[w.data])
    reach = np.minimum(size, 3)
    head, tail = runs.of(w.start, w.start + reach), runs.of(w.end - reach, w.end)
    mask = np.uint64(p.buckets - 1)
    index = np.concatenate([(x & mask).astype(np.int64) + k * p.buckets for k, x in enumerate((h, head, tail))]) if m else np.empty(0, dtype=np.int64)
    rows3 = np.tile(row, 3)
    key, n_of = np.unique(rows3 * (3 * p.buckets) + index, return_counts=True)
    erow = key // (3 * p.buckets)
    value = np.sqrt(n_of / np.maximum(counts, 1)[erow])
    distinct = _distinct(row, h, n)
    same = np.zeros(m, dtype=bool)
    if m:
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    last = w.data[w.end - 1] if m else np.empty(0, dtype=np.uint8)
    symbol = np.isin(last, np.frombuffer(b"#*$%&|<>!", dtype=np.uint8))
    initial = w.data[w.start] if m else last
    upper = (last >= 65) & (last <= 90)
    digit = (initial >= 48) & (initial <= 57)
    lines, repeated = _lines(texts)
    same_share, symbols = _shares(row, n, same, counts), _shares(row, n, symbol, counts)
    variety, doubled = distinct / np.maximum(counts, 1), repeated / np.maximum(lines, 1)
    dense = np.stack(
        [
            np.ones(n), np.log1p(counts) / 8, counts == 0, counts < 10, counts < 20, counts < 50,
            variety, variety < 0.5, variety < 0.2, variety < 0.05, same_share, same_share > 0.1, same_share > 0.3,
            symbols, symbols > 0.05, symbols > 0.2, doubled, doubled > 0.2, _shares(row, n, upper, counts) + _shares(row, n, digit, counts),
        ],
        axis=1,
    )
    return Features(key % (3 * p.buckets), value, np.searchsorted(erow, np.arange(n + 1)), dense.astype(np.float64))


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct word hashes of each row."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1])] if len(r) else np.empty(0, dtype=bool)
    return np.bincount(r[new], minlength=n)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and how many of them equal an earlier one."""
    data, off = W.raw(texts)
    ends = np.flatnonzero(data == 10)
    cut = np.unique(np.r_[ends + 1, off])
    start, end = cut[:-1], cut[1:]
    row = np.searchsorted(off, start, side="right") - 1
    long = end - start > 1
    start, end, row = start[long], end[long], row[long]
    h = W.Ranges(W.lane(5)[data]).of(start, end - (data[end - 1] == 10)) if len(start) else np.empty(0, dtype=np.uint64)
    lines = np.bincount(row, minlength=len(texts))
    return lines, lines - _distinct(row, h, len(texts))


@dataclass
class Model:
    weights: np.ndarray
    dense: np.ndarray
    cuts: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def linear(f: Features, model: Model) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(f.value * model.weights[f.index])]
    return total[f.rows[1:]] - total[f.rows[:-1]] + f.dense @ model.dense


def grade_chances(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    below = np.c_[np.zeros(len(score)), sigmoid(cuts[None, :] - score[:, None]), np.ones(len(score))]
    return np.diff(below, axis=1)


def fit(f: Features, grade: np.ndarray, p: QualityClassifier) -> Model:
    """Accelerated full-batch gradient descent on the ridge-penalised likelihood, with a restart whenever
    the likelihood falls.  The thresholds are the first one and the logarithms of the gaps, so they stay
    ordered."""
    size = 3 * p.buckets
    share = (np.bincount(grade, minlength=GRADES) + 0.5) / (len(grade) + 0.5 * GRADES)
    base = np.cumsum(share)[:-1]
    cuts = np.log(base / (1 - base))
    model = Model(np.zeros(size), np.zeros(DENSE), cuts)
    if len(np.unique(grade)) < 2:
        return model
    free = np.r_[np.zeros(size + DENSE), cuts[0], np.log(np.diff(cuts))]
    norm = np.bincount(_row_of(f), weights=f.value**2, minlength=len(grade)) + (f.dense**2).sum(1)
    step = p.rate / (0.25 * norm.max() + 0.25 + p.ridge)
    ahead, last, momentum = free.copy(), np.inf, 1.0
    for _ in range(p.steps):
        loss, grad = loss_and_gradient(ahead, f, grade, p)
        momentum = 1.0 if loss > last else momentum
        last = loss
        new, grown = ahead - step * grad, (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, free, momentum = new + (momentum - 1) / grown * (new - free), new, grown
    return unpack(free, size)


def _row_of(f: Features) -> np.ndarray:
    return np.repeat(np.arange(len(f.rows) - 1), np.diff(f.rows))


def unpack(x: np.ndarray, size: int) -> Model:
    """The model of a parameter vector: weights, dense weights, first threshold, logarithms of the gaps."""
    return Model(x[:size], x[size : size + DENSE], x[size + DENSE] + np.r_[0, np.cumsum(np.exp(x[size + DENSE + 1 :]))])


def loss_and_gradient(x: np.ndarray, f: Features, grade: np.ndarray, p: QualityClassifier) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with the ridge penalty, and its gradient."""
    size = 3 * p.buckets
    model = unpack(x, size)
    score = linear(f, model)
    below = np.c_[np.zeros(len(score)), sigmoid(model.cuts[None, :] - score[:, None]), np.ones(len(score))]
    slope = below * (1 - below)
    each = np.arange(len(grade))
    chance = np.maximum(below[each, grade + 1] - below[each, grade], 1e-12)
    dscore = (slope[each, grade + 1] - slope[each, grade]) / chance / len(grade)
    dcut = np.array([(-(slope[:, k + 1] / chance)[grade == k].sum() + (slope[:, k + 1] / chance)[grade == k + 1].sum()) / len(grade) for k in range(GRADES - 1)])
    gaps = np.exp(x[size + DENSE + 1 :])
    grad = np.r_[
        np.bincount(f.index, weights=f.value * dscore[_row_of(f)], minlength=size) + p.ridge * x[:size],
        f.dense.T @ dscore, dcut.sum(), gaps * np.cumsum(dcut[::-1])[::-1][1:],
    ]
    return -np.log(chance).mean() + 0.5 * p.ridge * (x[:size] ** 2).sum(), grad


def _rated(batches: Iterator[pa.RecordBatch], p: QualityClassifier) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in W.chunks(batch):
            f = features(texts, p)
            off = pa.array(f.rows.astype(np.int32))
            dense = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * DENSE), pa.array(f.dense.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("grade"), pa.ListArray.from_arrays(off, pa.array(f.index.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(f.value)), dense],
                names=["id", "grade", "index", "value", "dense"],
            )


def train(docs: DataFrame, labels: DataFrame, p: QualityClassifier = QualityClassifier(), id_col: str = "doc_id", text: str = "text") -> Model:
    good = F.col("quality") >= 1
    grade = F.when(~good, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) >= 1, 1).otherwise(2)
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max(grade).cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rated).withColumnRenamed("doc_id", "id")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = dict(slim.dtypes)["id"]
    sample = slim.join(F.broadcast(rated), "id").select("id", "grade", "text")
    # at most max_rated numbers: the longest prefix, in the order of the hashes, that fits
    sizes = sample.select("id", F.xxhash64("id", "text").alias("fp"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    sizes = sizes.where(F.col("size") <= p.max_bytes).orderBy(F.xxhash64("id"), "fp").limit(p.max_rated)
    whole = Window.orderBy(F.xxhash64("id"), "fp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = sizes.withColumn("total", F.sum("size").over(whole)).where(F.col("total") <= p.max_bytes).select("id", "fp").distinct()
    sample = sample.withColumn("fp", F.xxhash64("id", "text")).join(F.broadcast(fits), ["id", "fp"], "left_semi").select("id", "grade", "text").limit(p.max_rated)
    rows = sample.mapInArrow(partial(_rated, p=p), f"id {kind}, grade int, index array<int>, value array<double>, dense array<double>")
    got = rows.toArrow().sort_by("id").combine_chunks()
    if not got.num_rows:
        return fit(Features(np.empty(0, dtype=np.int64), np.empty(0), np.zeros(1, dtype=np.int64), np.empty((0, DENSE))), np.empty(0, dtype=np.int64), p)
    index, value, dense = (got.column(k).combine_chunks() for k in ("index", "value", "dense"))
    off = np.r_[0, np.cumsum(pa.compute.list_value_length(index).to_numpy())]
    f = Features(index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(), off, dense.flatten().to_numpy().reshape(-1, DENSE))
    return fit(f, got.column("grade").to_numpy().astype(np.int64), p)


def _score(batches: Iterator[pa.RecordBatch], model: Model, p: QualityClassifier, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in W.chunks(batch, text):
            chance = grade_chances(linear(features(texts, p), model), model.cuts)
            tail = 1 - chance[:, 0]
            have = {k: part.column(k) for k in part.schema.names if k != text}
            yield pa.RecordBatch.from_pydict(have | {"expected_grade": pa.array(chance @ np.arange(GRADES)), "tail_probability": pa.array(tail), "selected": pa.array(tail >= p.select_at)})


def classify(docs: DataFrame, model: Model, p: QualityClassifier = QualityClassifier(), text: str = "text") -> DataFrame:
    """``docs`` without its text, with expected_grade, tail_probability and selected."""
    (raw,) = scratch(docs, "text")
    base = docs.withColumn(raw, F.col(f"`{text}`")).drop(text)
    base = base.drop(*[c for c in base.columns if c.lower() in OUTPUTS])
    keep = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.drop(raw).schema)
    return base.mapInArrow(partial(_score, model=model, p=p, text=raw), f"{keep}expected_grade double, tail_probability double, selected boolean")
