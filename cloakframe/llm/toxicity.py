"""Toxicity by noisy-channel deobfuscation and hashed-word scoring.

Restoring.  A token that mixes letters with look-alike digits or symbols, repeats a letter three times or
more, or is spelled out in single letters, is read through a lattice of characters: a look-alike may be
each of the letters it stands for, a repeated letter may be dropped, a separator may be nothing or a word
boundary.  The Viterbi path under a trigram character model gives the restored words.  The character
model is counted over the words of every document.

Scoring.  Words (the text's and the restored ones) and their prefixes are hashed; each bucket has a
shrunken log odds of occurring in toxic rather than clean documents.  A document is summed up over all
its different weighty words, however many, and a logistic regression on that gives the score.  The log odds are fitted in two
folds, each summing up the other's documents for the regression.

Labels are read for at most ``max_labelled`` documents (those with the least hashes of their ids), none
of them held out; a document is held out if crc32 of its id as text leaves 2 on division by 4.  Neither
labels nor language, source or id enter a score.  What reaches the driver is bounded: the character
counts by the alphabet's cube, the word counts by the buckets, the regression by the sample.

Defined results: null, empty and blank texts have no words and get the score of a text without weighty
words; missing labels are not used; without labels of both kinds every score is the smoothed share of
toxic ones; repeated rows get equal scores; a label given twice counts as its maximum; an empty table
gives an empty result; extra columns pass through (outputs replace columns of the same name, working columns get free names).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import scratch

OUTPUTS = ("held_out", "score", "predicted")
CLASSES = 64
#: What a character may stand for (fixed values).
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
SEPARATORS = "._- */,"
SUMMARY = 7


@dataclass(frozen=True)
class Toxicity:
    buckets: int = 1 << 17
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    max_labelled: int = 20_000
    shrink: float = 5.0
    predict_at: float = 0.3
    swap_cost: float = 0.7
    drop_cost: float = 0.7
    split_cost: float = 2.0
    cache: int = 100_000


def _class_table() -> np.ndarray:
    """Classes of the plain bytes: 0 separates; letters, digits; the rest by their low bits."""
    t = np.zeros(256, dtype=np.int64)
    t[97:123] = np.arange(1, 27)
    t[48:58] = np.arange(27, 37)
    t[128:] = 38 + (np.arange(128) & 63) % 26
    return t


CLASS = _class_table()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, dtype=np.int64)
    for batch in batches:
        for _, texts in W.chunks(batch):
            data, off = W.raw(texts)
            low, solid = W.plain(data)
            c = np.where(solid, CLASS[low], 0)
            c = np.insert(c, np.repeat(off, 2), 0)  # two boundaries around every text
            total += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
    total[0] = 0
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(c | a, b) as an array over three classes, counted over all texts."""
    slim = docs.select(F.col(f"`{text}`").alias("text"))
    got = slim.mapInArrow(_counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n3 = np.zeros(CLASSES**3)
    n3[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    n3 = n3.reshape(CLASSES, CLASSES, CLASSES)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 0.5) / (n1.sum() + 0.5 * CLASSES)
    p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
    return np.log((n3 + 2 * p2[None]) / (n3.sum(2, keepdims=True) + 2)).astype(np.float32)


SOLID = re.compile(r"[a-z0-9@$!|(*+\x80-\U0010ffff]")
LAST = re.compile(r"[a-z0-9@$\x80-\U0010ffff]")
LETTER = re.compile(r"[a-z\x80-\U0010ffff]")
ODD = re.compile(r"[0-9@$!|+(*]")
THRICE = re.compile(r"([a-z])\1\1")
INNER = re.compile(r"[a-z0-9@$\x80-\U0010ffff][._\- */,]+[a-z0-9@$\x80-\U0010ffff]")


def core_of(token: str) -> str:
    """The token in lower case without punctuation around it."""
    token = token.lower()
    first = SOLID.search(token)
    if not first:
        return ""
    end = len(token)
    while not LAST.match(token[end - 1]) and end - 1 > first.start():
        end -= 1
    return token[first.start() : end]


def one_of(token: str) -> str:
    """The letter or look-alike of a token that has one."""
    found = LAST.search(token.lower())
    return found[0] if found else token


def noisy(token: str) -> str | None:
    """The token's core if it looks obfuscated.  The time is linear in its length."""
    core = core_of(token)
    if len(core) < 3 or not LETTER.search(core):
        return None
    return core if ODD.search(core) or THRICE.search(core) or INNER.search(core) else None


def restore(core: str, model: np.ndarray, p: Toxicity) -> list[str]:
    """The words on the best path through the token's lattice.  Paths are chains of shared cells, so time
    and memory are linear in the token's length."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i, ch in enumerate(core):
        moves: list[tuple[str, float]] = [(x, p.swap_cost) for x in LOOKALIKES.get(ch, "")]
        if ch in SEPARATORS:
            moves += [("", 0.0), (" ", p.split_cost)]
        elif ch.isalnum():
            moves.append((ch, 0.0 if not ch.isdigit() else p.swap_cost))
        elif not moves:
            moves = [(" ", 0.0)]
        if ch.isalpha() and core[max(0, i - 2) : i + 3].count(ch) >= 3 and i and core[i - 1] == ch:
            moves.append(("", p.drop_cost))
        steps = [(out, cost, [int(CLASS[byte]) for byte in out.encode()]) for out, cost in moves]
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            for out, cost, classes in steps:
                s, x, y = score - cost, a, b
                for c in classes:
                    s += float(model[x, y, c])
                    x, y = y, c
                if (x, y) not in after or after[x, y][0] < s:
                    after[x, y] = (s, (path, out) if out else path)
        best = after
    path = max(((s + float(model[a, b, 0]) + float(model[b, 0, 0] if b else 0.0), path) for (a, b), (s, path) in best.items()), key=lambda x: x[0])[1]
    pieces = []
    while path is not None:
        path, out = path
        pieces.append(out)
    return "".join(reversed(pieces)).split()


class Restorer:
    """Restored words of the noisy tokens of a chunk; remembers a bounded number of tokens."""

    def __init__(self, model: np.ndarray, p: Toxicity):
        self.model, self.p, self.known = model, p, {}
        self.odd = np.zeros(256, dtype=bool)
        self.odd[np.frombuffer(b"0123456789@$!|+(*", dtype=np.uint8)] = True
        self.letter = np.zeros(256, dtype=bool)
        self.letter[65:91] = self.letter[97:123] = self.letter[128:] = True

        self.head = self.letter.copy()  # first bytes of letters, digits and the symbols that are no punctuation
        self.head[128:192] = False
        self.head[np.frombuffer(b"0123456789@$", dtype=np.uint8)] = True

    def of(self, token: str) -> list[str]:
        if token not in self.known:
            if len(self.known) >= self.p.cache:
                self.known.clear()
            core = noisy(token)
            self.known[token] = restore(core, self.model, self.p) if core else []
        return self.known[token]

    def chunk(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """(row, word) of every restored word."""
        w = W.split(texts)
        if not len(w.start):
            return np.empty(0, dtype=np.int64), []
        d = w.data
        odd = np.r_[0, np.cumsum(self.odd[d])]
        letters = np.r_[0, np.cumsum(self.letter[d])]
        three = np.zeros(len(d), dtype=bool)
        three[2:] = (d[2:] == d[1:-1]) & (d[2:] == d[:-2]) & self.letter[d[2:]] & (d[2:] < 128)
        three = np.r_[0, np.cumsum(three)]
        inner = np.zeros(len(d), dtype=bool)
        inner[1:-1] = np.isin(d[1:-1], np.frombuffer(b"._-*/,", dtype=np.uint8)) & self.letter[d[:-2]] & (self.letter[d[2:]] | self.odd[d[2:]])
        inner = np.r_[0, np.cumsum(inner)]
        count = lambda t: t[w.end] - t[w.start]
        flagged = (count(letters) > 0) & ((count(odd) > 0) | (count(three) > 0) | (count(inner) > 0))
        row_of = w.row_of()
        # a token of one letter or look-alike with punctuation around it
        heads = np.r_[0, np.cumsum(self.head[d])]
        single = (w.end - w.start <= 4) & (count(heads) == 1) | (w.end - w.start == 1) & self.odd[d[w.start]]
        edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
        rows, out = [], []
        raw = d.tobytes()
        for i in np.flatnonzero(flagged):
            for x in self.of(raw[w.start[i] : w.end[i]].decode("utf-8", "replace")):
                rows.append(row_of[i])
                out.append(x)
        lettered = np.r_[0, np.cumsum(count(letters) > 0)]
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if e - s < 3:
                continue
            for r in np.unique(row_of[s:e]):
                lo, hi = max(s, w.rows[r]), min(e, w.rows[r + 1])
                if hi - lo >= 3 and lettered[hi] - lettered[lo] >= 2:
                    for x in self.of(" ".join(one_of(raw[w.start[k] : w.end[k]].decode("utf-8", "replace")) for k in range(lo, hi))):
                        rows.append(r)
                        out.append(x)
        return np.array(rows, dtype=np.int64), out


def _buckets(w: W.Words, p: Toxicity) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and for each word the buckets of itself and its prefixes (-1: none)."""
    h = w.hashes(21)
    runs = W.Ranges(W.lane(22)[w.data])
    size = w.end - w.start
    out = np.full((1 + len(p.prefixes), len(h)), -1, dtype=np.int64)
    mask = np.uint64(p.buckets - 1)
    out[0] = (h & mask).astype(np.int64)
    for k, n in enumerate(p.prefixes, 1):
        long = size > n
        out[k, long] = ((runs.of(w.start[long], w.start[long] + n) ^ W.lane(23, 16)[k]) & mask).astype(np.int64)
    return h, out


def tokens(texts: pa.Array, restorer: Restorer, p: Toxicity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and buckets of every word, restored ones included."""
    w = W.split(texts, normal=True)
    h, b = _buckets(w, p)
    row = w.row_of()
    more, extra = restorer.chunk(texts)
    if len(more):
        x = W.split(pa.array(extra, pa.large_string()), normal=True)
        hx, bx = _buckets(x, p)
        row, h, b = np.r_[row, more[x.row_of()]], np.r_[h, hx], np.concatenate([b, bx], axis=1)
    return row, h, b


def _fold_counts(batches: Iterator[pa.RecordBatch], model: np.ndarray, p: Toxicity) -> Iterator[pa.RecordBatch]:
    restorer = Restorer(model, p)
    total = np.zeros((2, 2, p.buckets), dtype=np.int64)
    docs = np.zeros((2, 2), dtype=np.int64)
    for batch in batches:
        for part, texts in W.chunks(batch):
            fold, toxic = part.column("fold").to_numpy(), part.column("toxic").to_numpy()
            np.add.at(docs, (fold, toxic), 1)
            row, _, b = tokens(texts, restorer, p)
            key = np.unique((row[None, :] * p.buckets + b)[b >= 0])
            r, b = key // p.buckets, key % p.buckets
            np.add.at(total, (fold[r], toxic[r], b), 1)
    f, t, b = np.nonzero(total)
    where = [np.r_[x, y].astype(np.int32) for x, y in ((f, [0, 0, 1, 1]), (t, [0, 1, 0, 1]), (b, [p.buckets] * 4))]
    yield pa.RecordBatch.from_arrays([*map(pa.array, where), pa.array(np.r_[total[f, t, b], docs.reshape(-1)])], names=["fold", "toxic", "bucket", "n"])


def log_odds(n: np.ndarray, docs: np.ndarray, p: Toxicity) -> np.ndarray:
    """Shrunken log odds by bucket from counts by (class, bucket)."""
    share = (docs[1] + 0.5) / (docs.sum() + 1)
    return np.log((n[1] + p.shrink * share) / (n[0] + p.shrink * (1 - share))) - np.log(share / (1 - share))


def summary(texts: pa.Array, weights: np.ndarray, restorer: Restorer, p: Toxicity) -> np.ndarray:
    """A constant and six measures over all different words of a text: the largest weight, the logarithms
    of the sums of the weighty words' odds, of their weights and of their squares, of the number of very weighty words
    and of the number of words."""
    row, h, b = tokens(texts, restorer, p)
    n = len(texts)
    out = np.zeros((n, SUMMARY))
    out[:, 0] = 1
    order = np.lexsort((h, row))
    new = np.r_[True, (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])] if len(row) else np.empty(0, dtype=bool)
    row, b = row[order[new]], b[:, order[new]]
    w = np.where(b >= 0, weights[b], -np.inf).max(0) if len(row) else np.empty(0)
    out[:, 6] = np.log1p(np.bincount(row, minlength=n))
    some = w > 0.5
    row, w = row[some], w[some]
    np.maximum.at(out[:, 1], row, w)
    for k, part in ((2, np.exp(w)), (3, w), (4, w * w), (5, w > 2.5)):
        out[:, k] = np.log1p(np.bincount(row, weights=part, minlength=n))
    return out


def _summaries(batches: Iterator[pa.RecordBatch], weights: list[np.ndarray], model: np.ndarray, p: Toxicity) -> Iterator[pa.RecordBatch]:
    restorer = Restorer(model, p)
    for batch in batches:
        for part, texts in W.chunks(batch):
            fold = part.column("fold").to_numpy()
            x = np.where((fold == 0)[:, None], summary(texts, weights[1], restorer, p), summary(texts, weights[0], restorer, p))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * SUMMARY), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("toxic"), flat], names=["id", "toxic", "x"])


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton steps, halved until the loss falls, with a small ridge on the
    coefficients of the standardised measures (none on the constant, the first column)."""
    beta = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    beta[0] = np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return beta
    shift, scale = x.mean(0), x.std(0)
    shift[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    z = (x - shift) / scale
    cost = np.full(x.shape[1], ridge)
    cost[0] = 0

    def loss(b: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ b)).sum() + 0.5 * (cost * b * b).sum())

    for _ in range(60):
        m = 0.5 * (1 + np.tanh(0.5 * (z @ beta)))
        hess = (z * (m * (1 - m))[:, None]).T @ z + np.diag(cost + 1e-9)
        move = np.linalg.solve(hess, z.T @ (y - m) - cost * beta)
        step, now = 1.0, loss(beta)
        while step > 1e-6 and loss(beta + step * move) > now:
            step /= 2
        beta = beta + step * move
        if np.abs(step * move).max() < 1e-8:
            break
    out = beta / scale
    out[0] = beta[0] - (out * shift)[1:].sum()
    return out


@dataclass
class Model:
    characters: np.ndarray
    weights: np.ndarray
    beta: np.ndarray


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity(), id_col: str = "doc_id", text: str = "text") -> Model:
    model = character_model(docs, text)
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") >= 1).cast("int")).alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_labelled).withColumnRenamed("doc_id", "id")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = dict(slim.dtypes)["id"]
    fold = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold")  # by text: copies stay together
    sample = slim.join(F.broadcast(marked), "id").select("id", "toxic", fold, "text")
    got = sample.mapInArrow(partial(_fold_counts, model=model, p=p), "fold int, toxic int, bucket int, n long").groupBy("fold", "toxic", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((2, 2, p.buckets + 1))
    n[tuple(got.column(c).to_numpy() for c in ("fold", "toxic", "bucket"))] = got.column("n").to_numpy()
    n, size = n[:, :, :-1], n[:, :, -1]
    folds = [log_odds(n[k], size[k], p) for k in (0, 1)]
    rows = sample.mapInArrow(partial(_summaries, weights=folds, model=model, p=p), f"id {kind}, toxic int, x array<double>").toArrow().combine_chunks()
    rows = rows.sort_by("id")
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, SUMMARY) if rows.num_rows else np.empty((0, SUMMARY))
    return Model(model, log_odds(n.sum(0), size.sum(0), p), regress(x, rows.column("toxic").to_numpy().astype(np.float64)))


def _score(batches: Iterator[pa.RecordBatch], model: Model, p: Toxicity, text: str) -> Iterator[pa.RecordBatch]:
    restorer = Restorer(model.characters, p)
    for batch in batches:
        for part, texts in W.chunks(batch, text):
            s = 0.5 * (1 + np.tanh(0.5 * (summary(texts, model.weights, restorer, p) @ model.beta)))
            have = {k: part.column(k) for k in part.schema.names if k != text}
            yield pa.RecordBatch.from_pydict(have | {"score": pa.array(s), "predicted": pa.array((s >= p.predict_at).astype(np.int32))})


def score(docs: DataFrame, model: Model, p: Toxicity = Toxicity(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its text, with held_out, score and predicted."""
    held, raw = scratch(docs, "held", "text")
    base = docs.withColumn(held, held_out(F.col(f"`{id_col}`"))).withColumn(raw, F.col(f"`{text}`")).drop(text)
    base = base.drop(*[c for c in base.columns if c.lower() in OUTPUTS]).withColumnRenamed(held, "held_out")
    keep = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.drop(raw).schema)
    return base.mapInArrow(partial(_score, model=model, p=p, text=raw), f"{keep}score double, predicted int")
