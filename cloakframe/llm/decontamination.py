"""Benchmark decontamination: rare n-gram seeds, joined, then Smith-Waterman alignment.

Words are compared in a plain form (lower case, punctuation ignored).

1. The n-grams of ``shortest`` to ``longest`` words of all test items are counted in the whole corpus.
2. At each word of an item the seed is the shortest n-gram that is rare there: it occurs at most
   ``few`` times, or ``rare`` times the number of the corpus' words, beside ``copies`` times the occurrences of the longest
   n-gram at this word (so seeds stay short when copies of the item itself are frequent).  Where none is
   rare, the longest is the seed.
3. A second scan finds the seeds in the texts; hits meet the seeds in a join.
4. Hits of one text and item that lie near each other make a passage, which is aligned with the item:
   match +2, mismatch -1, gap -1 per word.  The score is the best local alignment's over that of a perfect
   copy; at ``threshold`` a passage is a copy, exact, edited or partly paraphrased.

Texts are never shuffled but for those with a seed in them, and these as word hashes.  Tasks are sent a
sieve (three of 2**``least_bits`` to 2**``most_bits`` bits for each n-gram, by their number; 32 MB at most), which only saves work: what passes it by chance is dropped by the join.  Items, n-grams, seeds and
hits are tables of any size.  Every hit is aligned; there is no cap.

Defined results: null or blank texts and items match nothing; an item of fewer words than ``longest`` is
also sought by its whole run of words; items of under ``shortest`` words are not sought;
repeated rows of a document give its pairs once, with the best score; items of equal text each get
their pairs; empty tables give an empty result; extra columns are ignored (``clean`` passes them through,
working columns get free names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import cut, scratch


@dataclass(frozen=True)
class Decontamination:
    rare: float = 1e-7
    few: int = 20
    copies: int = 2
    shortest: int = 3
    longest: int = 8
    match: int = 2
    mismatch: int = 1
    gap: int = 1
    threshold: float = 0.5
    least_bits: int = 24
    most_bits: int = 28


def grams(h: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width``-gram at each word; those that leave their row are not told apart here."""
    return W.spans(h, width) ^ W.lane(31, 64)[width]


def _item_grams(batches: Iterator[pa.RecordBatch], p: Decontamination) -> Iterator[pa.RecordBatch]:
    """Every n-gram of the items, with its place."""
    for batch in batches:
        for part, texts in W.chunks(batch):
            w = W.split(texts, normal=True)
            h, counts = w.hashes(), w.counts()
            out = []
            for width in range(p.shortest, p.longest + 1):
                g = grams(h, w.rows, width)
                at = W.inside(w.rows, width)
                row = np.searchsorted(w.rows, at, side="right") - 1
                out.append((g[at], row, at - w.rows[row], np.full(len(at), width)))
            gram, row, at, width = (np.concatenate([o[k] for o in out]) for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), part.column("item_id").take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(counts[row].astype(np.int32))],
                names=["gram", "item_id", "at", "width", "size"],
            )


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in W.chunks(batch):
            w = W.split(texts, normal=True)
            yield pa.RecordBatch.from_arrays([part.column("item_id"), _lists(w.hashes(), w.rows)], names=["item_id", "item"])


def _lists(h: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(h.view(np.int64)))


PROBES = 3


@dataclass
class Sieve:
    """Bits for the hash values that are sought, ``PROBES`` for each, taken from its bits 0, 18 and 36 on."""

    bits: np.ndarray
    mask: np.uint64

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        some = np.arange(len(h))
        for k in range(PROBES):  # few pass the first
            at = (h[some] >> np.uint64(18 * k)) & self.mask
            out[some] = (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            some = some[out[some]]
        return out


def sieve(sought: DataFrame, p: Decontamination) -> Sieve:
    """The sieve of the column ``gram``; what comes to the driver is the sieve."""
    n = sought.count()
    bits = min(p.most_bits, max(p.least_bits, int(64 * max(n, 1)).bit_length()))
    probes = ", ".join(f"shiftrightunsigned(gram, {18 * k}) & {(1 << bits) - 1}L" for k in range(PROBES))
    slot = F.col("slot")
    packed = sought.select(F.explode(F.expr(f"array({probes})")).alias("slot")).select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit")).distinct()
    got = packed.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Sieve(out, np.uint64((1 << bits) - 1))


def _found(h: np.ndarray, rows: np.ndarray, sought: Sieve, p: Decontamination) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, word) of everything in the rows that passes the sieve, by place."""
    out = []
    for width in range(p.shortest, p.longest + 1):
        g = grams(h, rows, width)
        at = np.flatnonzero(sought.holds(g))
        at = at[at + width <= rows[np.searchsorted(rows, at, side="right")]]
        out.append((g[at], at))
    gram, at = (np.concatenate([o[k] for o in out]) for k in (0, 1))
    order = np.argsort(at, kind="stable")
    return gram[order], at[order]


def _count(batches: Iterator[pa.RecordBatch], sought: Sieve, p: Decontamination) -> Iterator[pa.RecordBatch]:
    """How often n-grams that pass the sieve occur, chunk by chunk, and (as n-gram 0) the number of words."""
    for batch in batches:
        for _, texts in W.chunks(batch):
            w = W.split(texts, normal=True)
            gram, n = np.unique(_found(w.hashes(), w.rows, sought, p)[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[gram, 0]), pa.array(np.r_[n, len(w.start)])], names=["gram", "n"])


def seeds(benchmark: DataFrame, docs: DataFrame, p: Decontamination) -> DataFrame:
    """(gram, item_id, at, width, size): the seed at each word of the items."""
    every = cut(benchmark.mapInArrow(partial(_item_grams, p=p), "gram long, item_id long, at int, width int, size int"), "grams")
    known = every.groupBy("gram").agg(F.count("*").alias("own"))
    told = cut(docs.mapInArrow(partial(_count, sought=sieve(known, p), p=p), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    total = told.where("gram = 0").agg(F.sum("n")).first()[0] or 0
    counts = known.join(told, "gram", "left").select("gram", (F.coalesce("n", F.lit(0)) + F.col("own")).alias("n"))
    # at most longest - shortest + 1 n-grams start at a word
    ladder = F.sort_array(F.collect_list(F.struct("width", "n", "gram")))
    placed = every.join(counts, "gram").groupBy("item_id", "at", "size").agg(ladder.alias("ladder"))
    few = max(float(p.few), p.rare * total)
    rare = F.filter("ladder", lambda x: x["n"] <= few + p.copies * F.element_at("ladder", -1)["n"])
    full = F.element_at("ladder", -1)
    whole = (full["width"] == p.longest) | (F.col("at") == 0)  # the end of an item has no seed of its own but rare ones
    best = F.when(F.size(rare) > 0, F.get(rare, F.lit(0))).when(whole, full)
    return placed.select("item_id", "at", "size", best.alias("best")).where("best IS NOT NULL").select("best.gram", "item_id", "at", "best.width", "size")


ROW = "r0 long, r1 int"
HITS = "array<struct<gram:long,at:int>>"


def _hits(batches: Iterator[pa.RecordBatch], sought: Sieve, p: Decontamination) -> Iterator[pa.RecordBatch]:
    """The texts with something that passes the sieve, as word hashes, and what passed."""
    for batch in batches:
        for part, texts in W.chunks(batch):
            w = W.split(texts, normal=True)
            h = w.hashes()
            gram, at = _found(h, w.rows, sought, p)
            if not len(at):
                continue
            row = np.searchsorted(w.rows, at, side="right") - 1
            some = np.unique(row)
            counts = w.counts()[some]
            words = np.concatenate([h[w.rows[r] : w.rows[r + 1]] for r in some])
            off = pa.array(np.r_[0, np.cumsum(np.bincount(np.searchsorted(some, row), minlength=len(some)))].astype(np.int32))
            hits = pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array((at - w.rows[row]).astype(np.int32))], names=["gram", "at"]))
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in ("r0", "r1", "id")), _lists(words, np.r_[0, np.cumsum(counts)]), hits], names=["r0", "r1", "id", "words", "hits"])


def _passages(batches: Iterator[pa.RecordBatch], p: Decontamination) -> Iterator[pa.RecordBatch]:
    """The passages of each text that are to be aligned: runs of hits of one item less than its length
    apart, with a third of its length around."""
    for batch in batches:
        for k in range(batch.num_rows):
            met = batch.column("met")[k].values
            item, start, size = (met.field(c).to_numpy() for c in ("item_id", "start", "size"))
            order = np.lexsort((start, item))
            item, start, size = item[order], start[order].astype(np.int64), size[order].astype(np.int64)
            new = np.r_[True, (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[1:])]
            head = np.flatnonzero(new)
            tail = np.r_[head[1:], len(item)] - 1
            words = batch.column("words")[k].values.to_numpy()
            slack = size[head] // 3 + 2
            first = np.maximum(start[head] - slack, 0)
            end = np.minimum(start[tail] + size[head] + slack, len(words))
            cuts = np.r_[0, np.cumsum(end - first)]
            flat = np.concatenate([words[a:b] for a, b in zip(first, end, strict=True)])
            ids = batch.column("id").slice(k, 1).take(pa.array(np.zeros(len(head), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(item[head]), pa.array(first), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat))], names=["id", "item_id", "first", "passage"])


def align(left: np.ndarray, right: np.ndarray, p: Decontamination) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row of ``left`` (items) with that of ``right`` (passages), and the
    passage word at which the first such alignment ends (exclusive); 0 and 1 are padding that matches
    nothing.  One item word at a time, for all rows and passage words."""
    cols = np.arange(right.shape[1] + 1, dtype=np.int32) * p.gap
    prev = np.zeros((len(left), right.shape[1] + 1), dtype=np.int32)
    best, end = np.zeros(len(left), dtype=np.int32), np.zeros(len(left), dtype=np.int64)
    for i in range(left.shape[1]):
        hit = left[:, i : i + 1] == right
        now = np.zeros_like(prev)
        np.maximum(prev[:, :-1] + np.where(hit, p.match, -p.mismatch), prev[:, 1:] - p.gap, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + cols, axis=1) - cols
        top = now.max(1)
        end = np.where(top > best, now.argmax(1), end)
        np.maximum(best, top, out=best)
        prev = now
    return best, end


def _padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, dtype=np.int64)
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def _aligned(batches: Iterator[pa.RecordBatch], p: Decontamination) -> Iterator[pa.RecordBatch]:
    """The passages that score at the threshold, cut down to the best alignment."""
    for batch in batches:
        items, passages = ([x.values.to_numpy() for x in batch.column(c)] for c in ("item", "passage"))
        order = sorted(range(batch.num_rows), key=lambda k: (len(passages[k]), len(items[k])))
        score, first, end = np.zeros(len(order)), np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        at = 0
        while at < len(order):
            size = 1
            while at + size < len(order) and size < 2048 and len(passages[order[at + size]]) * (size + 1) <= 400_000:
                size += 1
            some = order[at : at + size]
            best, stop = align(_padded([items[k] for k in some], 0), _padded([passages[k] for k in some], 1), p)
            score[some] = best / (p.match * np.array([len(items[k]) for k in some]))
            end[some] = stop
            at += size
            good = [k for k in some if score[k] >= p.threshold]
            if good:  # the start is the end of the best alignment of both read backwards, from that end on
                back = align(_padded([items[k][::-1] for k in good], 0), _padded([passages[k][: end[k]][::-1] for k in good], 1), p)[1]
                first[good] = end[good] - back
        good = np.flatnonzero(score >= p.threshold)
        if len(good):
            take = pa.array(good)
            base = batch.column("first").to_numpy()[good]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("item_id").take(take), pa.array(score[good]), pa.array(base + first[good]), pa.array(base + end[good])],
                names=["id", "item_id", "score", "first_word", "end_word"],
            )


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, item_id, score, first_word, end_word): each document and test item that it holds a copy of,
    with the words (end exclusive) that the best alignment covers."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    slim = docs.select(F.xxhash64(i, t).alias("r0"), F.hash(t, i).alias("r1"), i.alias("id"), t.alias("text"))
    kind = dict(slim.dtypes)["id"]
    tests = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL")
    sown = cut(seeds(tests, slim.select("text"), p), "seeds")
    items = tests.mapInArrow(_item_words, "item_id long, item array<long>")
    hits = cut(slim.mapInArrow(partial(_hits, sought=sieve(sown.select("gram").distinct(), p), p=p), f"{ROW}, id {kind}, words array<long>, hits {HITS}"), "hits")
    seen = hits.select("r0", "r1", F.explode("hits").alias("x")).select("r0", "r1", "x.gram", F.col("x.at").alias("here"))
    met = seen.join(sown, "gram").select("r0", "r1", F.struct("item_id", (F.col("here") - F.col("at")).alias("start"), "size").alias("m"))
    met = met.groupBy("r0", "r1").agg(F.collect_set("m").alias("met"))  # what one text met
    passages = cut(hits.drop("hits").join(met, ["r0", "r1"]).mapInArrow(partial(_passages, p=p), f"id {kind}, item_id long, first long, passage array<long>"), "passages")
    found = passages.join(items, "item_id").mapInArrow(partial(_aligned, p=p), f"id {kind}, item_id long, score double, first_word long, end_word long")
    best = F.max(F.struct("score", "first_word", "end_word")).alias("best")
    return found.groupBy("id", "item_id").agg(best).select("id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no copy of a test item."""
    (gone,) = scratch(docs, "gone")
    found = cut(contaminated(docs, benchmark, p, id_col, text).select(F.col("id").alias(gone)).distinct(), "contaminated")
    return docs.join(found, F.col(f"`{id_col}`") == F.col(gone), "left_anti")
