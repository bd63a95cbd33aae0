"""Ranked lexical search over hashed max-sketches.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased.  A
document's score for a query is the sum, over the query's distinct terms, of

    weight(term) * impact(document, term),   impact = (10**9 * tf) div (1000 * tf + 8 * m),

where m grows with the document's length against the mean and the weight falls with the number of documents that have the term.

* ``statistics``: one scan counts documents, terms, and the documents of each query term.
* ``sketches``: one scan folds each document's impacts into coordinatewise maxima: every term has a coordinate in each of four
  rows, and a coordinate keeps the greatest impact of the terms that fall on it, rounded up to a byte.  The width
  follows the number of distinct terms (a power of two), so long documents are told as well as short ones.
* Bounds: for a batch of queries the coordinates of all their terms are looked up in a block of sketches of one width; the least of a term's four
  values, times its weight, is at least what it can add, so the sum is an upper bound of the score.
* Rescoring goes down the bounds: of each query the documents with the greatest bounds are scored exactly, which gives a
  threshold (the k-th best score so far); documents with lower bounds are out for good; further rounds take longer
  stretches of what is left until no bound reaches the threshold.  So the result is exact, whatever the sketches lose.

Equal texts are one candidate (128-bit digest), whatever their number; the ids that share a text come back at the end, at most k of them for
each text.  Queries are dealt into blocks of bounded size, each of which meets all documents; a block's terms go to every task.
What is shuffled are digests, ids and bounds; texts are read again only where a candidate is (ids broadcast if they are counted to
be at most ``broadcast_rows``).

Defined results: null and empty texts have no terms and no rank; a query without terms has no rows; queries with one id are
separate rows under it; rows of one id and text each count as a document; null ids come last among equal scores; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut, discard
from .words import Words, chunks, mix, raw

NARROWEST, WIDEST, ROWS = 64, 1 << 18, 4
STEP = 4096  # an impact, at most 10**6, in units of a byte
DIGESTS = ("d0", "d1")


@dataclass(frozen=True)
class Search:
    """``k`` hits a query; ``block`` and ``block_bytes`` bound the queries met at once; ``first`` and ``growth`` are the length of the first
    stretch of bounds that is scored and how much longer the next one is."""

    k: int = 10
    block: int = 1024
    block_bytes: int = 4 << 20
    first: int = 32
    growth: int = 32
    broadcast_rows: int = 500_000


@dataclass
class Block:
    """A batch of queries: the hashes of their distinct terms, their weights, and each query's terms as positions among them."""

    queries: np.ndarray  # number of each query
    terms: np.ndarray  # uint64, sorted
    sizes: np.ndarray  # bytes of each term
    members: list[np.ndarray]
    weights: np.ndarray | None = None
    n: int = 0
    total: int = 0


def split(texts: pa.Array) -> Words:
    """Terms of a large_string array without nulls."""
    data, off = raw(texts)
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(len(texts) + 1, dtype=np.int64))
    low = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    solid = (low >= 0x80) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = off[(off > 0) & (off < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    start = np.flatnonzero(first)
    return Words(low, start, np.flatnonzero(last) + 1, np.searchsorted(start, off).astype(np.int64))


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct pairs; rows ascend."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Impact of terms that occur ``tf`` times in documents of ``n`` terms."""
    m = 10 + (90 * n.astype(np.int64) * docs) // max(total, 1)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


# statistics ------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """(term, n) counts of a partition: documents by query term, and under -1 and -2 documents and terms."""
    found, docs, total = np.zeros(len(block.terms), dtype=np.int64), 0, 0
    for batch in batches:
        for _, texts in chunks(batch):
            w = split(texts)
            n = w.counts()
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            hashes = w.hashes()
            at = np.searchsorted(block.terms, hashes).clip(max=max(len(block.terms) - 1, 0))
            mine = np.flatnonzero((block.terms[at] == hashes) & (block.sizes[at] == w.end - w.start)) if len(block.terms) else np.empty(0, dtype=np.int64)
            pairs = np.unique(w.row_of()[mine] * np.int64(len(block.terms)) + at[mine])
            found += np.bincount(pairs % max(len(block.terms), 1), minlength=len(block.terms))[: len(block.terms)]
    keys = np.append(np.flatnonzero(found), [-1, -2])
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.append(found[found > 0], [docs, total]), pa.int64())], names=["term", "n"])


def statistics(docs: DataFrame, block: Block) -> Block:
    """The block with the numbers of documents and terms, and the weights of its terms."""
    counted = docs.select("text").mapInArrow(partial(_count, block=block), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in counted.collect()}  # at most the terms of a block
    block.n, block.total = df.pop(-1, 0), df.pop(-2, 0)
    block.weights = np.array([weight(block.n, df[i]) if i in df else 0 for i in range(len(block.terms))], dtype=np.int64)
    return block


# sketches --------------------------------------------------------------------------------------------


def width(terms: np.ndarray) -> np.ndarray:
    """The width of a sketch's rows for a number of distinct terms: the least power of two that is three times as many."""
    return np.minimum(np.int64(1) << np.ceil(np.log2(np.maximum(3 * terms, NARROWEST))).astype(np.int64), WIDEST)


def places(hashes: np.ndarray, wide: np.ndarray | int) -> list[np.ndarray]:
    """A term's coordinates in the rows of a sketch of a width."""
    mask, wide = np.asarray(wide, dtype=np.uint64) - np.uint64(1), np.asarray(wide, dtype=np.int64)
    other, half = mix(hashes), np.uint64(32)
    return [(h & mask).astype(np.int64) + i * wide for i, h in enumerate((hashes, other, hashes >> half, other >> half))]


SKETCH = "doc_id {}, d0 long, d1 long, wide int, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch], docs: int, total: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks(batch):
            w = split(texts)
            n = w.counts()
            rows, hashes, tf = distinct(w.row_of(), w.hashes())
            terms = np.bincount(rows, minlength=len(n))
            wide = width(terms)
            value = -(-impacts(tf, n[rows], docs, total) // STEP)
            off = np.append(0, np.cumsum(np.where(n > 0, ROWS * wide, 0)))
            sketch = np.zeros(off[-1], dtype=np.uint8)
            for at in places(hashes, wide[rows]):
                np.maximum.at(sketch, off[rows] + at, value.astype(np.uint8))
            full = np.flatnonzero(n)
            blob = pa.Array.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer(off[np.append(full, len(n))].tobytes()), pa.py_buffer(sketch)])
            kept = pa.array(full)
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(kept) for i in range(3)), pa.array(wide[full], pa.int32()), blob.cast(pa.binary())], names=["doc_id", "d0", "d1", "wide", "sketch"])


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, d0, d1, text) with a 128-bit digest of the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("d0"), F.xxhash64(F.lit(11), "text").alias("d1"), F.coalesce("text", F.lit("")).alias("text"))


def sketches(docs: DataFrame, n: int, total: int) -> DataFrame:
    """(doc_id, d0, d1, wide, sketch) of all documents that have terms, for a collection of ``n`` documents and ``total`` terms."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return digested(docs).mapInArrow(partial(_sketch, docs=n, total=total), SKETCH.format(kind))


# bounds ----------------------------------------------------------------------------------------------


def bounds(block: Block, wide: int, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(query number, upper bounds of its scores) over sketches of one width; ``values`` has a coordinate in each row."""
    least = reduce(np.minimum, (values[at] for at in places(block.terms, wide)))
    least = least.astype(np.float32) * (block.weights.astype(np.float32) * np.float32(STEP))[:, None]
    for number, member in zip(block.queries, block.members, strict=True):
        yield int(number), least[member].sum(axis=0, dtype=np.float64) * (1 + 1e-6)  # 32-bit products round by less than 1e-6


def _bound(batches: Iterator[pa.RecordBatch], block: Block, at_least: dict[int, int] | None, top: int, limit: int = 512) -> Iterator[pa.RecordBatch]:
    """(query, d0, d1, bound): with thresholds all documents that reach them, else the ``top`` texts of each query in this partition."""
    best: dict[int, tuple] = {}
    held: dict[int, list] = {}

    def rows(wide: int, parts: list) -> Iterator[tuple]:
        d0, d1 = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        values = np.concatenate([p[2] for p in parts]).T
        for number, bound in bounds(block, wide, values):
            if at_least is not None:
                hit = np.flatnonzero((bound >= at_least.get(number, 1)) & (bound >= 1))
            else:
                hit = np.flatnonzero(bound >= (best[number][2][-1] if number in best and len(best[number][2]) == top else 1))
            if len(hit):
                yield number, d0[hit], d1[hit], bound[hit]

    def use(wide: int, parts: list) -> Iterator[pa.RecordBatch]:
        for number, a, b, bound in rows(wide, parts):
            if at_least is not None:
                one = np.unique(np.stack([a, b]), axis=1, return_index=True)[1]
                yield _found(number, a[one], b[one], bound[one])
            else:
                old = best.get(number)
                if old:
                    a, b, bound = np.append(old[0], a), np.append(old[1], b), np.append(old[2], bound)
                one = np.unique(np.stack([a, b]), axis=1, return_index=True)[1]
                order = one[np.argsort(-bound[one], kind="stable")][:top]
                best[number] = (a[order], b[order], bound[order])

    for batch in batches:
        wide = batch.column("wide").to_numpy()
        d0, d1 = batch.column("d0").to_numpy(), batch.column("d1").to_numpy()
        blob = batch.column("sketch")
        _, offsets, data = blob.buffers()
        off = np.frombuffer(offsets, dtype=np.int32)[blob.offset : blob.offset + len(blob) + 1]
        data = np.frombuffer(data, dtype=np.uint8)
        for x in np.unique(wide):
            mine = np.flatnonzero(wide == x)
            step = max(1, min(limit, (1 << 24) // int(ROWS * x)))
            for i in range(0, len(mine), step):
                some = mine[i : i + step]
                values = np.frombuffer(b"".join(data[off[j] : off[j + 1]].tobytes() for j in some), dtype=np.uint8).reshape(len(some), ROWS * int(x))
                held.setdefault(int(x), []).append((d0[some], d1[some], values))
                if sum(len(h[0]) for h in held[int(x)]) >= step:
                    yield from use(int(x), held.pop(int(x)))
    for x in list(held):
        yield from use(x, held.pop(x))
    for number, (a, b, bound) in best.items():
        yield _found(number, a, b, bound)


def _found(number: int, d0: np.ndarray, d1: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(d0), number), pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(value, pa.float64())], names=["query", "d0", "d1", "bound"])


def _bounded(index: DataFrame, block: Block, at_least: dict[int, int] | None, top: int = 0) -> DataFrame:
    """(query, d0, d1, bound): each text once for a query."""
    rows = index.select("d0", "d1", "wide", "sketch").mapInArrow(partial(_bound, block=block, at_least=at_least, top=top), "query long, d0 long, d1 long, bound double")
    return rows.groupBy("query", *DIGESTS).agg(F.max("bound").alias("bound"))


# exact scores ----------------------------------------------------------------------------------------


def _score(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """(query, d0, d1, score) of the texts for the queries that ask for them."""
    number_of = {int(q): i for i, q in enumerate(block.queries)}
    for batch in batches:
        for part, texts in chunks(batch):
            w = split(texts)
            n, hashes = w.counts(), w.hashes()
            at = np.searchsorted(block.terms, hashes).clip(max=len(block.terms) - 1)
            mine = np.flatnonzero((block.terms[at] == hashes) & (block.sizes[at] == w.end - w.start))
            rows, term, tf = distinct(w.row_of()[mine], at[mine].astype(np.uint64))
            term = term.astype(np.int64)
            gain = block.weights[term] * impacts(tf, n[rows], block.n, block.total)
            ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
            out: list[tuple] = []
            d0, d1, asked = part.column("d0").to_pylist(), part.column("d1").to_pylist(), part.column("queries").to_pylist()
            line = np.zeros(len(block.terms), dtype=np.int64)
            for r in range(part.num_rows):
                here = slice(ends[r], ends[r + 1])
                line[term[here]] = gain[here]
                out += [(q, d0[r], d1[r], int(line[block.members[number_of[q]]].sum())) for q in asked[r]]
                line[term[here]] = 0
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "d0", "d1", "score"])


def _scored(docs: DataFrame, wanted: DataFrame, block: Block, search: Search) -> DataFrame:
    """(query, d0, d1, score) of the wanted (query, d0, d1), each text read where it lies."""
    asked = wanted.groupBy(*DIGESTS).agg(F.collect_list("query").alias("queries"))  # at most a block of queries
    asked = cut(asked, "asked")
    asked = F.broadcast(asked) if asked.count() <= search.broadcast_rows else asked.hint("merge")
    met = digested(docs).join(asked, list(DIGESTS)).select(*DIGESTS, "text", "queries")
    rows = met.mapInArrow(partial(_score, block=block), "query long, d0 long, d1 long, score long")
    return rows.where("score > 0").groupBy("query", *DIGESTS).agg(F.max("score").alias("score"))


def _thresholds(scored: DataFrame, k: int) -> dict[int, int]:
    """The k-th best score of each query that has so many."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), *DIGESTS)
    rows = scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    rows = rows.groupBy("query").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k)
    return {r["query"]: r["score"] for r in rows.collect()}  # one for each query of a block


def _search_block(docs: DataFrame, index: DataFrame, block: Block, search: Search) -> DataFrame:
    """(query, doc_id, score) of the k best documents of each query of a block, and all that tie with the last text."""
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), *DIGESTS)
    start = _bounded(index, block, None, search.first).withColumn("_n", F.row_number().over(by_bound)).where(F.col("_n") <= search.first)
    done = cut(_scored(docs, start.select("query", *DIGESTS), block, search), "scores")
    reach = _thresholds(done, search.k)
    left = cut(_bounded(index, block, reach).join(done, ["query", *DIGESTS], "left_anti"), "bounds")
    parts, stretch = [done], search.first * search.growth
    while not left.isEmpty():
        taken = cut(left.withColumn("_n", F.row_number().over(by_bound)).where(F.col("_n") <= stretch).select("query", *DIGESTS), "taken")
        done = cut(_scored(docs, taken, block, search), "scores")
        parts.append(done)
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        reach = _thresholds(every, search.k)
        low = docs.sparkSession.createDataFrame([(int(q), int(reach.get(int(q), 1))) for q in block.queries], "query long, least long")
        rest = cut(left.join(F.broadcast(low), "query").where("bound >= least").drop("least").join(taken, ["query", *DIGESTS], "left_anti"), "bounds")
        discard(left)
        discard(taken)
        left, stretch = rest, stretch * search.growth
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    rank = F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))
    best = cut(every.withColumn("_n", rank).where(F.col("_n") <= search.k).drop("_n"), "best")
    return _expanded(index, best, search)


def _expanded(index: DataFrame, best: DataFrame, search: Search) -> DataFrame:
    """The documents of the best texts, at most k of each text."""
    some = best.select(*DIGESTS).distinct()
    some = F.broadcast(some) if best.count() <= search.broadcast_rows else some
    ids = index.select("doc_id", *DIGESTS).join(some, list(DIGESTS), "left_semi")
    least = F.row_number().over(Window.partitionBy(*DIGESTS).orderBy(F.col("doc_id").asc_nulls_last()))
    ids = ids.withColumn("_n", least).where(F.col("_n") <= search.k).drop("_n")
    return best.join(ids, list(DIGESTS)).select("query", "doc_id", "score")


# queries ---------------------------------------------------------------------------------------------


def _numbered(items: DataFrame, search: Search) -> DataFrame:
    """(query, item_id, text): queries numbered from 0 by blocks; written, as the numbers must not change."""
    keyed = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return cut(keyed.withColumn("query", F.monotonically_increasing_id()), "queries")


def _blocks(numbered: DataFrame, search: Search) -> Iterator[Block]:
    """The queries in blocks of bounded number and bytes, read one block at a time."""
    from pyspark.sql.types import LongType

    rows, size = [], 0
    for r in numbered.select(F.col("query").cast(LongType()), "text").toLocalIterator():
        if rows and (len(rows) >= search.block or size + len(r["text"]) > search.block_bytes):
            yield _block(rows)
            rows, size = [], 0
        rows.append((r["query"], r["text"]))
        size += len(r["text"])
    if rows:
        yield _block(rows)


def _block(rows: list[tuple[int, str]]) -> Block:
    w = split(pa.array([t for _, t in rows], pa.large_string()))
    hashes, sizes = w.hashes(), w.end - w.start
    terms, first = np.unique(hashes, return_index=True)
    at = np.searchsorted(terms, hashes)
    members = [np.unique(at[w.rows[i] : w.rows[i + 1]]) for i in range(len(rows))]
    full = [i for i, m in enumerate(members) if len(m)]
    return Block(np.array([rows[i][0] for i in full], dtype=np.int64), terms, sizes[first], [members[i] for i in full])


def search(docs: DataFrame, items: DataFrame, options: Search = Search()) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    numbered, index, found = _numbered(items, options), None, None
    for block in _blocks(numbered, options):
        if not len(block.queries):
            continue
        block = statistics(docs, block)
        if not block.total:
            continue
        if index is None:
            index = cut(sketches(docs, block.n, block.total), "sketches", "zstd")  # mostly zeros
        hits = cut(_search_block(docs, index, block, options), "hits")
        found = hits if found is None else found.unionByName(hits)
    if index is not None:
        discard(index)
    out = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    if found is None:
        return docs.sparkSession.createDataFrame([], out)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.k)
    return ranked.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
