"""Self-join on the Jaccard similarity of word-shingle sets, with Bayesian pruning of candidates.

1. Every text becomes the set of its ``shingle``-word shingles (a text of fewer words is one shingle).
   Texts with equal sets are one class with a number of its own, led by the least doc_id; copies are never
   expanded again.
2. A class gets ``hashes`` MinHash values (16 bits kept of each); ``band_rows`` of them in a row make a
   band, and classes that agree on a band meet in a bucket.
3. In a bucket, pairs are compared ``step`` values at a time.  With m agreements among n values and a
   uniform prior, the similarity's posterior is Beta(m + 1, n - m + 1); a pair is dropped as soon as its
   probability of reaching the threshold falls below ``tolerance``.
4. Classes left with a partner in a bucket get their texts back, and the surviving pairs are verified
   exactly on the shingle sets.

A bucket of many classes is dealt to tasks as blocks of about ``block`` classes and pairs of blocks, by
hash, so no task holds a whole bucket.  A pair that meets in several buckets counts in the first band it
agrees on.  Tasks return, for each class, its number of links and the least class it is connected with
there: one row for a class and task, however many pairs were linked.  Nothing caps buckets, candidates or
partners.  The work for a group of n different texts that are all linked with each other is n * n / 2
vectorised comparisons, spread over its blocks.

Results: class_id is the least doc_id of the connected component of links; n_links counts the other
documents (copies included) with similarity of at least ``threshold``.

Defined results: null, empty and blank texts have no shingles and link to nothing, not even each other;
a doc_id with several texts takes part with each of them (their components are one, n_links is the largest
of its texts', and a link to two of them counts twice); rows with a null id get a null class; an empty
table gives an empty result; the result has no extra columns (``keep_one`` passes them through, working
columns get free names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .storage import cut, discard, scratch


@dataclass(frozen=True)
class JaccardJoin:
    shingle: int = 5
    threshold: float = 0.8
    hashes: int = 128
    band_rows: int = 4
    bands: int = 24
    step: int = 16
    tolerance: float = 1e-7
    block: int = 512


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, each row's sorted and distinct, with the row offsets."""
    w = W.split(texts)
    h = w.hashes()
    counts = w.counts()
    full = W.spans(h, width)
    short = W.Ranges(h)
    out, sizes = [], np.zeros(len(counts), dtype=np.int64)
    for i, n in enumerate(counts):
        if n >= width:
            a = np.unique(full[w.rows[i] : w.rows[i + 1] - width + 1])
        elif n:
            a = short.of(w.rows[i : i + 1], w.rows[i + 1 : i + 2]) + np.uint64(n)
        else:
            continue
        sizes[i] = len(a)
        out.append(a)
    return (np.concatenate(out) if out else np.empty(0, dtype=np.uint64)), np.r_[0, np.cumsum(sizes)]


def _signatures(batches: Iterator[pa.RecordBatch], p: JaccardJoin) -> Iterator[pa.RecordBatch]:
    mult, add = W.lane(11, p.hashes) | np.uint64(1), W.lane(12, p.hashes)
    for batch in batches:
        for part, texts in W.chunks(batch):
            sets, off = shingle_sets(texts, p.shingle)
            full = np.flatnonzero(np.diff(off))
            sig = np.zeros((len(texts), p.hashes), dtype=np.uint16)
            digest = np.zeros((2, len(texts)), dtype=np.uint64)
            if len(full):
                at = off[full]
                with np.errstate(over="ignore"):
                    for j in range(p.hashes):
                        sig[full, j] = W.mix(np.minimum.reduceat(sets * mult[j] + add[j], at)) & np.uint64(0xFFFF)
                    for lane in (0, 1):
                        digest[lane, full] = np.add.reduceat(W.mix(sets ^ W.lane(13, 2)[lane]), at)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * p.hashes), len(texts), [None, pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("version"), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array(np.diff(off)), raw.cast(pa.binary())],
                names=["id", "version", "d0", "d1", "n", "sig"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column as a matrix."""
    _, offsets, data = column.buffers()
    width = len(column[0].as_py())
    first = np.frombuffer(offsets, dtype=np.int32)[column.offset]
    return np.frombuffer(data, dtype=np.uint16, count=len(column) * width // 2, offset=int(first)).reshape(len(column), width // 2)


def band_keys(sig: np.ndarray, p: JaccardJoin) -> np.ndarray:
    """One 64-bit key for each row and band."""
    rows = sig[:, : p.bands * p.band_rows].reshape(len(sig), p.bands, p.band_rows).astype(np.uint64)
    key = np.broadcast_to(W.lane(14, p.bands), rows.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for j in range(p.band_rows):
            key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return key


def _bands(batches: Iterator[pa.RecordBatch], p: JaccardJoin) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = band_keys(_matrix(batch.column("sig")), p)
        cls = batch.column("cls").take(pa.array(np.repeat(np.arange(len(keys)), p.bands)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), cls, pa.array(np.tile(np.arange(p.bands, dtype=np.int32), len(keys)))], names=["key", "cls", "band"])


@cache
def floors(p: JaccardJoin) -> list[int]:
    """For each number of values compared (a multiple of ``step``), the least agreements that a pair
    needs to stay: P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(p.step, p.hashes + 1, p.step):
        total, m = 0.0, -1
        while total < p.tolerance and m < n:
            m += 1
            total += math.comb(n + 1, m) * p.threshold**m * (1 - p.threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _pairs(block: np.ndarray, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that a task compares: within a block, or across two."""
    if i == k:
        return np.triu_indices(len(block), 1)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == k)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: int, p: JaccardJoin) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that first agree on ``band`` and whose posterior never falls below the tolerance."""
    if band:
        same = np.ones(len(a), dtype=bool)
        for j in range(band):
            cols = slice(j * p.band_rows, (j + 1) * p.band_rows)
            same &= (sig[a, cols] != sig[b, cols]).any(1)
        a, b = a[same], b[same]
    m = np.zeros(len(a), dtype=np.int32)
    for n, least in zip(range(0, p.hashes, p.step), floors(p), strict=True):
        if not len(a):
            break
        m += (sig[a, n : n + p.step] == sig[b, n : n + p.step]).sum(1, dtype=np.int32)
        stay = m >= least
        a, b, m = a[stay], b[stay], m[stay]
    return a, b


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each task in turn; the input is sorted by (key, i, k)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "k")])
        cuts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(key[:, s])
            if held and now != last:
                yield _joined(held)
                held = []
            last = now
            held.append(batch.slice(s, e - s))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 40)[0]


def _candidates(group: pa.RecordBatch, p: JaccardJoin) -> tuple[np.ndarray, np.ndarray]:
    head = [group.column(c)[0].as_py() for c in ("i", "k", "band")]
    a, b = _pairs(group.column("block").to_numpy(), *head[:2])
    sig = _matrix(group.column("sig"))
    found = [survivors(sig, a[x : x + 200_000], b[x : x + 200_000], head[2], p) for x in range(0, len(a), 200_000)]
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (a, b)


TASK = ["key", "band", "i", "k", "block", "cls"]


def _prune(batches: Iterator[pa.RecordBatch], p: JaccardJoin) -> Iterator[pa.RecordBatch]:
    out, n = [], 0
    for group in runs(batches):
        if group.num_rows < 2:
            continue
        a, b = _candidates(group, p)
        if len(a):
            out.append(group.select(TASK).take(pa.array(np.unique(np.r_[a, b]))))
            n += out[-1].num_rows
            if n >= 4096:
                yield _joined(out)
                out, n = [], 0
    if out:
        yield _joined(out)


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sorted sets."""
    if len(a) < 64 or len(a) * 8 < len(sets) ** 2 / 2:
        return np.array([len(x) + len(y) - len(np.union1d(x, y)) for x, y in ((sets[i], sets[j]) for i, j in zip(a, b, strict=True))], dtype=np.int64)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(where) > 1
    rank = np.cumsum(shared) - 1
    keep = shared[where]
    col, row = rank[where[keep]], row[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 2048
    for lo in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(col, [lo, lo + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[row[s:e], col[s:e] - lo] = 1
        total += part @ part.T
    return total[a, b].astype(np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of n rows the row of least ``order`` that the pairs connect it with."""
    root = np.arange(n)
    while True:
        new = root.copy()
        for x, y in ((a, b), (b, a)):
            better = order[root[y]] < order[new[x]]
            # the least neighbour of each row: later writes win, so write in descending order
            idx = np.flatnonzero(better)
            idx = idx[np.argsort(-order[root[y[idx]]], kind="stable")]
            cand = new.copy()
            cand[x[idx]] = root[y[idx]]
            new = np.where(order[cand] < order[new], cand, new)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(batches: Iterator[pa.RecordBatch], p: JaccardJoin) -> Iterator[pa.RecordBatch]:
    for group in runs(batches):
        if group.num_rows < 2:
            continue
        a, b = _candidates(group, p)
        if not len(a):
            continue
        flat, off = shingle_sets(W.text_column(group.column("text")), p.shingle)
        sets = [flat[s:e] for s, e in zip(off[:-1], off[1:], strict=True)]
        size = np.diff(off)
        both = overlaps(sets, a, b)
        linked = both >= p.threshold * (size[a] + size[b] - both) - 1e-9
        a, b = a[linked], b[linked]
        if not len(a):
            continue
        copies = group.column("copies").to_numpy()
        links = np.bincount(a, weights=copies[b], minlength=len(sets)) + np.bincount(b, weights=copies[a], minlength=len(sets))
        ids = group.column("cls")
        order = np.empty(len(sets), dtype=np.int64)
        order[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(sets))
        root = _roots(len(sets), a, b, order)
        touched = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(touched)), pa.array(links[touched].astype(np.int64)), ids.take(pa.array(root[touched]))], names=["cls", "links", "root"])


def _tasks(df: DataFrame) -> DataFrame:
    """Rows of a task together and in a row."""
    return df.repartition("key", "i", "k").sortWithinPartitions("key", "i", "k", "cls")


def near_duplicates(docs: DataFrame, p: JaccardJoin = JaccardJoin(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id, n_links, n_shingles): one row for each distinct id of ``docs``."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("version", F.xxhash64("text"))
    kind = dict(slim.dtypes)["id"]
    told = cut(slim.mapInArrow(partial(_signatures, p=p), f"id {kind}, version long, d0 long, d1 long, n long, sig binary"), "signatures")
    named = told.where("n > 0 AND id IS NOT NULL")
    first = named.groupBy("d0", "d1").agg(F.min(F.struct("id", "version")).alias("first"), F.count_distinct("id").alias("copies"), F.max("sig").alias("sig"))
    # the numbers are written with the classes, so they are the same for all that reads them
    classes = cut(first.select(F.monotonically_increasing_id().alias("cls"), "d0", "d1", "first.*", "copies", "sig"), "classes")
    member = cut(named.select("id", "d0", "d1").distinct().join(classes.select("d0", "d1", "cls", "copies"), ["d0", "d1"]).select("id", "cls", "copies"), "members")

    bands = classes.select("cls", "sig").mapInArrow(partial(_bands, p=p), "key long, cls long, band int")
    crowd = bands.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    dealt = bands.join(crowd, "key").withColumn("blocks", F.ceil(F.col("crowd") / p.block).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls", F.lit(17)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("key", "band", "block", "cls", other).select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("k"), "block", "cls")
    left = cut(_tasks(dealt.join(classes.select("cls", "sig"), "cls")).mapInArrow(partial(_prune, p=p), "key long, band int, i int, k int, block int, cls long"), "candidates")

    # the list of classes grows with the corpus, so the join is a merge join at every size
    asked = left.join(classes.select("cls", "id", "version"), "cls")
    need = asked.select("id", "version").distinct().hint("merge")
    texts = slim.join(need, ["id", "version"]).dropDuplicates(["id", "version"])
    full = _tasks(asked.join(texts.join(classes.select("id", "version", "sig", "copies"), ["id", "version"]), ["id", "version"]).drop("id", "version"))
    found = cut(full.mapInArrow(partial(_verify, p=p), "cls long, links long, root long"), "links")
    discard(left)

    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    # the classes of a document with several texts belong together; written, so that a hot id can be split in the join
    several = cut(member.groupBy("id").agg(F.min("cls").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "several")
    ties = member.join(several, "id").select(F.col("cls").alias("u"), F.col("least").alias("v"))
    parts = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")).union(ties)).withColumnRenamed("node", "cls")
    heads = parts.join(classes.select("cls", "id"), "cls")
    least = cut(heads.groupBy("component").agg(F.min("id").alias("class_id")), "least")
    leads = classes.select("cls", F.col("id").alias("own")).join(parts.join(least, "component").select("cls", "class_id"), "cls", "left").join(links, "cls", "left")
    # written, so that a class of very many copies can be split in the join
    leads = cut(leads.select("cls", F.coalesce("class_id", "own").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")), "leads")
    one = member.join(leads, "cls").groupBy("id").agg(F.min("class_id").alias("class_id"), F.max(F.col("links") + F.col("copies") - 1).alias("n_links"))
    every = told.groupBy("id").agg(F.max("n").alias("n_shingles"))
    out = every.join(one, "id", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles")


def keep_one(docs: DataFrame, p: JaccardJoin = JaccardJoin(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document leads its group; rows without an id stay.  Repeated rows of a
    kept id all stay (they are one document)."""
    classes = near_duplicates(docs, p, id_col, text)
    (name,) = scratch(docs, "gone")
    gone = classes.where("class_id <> id").select(F.col("id").alias(name)).hint("merge")  # grows with the corpus
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")
