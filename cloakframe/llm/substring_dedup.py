"""Removal of long repeated passages by seed and extend.

Seeds.  Every frame of ``min_words`` consecutive words names one anchor: the ``anchor_words``-gram in it
with the least hash (leftmost on ties).  Equal frames name equal anchors, so documents that share a
frame meet on an anchor, while only about 2/(min_words - anchor_words + 2) of the positions are anchors.

Extension.  An anchor's occurrence carries its reach: the run of words covered by all the frames that
name it, to the left and the right.  Where every occurrence of an anchor has the same reach, the match
extends over all of it.  Where reaches differ, one occurrence for each distinct reach is extended frame
by frame: frames are matched by their words' hash under the same anchor.  So the work is linear in the
anchors and frames; no pairs of documents are made, however many share a passage.

Maximal repeats.  Frames already found in a document with a smaller ``doc_id`` are merged into spans;
their words are removed.  Frames are judged on the input, and only other, smaller ids count, so the
first document of a passage keeps it.

A frame is identified by a pair of 64-bit hashes (its anchor's and its own).

Defined results: null, empty and short texts are unchanged (no frames); repeated rows of one id do not
remove each other's words; rows with a null id are neither sources nor changed; ties cannot occur, as
only strictly smaller ids count; an empty table gives an empty result; extra columns pass through.
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
class SubstringDedup:
    min_words: int = 50
    anchor_words: int = 25


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least value in each run of ``width`` values."""
    best, pos, reach = values, np.arange(len(values), dtype=np.int64), 1
    while reach < width:
        step = min(reach, width - reach)
        right = best[step:] < best[: len(best) - step]
        pos = np.where(right, pos[step:], pos[: len(pos) - step])
        best = np.where(right, best[step:], best[: len(best) - step])
        reach += step
    return pos


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _seeds(batches: Iterator[pa.RecordBatch], p: SubstringDedup) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in W.chunks(batch):
            w = W.split(texts)
            starts = W.inside(w.rows, p.min_words)
            if not len(starts):
                continue
            h = w.hashes()
            runs = W.Ranges(h)
            grams = W.spans(h, p.anchor_words)
            at = sliding_argmin(grams, p.min_words - p.anchor_words + 1)[starts]
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            first, last = starts[cuts], starts[np.r_[cuts[1:], len(starts)] - 1]
            at = at[cuts]
            with np.errstate(over="ignore"):
                shape = ((at - first) * 65536 + (last - first)).astype(np.uint64)
                reach = W.mix(runs.of(first, last + p.min_words) ^ W.mix(shape + np.uint64(1)))
            row = np.searchsorted(w.rows, first, side="right") - 1
            base = w.rows[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [_signed(grams[at]), _signed(reach), part.column("id").take(take), part.column("fp").take(take), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))],
                names=["anchor", "reach", "id", "fp", "first", "last"],
            )


def _frames(batches: Iterator[pa.RecordBatch], p: SubstringDedup) -> Iterator[pa.RecordBatch]:
    """Every frame of the occurrences listed with a document, by its hash under its anchor."""
    for batch in batches:
        for part, texts in W.chunks(batch):
            w = W.split(texts)
            runs = W.Ranges(w.hashes())
            lists = part.column("seeds")
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            anchor, first, last = (flat.field(k).to_numpy() for k in ("anchor", "first", "last"))
            n = (last - first + 1).astype(np.int64)
            which = np.repeat(np.arange(len(n)), n)
            s = first[which] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
            at = w.rows[row[which]] + s
            take = pa.array(row[which])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[which]), _signed(runs.of(at, at + p.min_words)), part.column("id").take(take), part.column("fp").take(take), pa.array(s.astype(np.int32))],
                names=["anchor", "frame", "id", "fp", "first"],
            )


def repeats(docs: DataFrame, p: SubstringDedup = SubstringDedup(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of words to remove: id, fp (hash of the text, tells rows of one id apart), first and end (exclusive)."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text}`").alias("fp"), F.col(f"`{text}`").alias("text")).where("id IS NOT NULL")
    kind = dict(slim.dtypes)["id"]
    anchors = slim.mapInArrow(partial(_seeds, p=p), f"anchor long, reach long, id {kind}, fp long, first int, last int")
    # groups are written before they are joined: a join on an exchange of its own can be split when an
    # anchor is hot, one on top of the grouping's exchange cannot
    shared = cut(
        anchors.groupBy("anchor")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("reach").alias("r0"), F.max("reach").alias("r1"))
        .where("lo < hi").select("anchor", "lo", (F.col("r0") == F.col("r1")).alias("alike")),
        "shared",
    )
    hits = cut(anchors.join(shared, "anchor").where("NOT alike OR id > lo"), "anchors")
    mixed = hits.where("NOT alike")
    leads = cut(mixed.groupBy("anchor", "reach").agg(F.min("id").alias("lead")), "leads")
    led = cut(mixed.drop("lo").join(leads, ["anchor", "reach"]), "reaches")
    whole = hits.where("alike").select("id", "fp", "first", "last").union(led.where("id > lead").select("id", "fp", "first", "last"))
    whole = whole.select("id", "fp", "first", (F.col("last") + p.min_words).alias("end"))
    lists = led.where("id = lead").groupBy("id", "fp").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("seeds"))
    frames = cut(slim.join(lists, ["id", "fp"]).mapInArrow(partial(_frames, p=p), f"anchor long, frame long, id {kind}, fp long, first int"), "frames")
    least = cut(frames.groupBy("anchor", "frame").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").drop("hi"), "least")
    single = frames.join(least, ["anchor", "frame"]).where("id > lo").select("id", "fp", "first", (F.col("first") + p.min_words).alias("end"))
    return whole.union(single)


def _removed(batches: Iterator[pa.RecordBatch], names: list[str], text: str, found: str) -> Iterator[pa.RecordBatch]:
    n_words, n_removed, kept_text, spans = names
    for batch in batches:
        for part, texts in W.chunks(batch, text):
            w = W.split(texts)
            lists = part.column(found)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            edge = np.zeros(len(w.start) + 1, dtype=np.int64)
            if len(row):
                np.add.at(edge, w.rows[row] + flat.field("first").to_numpy(), 1)
                np.add.at(edge, w.rows[row] + flat.field("end").to_numpy(), -1)
            gone = np.cumsum(edge[:-1]) > 0
            total = np.r_[0, np.cumsum(gone)]
            removed = total[w.rows[1:]] - total[w.rows[:-1]]
            keep = np.flatnonzero(~gone)
            krow = np.searchsorted(w.rows, keep, side="right") - 1
            final = np.r_[krow[1:] != krow[:-1], True] if len(keep) else np.empty(0, dtype=bool)
            mark = np.zeros(len(w.data) + 1, dtype=np.int8)
            np.add.at(mark, w.start[keep], 1)
            np.add.at(mark, np.minimum(w.end[keep] + ~final, len(w.data)), -1)
            mask = np.cumsum(mark[:-1], dtype=np.int8) > 0
            out = w.data.copy()
            out[w.end[keep[~final]]] = 32
            sizes = np.bincount(krow, weights=(w.end[keep] - w.start[keep] + ~final), minlength=len(texts)).astype(np.int64)
            offsets = np.r_[0, np.cumsum(sizes)]
            kept = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[mask].tobytes()))
            merged = _merged(gone, w.rows)
            cols = {n_words: pa.array(w.counts()), n_removed: pa.array(removed), kept_text: kept.cast(pa.string()), spans: merged}
            have = {k: part.column(k) for k in part.schema.names if k not in (text, found)}
            yield pa.RecordBatch.from_pydict(have | cols)


def _merged(gone: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Maximal runs of removed words of each row, as word offsets within the row."""
    n = len(gone)
    before = np.r_[False, gone[:-1]] if n else gone
    head = np.zeros(n + 1, dtype=bool)
    head[rows[:-1]] = True
    first = np.flatnonzero(gone & (~before | head[:n]))
    after = np.r_[gone[1:], False] if n else gone
    end = np.flatnonzero(gone & (~after | head[1 : n + 1])) + 1
    row = np.searchsorted(rows, first, side="right") - 1
    kind = pa.struct([("first", pa.int32()), ("end", pa.int32())])
    values = pa.StructArray.from_arrays([pa.array((first - rows[row]).astype(np.int32)), pa.array((end - rows[row]).astype(np.int32))], names=["first", "end"])
    offsets = np.searchsorted(row, np.arange(len(rows))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values.cast(kind))


OUTPUTS = ("n_words", "n_removed", "kept_text", "removed_spans")


def remove_repeats(docs: DataFrame, p: SubstringDedup = SubstringDedup(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its text column, with n_words, n_removed, kept_text (kept words joined by one
    space) and removed_spans (maximal repeats, array of first and end word)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUTPUTS and c != text])
    key, fp, raw, spans = scratch(docs, "dedup_key", "dedup_fp", "dedup_text", "dedup_spans")
    found = repeats(docs, p, id_col, text).groupBy("id", "fp").agg(F.collect_list(F.struct("first", "end")).alias(spans))
    found = found.withColumnsRenamed({"id": key, "fp": fp})
    base = docs.withColumn(raw, F.col(f"`{text}`")).drop(text)
    joined = base.join(found, (F.col(f"`{id_col}`") == F.col(key)) & (F.xxhash64(raw) == F.col(fp)), "left").drop(key, fp)
    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.drop(raw).schema)
    schema = f"{keep}, n_words long, n_removed long, kept_text string, removed_spans array<struct<first:int,end:int>>"
    return joined.mapInArrow(partial(_removed, names=list(OUTPUTS), text=raw, found=spans), schema)
