"""JSON documents: strict parsing, flattening to leaves, and masking of leaves in place."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("keep", "mask", "text", "redact", "drop")


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key is repeated")
    return out


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


def strict(document: str):
    """The parsed document, or a ValueError if it is no JSON (repeated keys, NaN and nesting deeper than
    the parser's stack included)."""
    try:
        return json.loads(document, object_pairs_hook=_unique, parse_constant=_constant)
    except RecursionError as e:
        raise ValueError("the document is nested too deeply") from e


def _leaves(root: list) -> Iterator[tuple[list | dict, str | int, str]]:
    """(container, key, path) of every scalar below ``root``, a list of the one document, in document order;
    array elements share the path ``p[]``.  It keeps its own stack, so depth is no limit."""
    stack = [(root, 0, "")]
    while stack:
        container, key, path = stack.pop()
        value = container[key]
        if isinstance(value, dict):
            stack.extend((value, k, f"{path}.{k}" if path else k) for k in reversed(value))
        elif isinstance(value, list):
            stack.extend((value, i, f"{path}[]") for i in reversed(range(len(value))))
        else:
            yield container, key, path


def _plain(text: str) -> str:
    """Without halves of surrogate pairs, which JSON can escape and Arrow cannot hold."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


def _text(value) -> str | None:
    """A scalar as text."""
    return None if value is None else _plain(value) if isinstance(value, str) else json.dumps(value)


LEAF = pa.struct([("path", pa.string()), ("value", pa.string()), ("action", pa.string()), ("kind", pa.string()), ("nth", pa.int32())])
LEAVES = "array<struct<path:string,value:string,action:string,kind:string,nth:int>>"


def _read(batches: Iterator[pa.RecordBatch], column: str, name: str, decide: Callable[..., tuple[str, str | None]] | None, invalid: str, by: str | None) -> Iterator[pa.RecordBatch]:
    """Adds the leaves of each document with what ``decide`` says of their paths (and of the row's value of ``by``); ``nth`` numbers those with the action text.  A
    blank document has none."""
    decided = lru_cache(65_536)(decide or (lambda path: ("keep", None)))

    def leaves(document: str | None, *more) -> list[dict] | None:
        if document is None:
            return None
        if not document.strip():
            return []
        try:
            root = [strict(document)]
        except ValueError as e:
            if invalid == "raise":
                raise ValueError(f"a value of {column} is no JSON document: {type(e).__name__}") from None
            return None
        out, nth = [], 0
        for container, key, path in _leaves(root):
            path, value = _plain(path), container[key]
            action, kind = decided(path, *more)
            if action not in ACTIONS:
                raise ValueError(f"unknown action for {path}: {action}")
            action = "keep" if value is None or isinstance(value, bool) else action
            out.append({"path": path, "value": _text(value), "action": action, "kind": kind, "nth": nth})
            nth += action == "text"
        return out

    for batch in batches:
        used = [batch.column(c).to_pylist() for c in ((column, by) if by else (column,))]
        found = pa.array([leaves(*x) for x in zip(*used, strict=True)], pa.list_(LEAF))
        yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])


def _laid_out(value, document: str) -> str:
    """A value as JSON in the layout of the document: one of several lines is written on several lines, one that ends in a line break ends in one."""
    layout = {"indent": 2} if "\n" in document.rstrip() else {"separators": (",", ":")}
    return _plain(json.dumps(value, ensure_ascii=False, allow_nan=False, **layout)) + "\n" * document.endswith("\n")


def _write(batches: Iterator[pa.RecordBatch], column: str, name: str) -> Iterator[pa.RecordBatch]:
    """Puts the column ``name`` back, leaf by leaf in the order of ``_read``: null leaves the leaf and its type."""

    def written(document: str | None, new: list | None) -> str | None:
        if document is None or new is None:
            return None
        if not any(x is not None for x in new):
            return document
        root = [strict(document)]
        for (container, key, _), x in zip(list(_leaves(root)), new, strict=True):
            if x is not None:
                container[key] = x
        return _laid_out(root[0], document)

    for batch in batches:
        out = pa.array([written(d.as_py(), n.as_py()) for d, n in zip(batch.column(column), batch.column(name), strict=True)], pa.string())
        names = [n for n in batch.schema.names if n != name]
        yield pa.RecordBatch.from_arrays([out if n == column else batch.column(n) for n in names], names=names)


def _schema(df: DataFrame, more: str = "") -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + more


def with_leaves(df: DataFrame, column: str, decide: Callable[..., tuple[str, str | None]] | None = None, invalid: str = "null", name: str = "_leaves", by: str | None = None) -> DataFrame:
    """``df`` with the scalar leaves of a JSON column as an array of struct(path, value, action, kind, nth); ``decide(path)``, or with the
    column ``by`` ``decide(path, its value)``, says what is to be done with each."""
    return df.mapInArrow(partial(_read, column=column, name=name, decide=decide, invalid=invalid, by=by), _schema(df, f", `{name}` {LEAVES}"))


def put_back(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the array ``name``, new values of the leaves in their order (null: as it was), written into the JSON column."""
    return df.mapInArrow(partial(_write, column=column, name=name), _schema(df.drop(name)))


def _strings(root: list) -> list[tuple[list | dict, str | int]]:
    """(container, key) of the leaves that are strings."""
    return [(container, key) for container, key, _ in _leaves(root) if isinstance(container[key], str)]


def _empty(batches: Iterator[pa.RecordBatch], column: str, texts: str, hollow: str, invalid: str) -> Iterator[pa.RecordBatch]:
    """Takes the strings out of each document, which is left as a frame without them (``hollow``); one that would be laid out otherwise
    when they are put back stays whole."""

    def parts(document: str | None) -> tuple[str | None, list[str] | None, bool]:
        if document is None or not document.strip():
            return document, None if document is None else [], False
        try:
            root = [strict(document)]
        except ValueError as e:
            if invalid == "raise":
                raise ValueError(f"a value of {column} is no JSON document: {type(e).__name__}") from None
            return None, None, False
        places = _strings(root)
        found = [_plain(container[key]) for container, key in places]
        if not places or _laid_out(root[0], document) != document:
            return document, found, False
        for container, key in places:
            container[key] = ""
        return _laid_out(root[0], document), found, True

    for batch in batches:
        frames, found, flags = zip(*map(parts, batch.column(column).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
        more = [pa.array(found, pa.list_(pa.string())), pa.array(flags, pa.bool_())]
        kept = [pa.array(frames, pa.string()) if n == column else batch.column(n) for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*kept, *more], names=[*batch.schema.names, texts, hollow])


def _fill(batches: Iterator[pa.RecordBatch], column: str, texts: str, hollow: str) -> Iterator[pa.RecordBatch]:
    """Puts the strings, changed or not, back into what ``_empty`` left; a whole document without a change stays as it is written."""

    def filled(document: str | None, new: list[str] | None, empty: bool) -> str | None:
        if document is None or new is None:
            return None
        root = [strict(document)] if document.strip() else []
        places = _strings(root) if root else []
        if not places:
            return document
        changed = empty
        for (container, key), x in zip(places, new, strict=True):
            if empty or _plain(container[key]) != x:
                container[key], changed = x, True
        return _laid_out(root[0], document) if changed else document

    for batch in batches:
        out = pa.array([filled(*x) for x in zip(*[batch.column(c).to_pylist() for c in (column, texts, hollow)], strict=True)], pa.string())
        names = [n for n in batch.schema.names if n not in (texts, hollow)]
        yield pa.RecordBatch.from_arrays([out if n == column else batch.column(n) for n in names], names=names)


def emptied(df: DataFrame, column: str, texts: str, hollow: str, invalid: str = "null") -> DataFrame:
    """``df`` with the strings of a JSON column as an array ``texts``, and the documents without them where ``hollow`` says so: what is
    written holds every string once."""
    return df.mapInArrow(partial(_empty, column=column, texts=texts, hollow=hollow, invalid=invalid), _schema(df, f", `{texts}` array<string>, `{hollow}` boolean"))


def refilled(df: DataFrame, column: str, texts: str, hollow: str) -> DataFrame:
    """The documents of ``emptied`` with the strings in ``texts``."""
    return df.mapInArrow(partial(_fill, column=column, texts=texts, hollow=hollow), _schema(df.drop(texts, hollow)))


def flatten(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, path, value): every scalar leaf of a JSON column at any depth; array elements share the path
    ``p[]``.  A text that is no JSON has no leaves."""
    found = with_leaves(df.select(F.col(id_col).alias("id"), F.col(column).alias("document")), "document")
    return found.select("id", F.explode("_leaves").alias("x")).select("id", "x.path", "x.value")


def redact(value: Column, names: list[str]) -> Column:
    """A flat JSON object of numbers or strings with the named members elided, as text."""
    parsed = F.from_json(value, "map<string,string>")
    return F.to_json(F.transform_values(parsed, lambda k, v: F.when(F.lower(k).isin([n.lower() for n in names]), F.lit("[ELIDED]")).otherwise(v)))


def mask_json(df: DataFrame, id_col: str, column: str, decide: Callable[[str], tuple[str, str | None]], mask: Callable[[str, Column], Column], invalid: str = "raise") -> DataFrame:
    """Masks the leaves of a JSON column in place, whatever their number, paths and depth.  ``decide(path)``
    -> (action, kind) runs where the rows are; only the kinds it masks, which are few, come to the driver.
    ``mask(kind, value)`` is a native column expression.  Leaves stay in their row, so ``id_col`` need not be
    unique.  Null and true or false stay; of the others a masked one becomes a string, one that did not
    change keeps its type.  A text that is no JSON ends the job, or
    becomes null if ``invalid`` is "null"; it never passes as it is."""
    if invalid not in ("raise", "null"):
        raise ValueError(f"unknown treatment of invalid documents: {invalid}")
    found = with_leaves(df, column, decide, invalid)
    kinds = [r["kind"] for r in found.select(F.explode("_leaves").alias("x")).where("x.action = 'mask'").select("x.kind").distinct().collect()]

    def changed(x: Column) -> Column:
        new = F.when(x["action"] == "redact", F.lit("[ELIDED]")).when(x["action"] == "drop", F.lit(""))
        for kind in kinds:
            new = new.when((x["action"] == "mask") & x["kind"].eqNullSafe(F.lit(kind)), mask(kind, x["value"]))
        return F.when(new != x["value"], new)

    done = found.withColumn("_new", F.transform("_leaves", changed)).drop("_leaves")
    return put_back(done, column, "_new")
