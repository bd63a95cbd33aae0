"""Quality rules: surface counts plus a hashed n-gram log-likelihood ratio.

The verdict of a document is

    llr = mean over its one- and two-word n-grams g of  log(p_target(g) / p_raw(g))

where both multinomials are smoothed counts over ``buckets`` hash buckets: ``raw`` counts every n-gram of
the whole corpus, ``target`` those of trusted documents (labelled quality 1).  The target adds ``alpha``
to each bucket, the raw corpus as much more as it is larger, so smoothing weighs the same in both and
the ratio of an n-gram without evidence is 1 at every size of corpus.  The mean makes it length-normalised; ``llr >= threshold`` decides each
document by itself, so equal texts always get equal verdicts.

The threshold comes from the labelled documents: each is scored with the target counts of the other half
of the trusted ones (halves by hash of the text, so copies stay together), and the threshold is the middle
between the ``lowest`` quantile of the trusted documents' ratios and the ``highest`` quantile of the others' (labelled
quality 0).  Without documents of quality 0 it lies as far below the trusted ones' quantile as that lies below their
median; without trusted documents nothing is rejected.
A number given as ``threshold`` is used as it is.

Only DataFrame functions are used, and texts of the corpus are not shuffled: the corpus side is one scan that ends
in a partial aggregation over at most ``buckets`` keys; labelled documents (all of them) are met by a join, whose ids
are broadcast if they are counted to be at most ``broadcast_rows`` (beyond, it is a merge join), and are written as
bucket numbers; scoring is a projection.  What is sent to every task is the
table of ``buckets`` log ratios; what comes to the driver are counts of ratios rounded to 1e-4.

Defined results: null, empty and blank texts have no words, all counts 0, llr 0.0 and fail the base
rules; repeated rows are judged alike; an empty table gives an empty result; without labels the target
equals the raw corpus and every llr is 0.0.  Extra columns are passed through (clashing names of our
own outputs are replaced, working columns get free names).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut, discard, scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityRules:
    """``order`` is the longest n-gram counted, 1 or 2; ``threshold`` None: from the labels."""

    order: int = 2
    buckets: int = 16384
    alpha: float = 4.0
    threshold: float | None = None
    lowest: float = 0.001
    highest: float = 0.99
    min_words: int = 50
    max_repeat_percent: int = 50
    broadcast_rows: int = 1_000_000


def words(text: Column) -> Column:
    """Array of the words of a text, in order."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeated_words(hashed: str) -> Column:
    """Words lying in 3-word windows that occur at least twice.  ``hashed`` is a column with the hash of
    each word.  Values that meet an equal neighbour after sorting the windows' hashes are the repeated
    ones; the frames of three words at their positions are merged.  Looking up a window among few
    repeated values is a scan; among many, the windows are sorted with their positions instead.
    """
    w = f"`{hashed}`"
    windows = f"slice(transform({w}, (x, i) -> xxhash64(x, get({w}, i + 1), get({w}, i + 2))), 1, greatest(size({w}) - 2, 0))"
    merged = "aggregate({}, named_struct('n', 0L, 'e', 0), (a, p) -> named_struct('n', a.n + 3 - greatest(a.e - p, 0), 'e', p + 3), a -> a.n)"
    values = let("sort_array(h)", "s", "array_distinct(array_compact(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s)), (x, y) -> if(x = y, x, null))))")
    few = merged.format("array_compact(transform(h, (x, i) -> if(array_contains(d, x), i, null)))")
    ranked = "sort_array(transform(filter(s, (x, j) -> get(s, j - 1).h = x.h OR get(s, j + 1).h = x.h), x -> x.i))"
    many = let("sort_array(transform(h, (v, i) -> named_struct('h', v, 'i', i)))", "s", merged.format(ranked))
    found = let(values, "d", f"CASE WHEN size(d) <= 256 THEN {few} ELSE {many} END")
    return F.expr(let(windows, "h", f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {found} END"))


def with_counts(docs: DataFrame, tokens: str, hashed: str, text: str = "text") -> DataFrame:
    """Adds the five counts of the base rules; ``tokens`` and ``hashed`` are columns with the words and
    their hashes."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    (line_col,) = scratch(docs, "lines")
    return docs.withColumn(line_col, lines).withColumns(
        {
            "n_words": F.size(tokens).cast("long"),
            "word_chars": F.length(F.array_join(tokens, "")).cast("long"),
            "n_symbols": F.when(body.rlike(r"[#*$%&|<>]"), F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).otherwise(0).cast("long"),
            "n_dup_lines": (F.size(line_col) - F.size(F.array_distinct(line_col))).cast("long"),
            "n_repeat_words": repeated_words(hashed),
        }
    ).drop(line_col)


def base_failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def _grams(hashed: str, rules: QualityRules) -> str:
    """SQL for the buckets of all n-grams of a document with the word hashes ``hashed``."""
    n = rules.buckets
    one = f"transform({hashed}, x -> cast(pmod(x, {n}) AS int))"
    if rules.order == 1:
        return one
    return f"concat({one}, slice(transform({hashed}, (x, i) -> cast(pmod(xxhash64(x, get({hashed}, i + 1)), {n}) AS int)), 1, greatest(size({hashed}) - 1, 0)))"


def _hashes(text: str) -> Column:
    return F.transform(words(F.col(f"`{text}`")), lambda w: F.xxhash64(w))


def labelled(docs: DataFrame, labels: DataFrame, rules: QualityRules, text: str = "text") -> DataFrame:
    """(good, half, n, grams): the labelled documents, their words and the buckets of their n-grams; a label
    given twice counts as its maximum."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_marked")).agg((F.max("quality") >= 1).alias("good"))
    marks = F.broadcast(marks) if labels.count() <= rules.broadcast_rows else marks.hint("merge")
    slim = docs.select(F.col("doc_id").alias("_id"), F.col(f"`{text}`"))
    met = slim.join(marks, F.col("_id") == F.col("_marked")).select("good", F.pmod(F.xxhash64(f"`{text}`"), F.lit(2)).cast("int").alias("half"), _hashes(text).alias("_hashes"))
    return cut(met.select("good", "half", F.size("_hashes").alias("n"), F.expr(_grams("_hashes", rules)).alias("grams")), "labelled")


def log_ratios(docs: DataFrame, marked: DataFrame, rules: QualityRules, text: str = "text") -> DataFrame:
    """One row: arrays of ``buckets`` log ratios, ``ratios`` with all trusted documents and ``ratios_0`` and ``ratios_1``
    without those of that half."""
    buckets = F.explode(F.expr(_grams("_hashes", rules))).alias("b")
    raw = docs.select(_hashes(text).alias("_hashes")).select(buckets).groupBy("b").agg(F.count("*").alias("raw"))
    target = marked.where("good").select("half", F.explode("grams").alias("b")).groupBy("b").agg(F.count_if(F.col("half") == 0).alias("t0"), F.count_if(F.col("half") == 1).alias("t1"))
    every = docs.sparkSession.range(rules.buckets).select(F.col("id").cast("int").alias("b")).join(raw, "b", "left").join(target, "b", "left").na.fill(0)
    rows = F.array_sort(F.collect_list(F.struct("b", "raw", "t0", "t1")))
    table = every.agg(F.sum("raw").alias("raw"), F.sum("t0").alias("t0"), F.sum("t1").alias("t1"), rows.alias("rows"))

    def ratios(mine: str, total: str, name: str) -> Column:
        a = rules.alpha
        gain = f"coalesce(ln(({mine} + {a}D) / (x.raw * (({total}) / raw) + {a}D)), 0D)"
        return F.expr(f"transform(rows, x -> CASE WHEN ({total}) = 0 THEN 0D ELSE {gain} END)").alias(name)

    return table.select(ratios("(x.t0 + x.t1)", "t0 + t1", "ratios"), ratios("x.t1", "t1", "ratios_0"), ratios("x.t0", "t0", "ratios_1"))


def _mean_ratio(hashed: str, table: str, rules: QualityRules) -> str:
    """SQL for the mean log ratio of a document's n-grams."""
    n = rules.buckets
    total = f"aggregate({hashed}, 0D, (s, x) -> s + get({table}, cast(pmod(x, {n}) AS int)))"
    if rules.order > 1:
        pairs = f"slice(transform({hashed}, (x, i) -> xxhash64(x, get({hashed}, i + 1))), 1, greatest(size({hashed}) - 1, 0))"
        total += f" + aggregate({pairs}, 0D, (s, x) -> s + get({table}, cast(pmod(x, {n}) AS int)))"
    count = f"greatest(size({hashed}), 1)" if rules.order == 1 else f"greatest(2 * size({hashed}) - 1, 1)"
    return f"({total}) / {count}"


def _quantile(counts: list[tuple[int, int]], share: float) -> float:
    """The least value (in steps of 1e-4) that at least ``share`` of the rows do not exceed."""
    total, seen = sum(n for _, n in counts), 0
    for value, n in sorted(counts):
        seen += n
        if seen >= share * total:
            return value / 1e4
    return 0.0


def derived_threshold(marked: DataFrame, ratios: DataFrame, rules: QualityRules) -> float:
    """The threshold that the labelled documents give (see above); short and empty ones do not count."""
    long = marked.where(F.col("n") >= rules.min_words)
    scored = long.withColumn("_table", F.when(F.col("half") == 0, ratios.select("ratios_0").scalar()).otherwise(ratios.select("ratios_1").scalar()))
    bins = scored.select("good", F.floor(F.expr("aggregate(grams, 0D, (s, b) -> s + get(_table, b)) / size(grams)") * 10_000).alias("value")).groupBy("good", "value").agg(F.count("*").alias("n")).collect()
    good, poor = ([(r["value"], r["n"]) for r in bins if r["good"] == g] for g in (True, False))
    if not good:
        return float("-inf")
    low = _quantile(good, rules.lowest)
    return (low + _quantile(poor, rules.highest)) / 2 if poor else 2 * low - _quantile(good, 0.5)


def apply_rules(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the counts, ``base_failed``, ``llr`` and ``kept``."""
    ours = [*COUNTS, "base_failed", "llr", "kept"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ours])
    marked = labelled(docs, labels, rules, text)
    ratios = cut(log_ratios(docs, marked, rules, text), "ratios")
    threshold = derived_threshold(marked, ratios, rules) if rules.threshold is None else rules.threshold
    discard(marked)  # ratios and threshold are all that is read from here on
    hashed, tokens, table = scratch(docs, "hashes", "words", "ratios")
    out = docs.withColumn(tokens, words(F.col(f"`{text}`"))).withColumn(hashed, F.transform(tokens, lambda w: F.xxhash64(w)))
    out = with_counts(out, tokens, hashed, text).withColumn("base_failed", base_failed(rules))
    out = out.withColumn(table, ratios.select("ratios").scalar()).withColumn("llr", F.expr(_mean_ratio(f"`{hashed}`", f"`{table}`", rules)))
    return out.drop(tokens, hashed, table).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))


def keep(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept.  The optimiser would move a filter on ``kept`` below the
    columns it is made of and so put the splitting of a text into every step of the loops over its words;
    a row number that the filter looks at holds it back."""
    out = apply_rules(docs, labels, rules, text)
    (row,) = scratch(out, "row")
    out = out.withColumn(row, F.monotonically_increasing_id()).where(F.col("kept") & (F.col(row) >= 0))
    return out.select([F.col(f"`{c}`") for c in docs.columns if c in out.columns])
