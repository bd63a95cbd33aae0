import math
import re
from collections import Counter

from cloakframe.llm.quality_rules import QualityRules, apply_rules, derived_threshold, labelled, log_ratios

from .conftest import make_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark, edge_docs, labels):
    out = apply_rules(edge_docs, labels).collect()
    assert len(out) == 12
    for r in out:
        n, chars, symbols, dup, rep = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)
        assert r._words == "x"  # foreign columns pass


def test_repeats_of_many_kinds(spark, labels):
    texts = ["a b c a b c a b c", "a a a a a", "x y z " * 300, " ".join(f"p{i} q{i} r{i} p{i} q{i} r{i}" for i in range(400)), "l\nl\n\nl\nm | # <b>", "a\x0bb\x0cc d\re"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in apply_rules(df, labels).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text)


def test_ratio_matches_brute_force_and_rejects_junk(spark):
    rows = [(i, " ".join(make_words(i, 120))) for i in range(60)] + [(100 + i, " ".join(w + "###" for w in make_words(i, 120))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    rules = QualityRules(buckets=1 << 20)
    got = {r.doc_id: r for r in apply_rules(docs, marks, rules).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[100 + i].kept for i in range(20))
    half = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "pmod(xxhash64(text), 2) AS h").collect()}
    grams = {i: [*t.split(), *zip(t.split(), t.split()[1:], strict=False)] for i, t in rows}
    raw = Counter(g for x in grams.values() for g in x)

    def llr(i, trusted):
        target = Counter(g for k in trusted for g in grams[k])
        part = sum(target.values()) / sum(raw.values())
        return sum(math.log((target[g] + rules.alpha) / (raw[g] * part + rules.alpha)) for g in grams[i]) / len(grams[i])

    for i, _ in rows[::7]:
        assert abs(got[i].llr - llr(i, range(30))) < 2e-3  # exact but for n-grams that share a bucket
    out = {i: llr(i, [k for k in range(30) if half[k] != half[i]]) for i in [*range(30), *range(100, 110)]}
    want = (min(out[i] for i in range(30)) + max(out[i] for i in range(100, 110))) / 2
    marked = labelled(docs, marks, rules)
    ratios = log_ratios(docs, marked, rules)
    assert abs(derived_threshold(marked, ratios, rules) - want) < 2e-3
    alone = derived_threshold(marked.where("good"), ratios, rules)
    assert labelled(docs, marks, QualityRules(broadcast_rows=0)).count() == marked.count() == 40
    assert abs(alone - (2 * min(out[i] for i in range(30)) - sorted(out[i] for i in range(30))[14])) < 4e-3
    fixed = apply_rules(docs, marks, QualityRules(threshold=1e9)).collect()
    assert not any(r.kept for r in fixed)


def test_unigrams_and_no_labels(spark, no_labels, empty_docs, labels):
    docs = spark.createDataFrame([(i, " ".join(make_words(i, 90))) for i in range(6)], "doc_id long, text string")
    assert all(r.llr == 0.0 and r.kept for r in apply_rules(docs, no_labels).collect())
    assert apply_rules(docs, labels, QualityRules(order=1)).count() == 6
    assert apply_rules(empty_docs, labels).count() == 0
