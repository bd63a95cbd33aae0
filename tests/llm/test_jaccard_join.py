import random
import re
from collections import Counter, defaultdict

import pytest

from cloakframe.llm.components import components
from cloakframe.llm.jaccard_join import JaccardJoin, floors, keep_one, near_duplicates

from .conftest import make_words


def sets(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    s = {i: sets(t) for i, t in rows}
    links, group = defaultdict(int), {i: i for i in s}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(s[a] & s[b])
            if s[a] and 5 * both >= 4 * (len(s[a] | s[b])):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return {i: (find(i), links[i]) for i in s}


def family(seed, n, size, edits):
    r = random.Random(seed)
    base = make_words(seed, size, 3000)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_matches_brute_force(spark, block):
    texts = family(1, 40, 150, 5) + family(2, 12, 90, 2) + [" ".join(make_words(50 + i, 60, 3000)) for i in range(40)] + ["a b", "a b", "a b c", "", " ", "x"]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), JaccardJoin(block=block)).collect()
    assert {r.id: (r.class_id, r.n_links) for r in got} == brute(rows)


def test_edges(spark, edge_docs, empty_docs):
    got = {r.id: r for r in near_duplicates(edge_docs).collect()}
    assert len(got) == 10  # nine ids and null
    assert got[2].class_id == 1 and got[1].n_links == 2 and got[9].class_id == 1  # 80 and 83 words
    assert got[3].n_links == got[4].n_links == 0 and got[3].class_id == 3 and got[None].class_id is None
    left = keep_one(edge_docs)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8] and left.count() == 9
    assert near_duplicates(empty_docs).count() == 0


def test_an_id_with_several_texts(spark):
    a, b, c = family(21, 3, 120, 2), family(22, 3, 100, 2), family(23, 2, 90, 1)
    rows = [(1, a[0]), (1, b[0]), (1, b[0]), (2, a[1]), (3, a[2]), (4, b[1]), (4, " "), (5, b[2]), (5, c[0]), (6, c[1]), (7, "one of its own"), (1, "")]
    got = {r.id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(list(enumerate(t for _, t in rows)))  # every row a document of its own
    links = {i: max(len({j for j, (k, u) in enumerate(rows) if k != i and (sets(t) and 5 * len(sets(t) & sets(u)) >= 4 * len(sets(t) | sets(u)))}) for k, t in rows if k == i) for i in range(1, 8)}
    links[4] -= 1  # text b of document 1 stands in two rows, which are one
    links[5] -= 1
    assert len({w[0] for w in want.values()}) == 6 and {i: r.n_links for i, r in got.items()} == links
    assert {i: r.class_id for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7}


def test_pruning_keeps_what_may_reach_the_threshold():
    p = JaccardJoin()
    least = floors(p)
    assert least == sorted(least) and 60 < least[-1] < 0.8 * p.hashes


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 40)]
    group = {}

    def find(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        group[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


def test_links_of_whole_table_against_all_pairs(spark):
    """Every pair of documents of the smallest table at the threshold or above is found, and no other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        if w:
            sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    both = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    links = Counter()
    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
    got = {r.id: r.n_links for r in near_duplicates(docs).collect()}
    assert len(links) > 100 and all(got[i] == links[i] for i in got)
