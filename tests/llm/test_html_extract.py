import math

from cloakframe.llm.html_extract import Extraction, extract, main_text, mark, parse, path_scores

BODY = [f"Paragraph {i} has several words, some commas, and a full stop. It goes on for a while." for i in range(6)]


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>x';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav>{before}{article}{after}<footer>&copy; all rights, etc.</footer></body></html>"


def test_article_with_boilerplate_around():
    article = "<article><h1>A title</h1>" + "".join(f"<p>{b}</p>" for b in BODY) + "<p>Short.</p></article>"
    noise = "<div class='ad'>Buy now, cheap, good.</div><aside>Side text, with commas, and dots.</aside><div id='cookie-notice'>We use cookies, ok.</div><form>Name, <input> please.</form>"
    comments = "<section class='comments'><p>Reader one says, well, this.</p></section><!-- <p>hidden</p> -->"
    assert main_text(page(article, noise, comments)) == "\n".join(["A title", *BODY, "Short."])


def test_references_white_space_and_broken_markup():
    html = page("<article><h1>x &amp; y\n\t z&nbsp;&eacute;</h1><p><b>open.<br><p>next <i>one</i>, here; &lt;tag&gt;." + "".join(f"<p>{b}" for b in BODY))
    assert main_text(html).split("\n")[:3] == ["x & y z é", "open.", "next one, here; <tag>."]


def test_pages_without_semantic_elements():
    content = "<div><h2>Head</h2>" + "".join(f"<p>{b}</p>" for b in BODY) + "</div>"
    html = f"<body><table><tr><td><a href=1>One</a></td><td><a href=2>Two</a></td></tr></table><div>{content}</div><div><ul><li><a href=3>More</a></li></ul></div></body>"
    assert main_text(html) == "\n".join(["Head", *BODY])


def test_deep_and_unclosed_markup():
    deep = "<div>" * 100_000 + "".join(f"<p>{b}" for b in BODY)
    assert main_text(deep) == "\n".join(BODY)
    assert main_text("<article>" + "<p>some, text. " * 20_000).count("\n") == 19_999


def test_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<nav>only</nav>"), (4, "u", "no tags at all, really."), (4, "u", "no tags at all, really."), (None, None, "<p" + " x" * 1000), (5, "u", page("<article>" + "".join(f"<p>{b}</p>" for b in BODY * 500) + "</article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' AS text", "'x' AS n_chars", "1 AS extra")
    out = extract(df).collect()
    assert len(out) == 7 and all(r.n_chars == len(r.text) and r.extra == 1 for r in out)
    by = {r.page_id: r.text for r in out}
    assert by[1] == by[2] == by[3] == "" and by[4] == "no tags at all, really." and by[5].count("\n") == 2999
    assert extract(df.limit(0)).count() == 0


def brute_scores(rows, sigma):
    """Mean fused ratio by path for rows (path, text length outside links, punctuation marks)."""
    mean = lambda xs: sum(xs) / len(xs)
    by = {q: (mean([t for p, t, _ in rows if p == q]), mean([m for p, _, m in rows if p == q])) for q in {p for p, _, _ in rows}}
    out = {q: [] for q in by}
    reach = max(1, math.ceil(3 * sigma))
    for i, (path, _, _) in enumerate(rows):
        near = [(math.exp(-((i - j) ** 2) / (2 * sigma**2)), by[rows[j][0]]) for j in range(len(rows)) if abs(i - j) <= reach]
        weight = sum(k for k, _ in near)
        out[path].append(math.sqrt(sum(k * v[0] for k, v in near) / weight * (1 + sum(k * v[1] for k, v in near) / weight)))
    return {q: mean(v) for q, v in out.items()}


def test_path_scores_against_brute_force():
    tail = "<ul>" + "".join(f"<li><a href=/{i}>link {i}</a> x</li>" for i in range(9)) + "</ul>"
    html = "<body><div><h1>A title</h1>" + "".join(f"<p>{b}</p>" for b in BODY) + f"<p>Short.</p></div>{tail}</body>"
    parsed = parse(html)
    mark(parsed, Extraction())
    rows = [("h1", 7, 0), *[("p", len(b), b.count(",") + b.count(".")) for b in BODY], ("p", 6, 1), *[("li", 2, 0)] * 9]
    for sigma in (0.5, 1.0, 2.0):
        got = path_scores(parsed.blocks, Extraction(sigma=sigma))
        names = {b.element.path: b.element.tag for b in parsed.blocks}
        want = brute_scores(rows, sigma)
        assert {names[k] for k in got} == set(want)
        assert all(math.isclose(v, want[names[k]], rel_tol=1e-9) for k, v in got.items())


def test_the_ratios_choose_the_blocks():
    html = "<body><div><h1>Head</h1>" + "".join(f"<p>{b}</p>" for b in BODY) + "</div><ul>" + "".join(f"<li>item {i}</li>" for i in range(9)) + "</ul></body>"
    assert main_text(html, Extraction(share=1e-9)) == "\n".join(["Head", *BODY, *[f"item {i}" for i in range(9)]])
    assert main_text(html, Extraction(share=0.5)) == "\n".join(["Head", *BODY])
    assert main_text(html, Extraction(share=0.9)) == "\n".join(BODY)


def test_names_are_evidence_and_no_verdict():
    paragraphs = "".join(f"<p>{b}</p>" for b in BODY)
    for wrapper in ("layout has-sidebar", "no-comments", "left-side", "social", "cash-register"):
        assert main_text(f"<body><div class='{wrapper}'><article>{paragraphs}</article></div></body>") == "\n".join(BODY)
    part = "<section id='side-effects'><p>Side effects, rare, are these.</p></section><p class='market-share'>It fell, they said.</p>"
    assert main_text(f"<article>{paragraphs}{part}</article>").endswith("Side effects, rare, are these.\nIt fell, they said.")
    noise = "<div class='site-nav'>Go here, or there.</div><div class='share'>Tell, all.</div><div role='search'>Find, it.</div><section class='comments'>" + "<p>I say, long and loud, that this is so.</p>" * 40 + "</section>"
    assert main_text(f"<body>{noise}<article>{paragraphs}</article></body>") == "\n".join(BODY)


def test_mathematics_titles_tables_and_teasers():
    paragraphs = "".join(f"<p>{b}</p>" for b in BODY)
    table = "<table>" + "".join(f"<tr><td>{i}</td><td>v{i}</td></tr>" for i in range(30)) + "</table>"
    html = f"<main><h1>Title before</h1><article>{paragraphs}<p>Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, we see.</p>{table}{paragraphs}</article><article><h3>Other story</h3><p>Read on, it is good.</p></article></main>"
    out = main_text(html).split("\n")
    assert out[0] == "Title before" and "Then x=2 holds, we see." in out and "v29" in out and out[-1] == BODY[-1] and "Other story" not in out


def test_open_elements_end_at_the_next_block():
    paragraphs = "".join(f"<p>{b}</p>" for b in BODY)
    for tag in ("button", "svg", "select"):
        assert main_text(f"<article>{paragraphs}<{tag}>go <p>after, this one.</p></article>").endswith("after, this one.")
        assert main_text(f"<article>{paragraphs}<{tag}><p>not, read.</p></{tag}><p>after, this one.</p></article>").endswith(BODY[-1] + "\nafter, this one.")
    assert main_text(f"<html><head><title>No</title><body><article>{paragraphs}") == "\n".join(BODY)
    assert main_text("<button>x" * 20_000 + f"<article>{paragraphs}</article>") == "\n".join(BODY)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "<p>Some, text.</p>", "mine")], "page_id long, html string, _html string")
    assert extract(df).first().asDict() == {"page_id": 1, "_html": "mine", "text": "Some, text.", "n_chars": 11}


def real_pages():
    import pathlib

    import pyarrow.parquet as pq
    import pytest

    path = pathlib.Path("/root/testdata/sf0.01/pages.parquet")
    if not path.exists():
        pytest.skip("the given tables are not here")
    return [h for h in pq.read_table(path).column("html").to_pylist() if h]


def test_the_default_share_decides_on_the_given_pages():
    """At half and at one and a half times the default share other blocks come in or go; at the default the paragraphs of every article are
    whole and nothing of a menu, footer, form or remark is left."""
    import re

    pages, p = real_pages(), Extraction()
    texts = [main_text(h) for h in pages]
    for factor in (0.5, 1.5):
        assert sum(main_text(h, Extraction(share=factor * p.share)) != t for h, t in zip(pages, texts, strict=True)) >= 3
    for html, text in zip(pages, texts, strict=True):
        kept = set(text.split("\n"))
        for part in re.findall(r"(?s)<(?:nav|footer|form)\b.*?</(?:nav|footer|form)>", html):
            if re.search("(?i)<article|<main", part):
                continue
            blocks = [re.sub(r"\s+", " ", re.sub("<[^>]+>", "", b)).strip() for b in re.split("(?i)</?(?:p|div|li|ul)[^>]*>", part)]
            assert not [b for b in blocks if len(b) > 20 and b in kept]


def test_evidence_and_ratio_are_one_score():
    """Without doubt being a reason to score less, boilerplate with much text and punctuation is content."""
    loud = "<footer><p>All of this, and that, is ours, said they; so it is, and so it stays, they said, again.</p></footer>"
    html = "<body><article>" + "".join(f"<p>{b}</p>" for b in BODY) + f"</article>{loud}</body>"
    assert main_text(html) == "\n".join(BODY) and "ours" in main_text(html, Extraction(doubt=1.0)) and "ours" in main_text(html, Extraction(share=0.05))
