import math
import random

import numpy as np
import pandas as pd
import pytest
from corpus import table
from pyspark.sql import functions as F

from slotwise.llm import top_k, wrappers


def _expected(vectors, k):
    whole = {}
    for i, v in vectors:
        if i is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    out = []
    for q in whole:
        if q % 10 == 0:
            for x in whole[q]:
                scores = [(-sum(a * b for a, b in zip(x, y)), i) for i, ys in whole.items() if i != q for y in ys]
                out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, queries", [(8192, 1024), (16, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, block, queries):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "QUERIES", queries)
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=6) * 10.0 ** rng.integers(-2, 2)]) for i in range(150)]
    vectors += [(200 + i, [0.5] * 6) for i in range(40)]  # ties
    vectors += [(300, None), (310, []), (320, [1.0, None] * 3), (330, [math.nan] * 6), (340, [math.inf] * 6)]
    vectors += [(None, [1.0] * 6), (350, [1.0] * 5), (360, [0.0] * 6)]
    df = table(spark, vectors, "vec_id long, embedding array<float>")
    exact = [(i, [None if x is None else float(np.float32(x)) for x in v] if v else v) for i, v in vectors]
    got = top_k.top_k(df, F.col("vec_id") % 10 == 0, k=4).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == _expected(exact, 4)


def test_top_k_of_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    got = top_k.top_k(table(spark, [(0, [1.0]), (1, [2.0])], schema), F.col("vec_id") % 10 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert top_k.top_k(table(spark, [(1, [2.0])], schema), F.col("vec_id") % 10 == 0).collect() == []
    assert top_k.top_k(table(spark, [], schema), F.col("vec_id") % 10 == 0).collect() == []


def test_a_block_skips_what_cannot_reach():
    rng = np.random.default_rng(6)
    x = rng.integers(-500, 500, (300, 8))
    items = pd.DataFrame({"vec_id": range(300), "v": list(x), "norm": np.sqrt((x**2).sum(axis=1))})
    queries = pd.DataFrame({"id": [1000], "q": [x[0]], "to_reach": [float((x[0] @ x.T).max())]})
    got = top_k.best_in_block(items, queries, np.linalg.svd(x.astype(float))[2].T, 5)
    assert got["vec_id"].tolist() == [int((x @ x[0]).argmax())]


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
    "<nav><ul><li><a href=/>{menu}</a></ul></nav><div class=\"ad\">{ad}</div>{open}<h1>{title}</h1>"
    "<p><b>First {n}.<br><p>Second &amp; {n}&nbsp;&lt;b&gt;.\n  more</p><div class='comments'><p>Nice!</p></div>{shut}"
    "<form><p>Send</p></form><footer>&copy; foot {n}</footer></body></html>"
)


def _page(n, host="h.example.com", article=True, **more):
    tags = {"open": "<article>", "shut": "</article>"} if article else {"open": "<div class=text>", "shut": "</div>"}
    values = {"menu": "Home", "ad": f"Buy {n % 3}", "title": f"Title {n}", "n": n, **tags, **more}
    return n, f"https://{host}/{n}", PAGE.format(**values)


def _text(n):
    return f"Title {n}\nFirst {n}.\nSecond & {n} <b>. more"


def test_pages_are_read_by_their_hosts_wrapper(spark):
    rows = [_page(n) for n in range(12)] + [_page(n, "other.example.org", article=False) for n in range(100, 112)]
    rows += [_page(200, "single.example.net")]
    rows += [(300, None, _page(300)[2]), (301, "no url", _page(301)[2]), (302, "https://h.example.com/x", None)]
    rows += [(303, "https://h.example.com/y", ""), (5, *_page(5)[1:])]
    rows += [(304, "https://h.example.com/z", "<p>only <b>this"), (305, "https://h.example.com/long", "<p>w w</p>" * 30_000)]
    got = wrappers.extracted(table(spark, rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for n in [*range(12), *range(100, 112), 200, 300, 301]:
        assert text[n] == _text(n), n
    assert (text[302], text[303], text[304]) == ("", "", "only this")
    assert text[305].count("\n") == 29_999
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrappers.extracted(table(spark, [], "page_id long, url string, html string")).collect() == []


def test_matching_pairs_most_nodes_in_order():
    a = wrappers.parse("<div><p>a</p><ul><li>1<li>2</ul><p>b</p></div>")
    b = wrappers.parse("<div><h2>x</h2><p>a</p><ul><li>1</ul><p>c</p></div>")
    score, pairs = wrappers.match(a, b)
    assert score == len(pairs) == 6
    assert [x.tag for x, _ in pairs if x.own_text() != y_text(x, pairs)] == ["p"]


def y_text(x, pairs):
    return next(y.own_text() for left, y in pairs if left is x)


def test_constant_texts_inside_the_container_are_template():
    page = "<div class=c><p class=note>Subscribers read more</p><p>alpha {0}</p><p>beta {1}</p></div>"
    root, constants = wrappers.induce([page.format(n, 7 * n) for n in range(6)])
    assert wrappers.main_text(page.format(3, 4), root, set(constants)) == "alpha 3\nbeta 4"
    assert wrappers.induce([page.format(1, 1)] * 9) == ("", [])


def test_odd_markup_is_read():
    deep = wrappers.main_text("<b>" * 3000 + "x" + "<p>y")
    assert deep == "x\ny"
    assert wrappers.main_text("a < b <p>c<td>d</p") == "a < b\nc\nd"
    assert wrappers.main_text("<!-- <p>no --><p>yes<script>no") == "yes"


def test_articles_keep_what_only_sounds_like_boilerplate():
    article = (
        "<article><section id='related-work'><h2>Related work</h2><p>Text</section><p class=search>find</p><p class=menu>Lunch: soup"
        "<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be.</p><p hidden>kept</p>{}</article>"
    )
    dropped = "<div class='related-posts'>more</div><div id=comments><p>Nice</div><div class=ad>Buy</div><aside>side</aside>"
    kept = "Related work\nText\nfind\nLunch: soup\nLet x=1 be.\nkept"
    assert wrappers.main_text(article.format("")) == wrappers.main_text(article.format(dropped)) == kept


def test_long_values_stray_quotes_and_deep_parts():
    long = "a > b " * 2000
    assert wrappers.main_text(f'<p>A<img alt="{long}> tail"><p>B') == "A\nB"
    assert wrappers.main_text("<p title=it's>A<p>don't<p>B") == "A\ndon't\nB"
    assert wrappers.main_text('<p>A<p title="never closed>B<p>C') == "A\nB\nC"
    assert wrappers.main_text('<p>A<a x=">" <p>B') == "AB"  # one tag
    assert wrappers.main_text("<p>x" + '<a x=">" ' * 20_000).startswith("x")
    deep = "<div>" * 250 + "<nav><div>menu</div></nav><p>text</p>" + "</div>" * 250
    assert wrappers.main_text(f"<article>{deep}<p>end</article><div class=c>after") == "text\nend"


def test_classes_with_the_pages_number_align():
    page = (
        "<body><div class=top>Top {0}</div><div class='post post-{0}'><p class=note>Subscribers read more</p>"
        "<p>alpha {0} " + "x" * 100 + "</p></div></body>"
    )
    root, constants = wrappers.induce([page.format(n) for n in range(20)])
    assert wrappers.main_text(page.format(7), root, set(constants)) == "alpha 7 " + "x" * 100


def test_matching_is_the_best_of_all():
    tag = random.Random(5)

    def tree(depth):
        node = wrappers.Node(tag.choice("ab"), {})
        node.parts += [tree(depth - 1) for _ in range(tag.randint(0, 3) if depth else 0)]
        return node

    def best(a, b):
        if a.label != b.label:
            return 0

        def forest(left, right):
            if not left or not right:
                return 0
            both = best(left[0], right[0]) + forest(left[1:], right[1:])
            return max(both, forest(left[1:], right), forest(left, right[1:]))

        return 1 + forest(a.children(), b.children())

    for _ in range(300):
        a, b = tree(3), tree(3)
        b.label = a.label
        score, pairs = wrappers.match(a, b)
        assert score == len(pairs) == best(a, b)


def test_a_text_is_constant_by_pages_and_at_its_path_only():
    page = "<div class=c><p class=note>Subscribe</p><ul>{1}</ul><p>body {0}</p></div>"
    same = "<li>again</li>" * 10
    pages = [page.format(n, same if n < 2 else f"<li>item {n}</li><li>Subscribe</li>") for n in range(5)]
    root, constants = wrappers.induce(pages)
    assert wrappers.main_text(pages[0], root, set(constants)) == "again\n" * 10 + "body 0"
    assert wrappers.main_text(pages[3], root, set(constants)) == "item 3\nSubscribe\nbody 3"


def test_wrappers_come_from_all_pages_and_every_layout(spark):
    page = "<body><div class=top>Top {0}</div><div class={1}><p>Subscribers read more</p><p>alpha {0} {2}</p></div></body>"
    long = " word" * 12_000
    rows = [(n, "https://copies.example.com/a", page.format(0, "one", "x" * 200)) for n in range(40)]
    rows += [(n, f"https://copies.example.com/{n}", page.format(n, "one", "x" * 200)) for n in range(100, 106)]
    rows += [(n, f"https://long.example.com/{n}", page.format(n, "one", long)) for n in range(200, 206)]
    rows += [(n, f"https://two.example.com/{n}", page.format(n, "one", "y" * 200)) for n in range(300, 380)]
    rows += [(n, f"https://two.example.com/{n}", page.format(n, "other", "z" * 200)) for n in range(400, 406)]
    got = wrappers.extracted(table(spark, rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    for n in range(40):
        assert text[n] == "alpha 0 " + "x" * 200
    assert all(text[n] == f"alpha {n} " + "x" * 200 for n in range(100, 106))
    assert all(text[n] == f"alpha {n} " + long.strip() for n in range(200, 206))
    assert all(text[n] == f"alpha {n} " + ("y" if n < 400 else "z") * 200 for n in [*range(300, 380), *range(400, 406)])


def test_large_trees_are_matched_by_the_same_rule_as_small_ones():
    tag = random.Random(6)

    def tree():
        node = wrappers.Node("div", {})
        node.parts += [wrappers.Node(tag.choice("abc"), {}) for _ in range(600)]
        for child in node.children()[::7]:
            child.parts.append(wrappers.Node("i", {}))
        return node

    a, b = tree(), tree()
    row = [0] * 601
    for x in a.children():
        above, row = row, [0]
        for j, y in enumerate(b.children()):
            met = (x.label == y.label) * (1 + min(len(x.children()), len(y.children())))
            row.append(max(row[-1], above[j + 1], above[j] + met))
    score, pairs = wrappers.match(a, b)
    assert score == len(pairs) == 1 + row[-1]
    place = {id(n): i for top in (a, b) for i, n in enumerate(top.children())}
    met = sorted((place[id(x)], place[id(y)]) for x, y in pairs if id(x) in place)
    assert all(p[1] < q[1] for p, q in zip(met, met[1:]))


def test_large_trees_are_matched_in_linear_time():
    pages = ["<div class=c>" + "".join(f"<p>{n} {i}</p>" for i in range(9000)) + "<h2>same</h2></div>" for n in (1, 2)]
    score, pairs = wrappers.match(*map(wrappers.parse, pages))
    assert score == len(pairs) == 9003


def test_site_headers_stay_out_of_pages_read_from_the_whole_body():
    page = "<body><header><p>Site {0}</p></header><div class=c><header><h1>Title</h1></header><p>alpha</p></div></body>"
    assert wrappers.main_text(page, "/html/body/div.c") == "Title\nalpha"
    assert wrappers.main_text(page, "/html/body/div.other") == "alpha"
    assert wrappers.main_text(page, "/html/body") == "alpha"
