import random

import numpy as np
import pytest

pytest.importorskip("skein.llm.topk_search")

from skein.llm.html_text import main_text, style_tree  # noqa: E402
from skein.llm.topk_search import search_block, top_k  # noqa: E402


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    data = [(i, (rng.normal(size=8) * (1 + i % 3)).tolist(), "x") for i in range(400)]
    data[20:40] = [(i, data[3][1], "x") for i in range(20, 40)]
    data += [(500, None, "x"), (501, [1.0] * 7 + [None], "x"), (502, [float("nan")] * 8, "x"), (503, [float("inf")] * 8, "x"), (504, [], "x"), (550, [0.0] * 8, "x"), (None, [9.0] * 8, "x"), (600, [1.0, 2.0], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, 5, 50, block=64).collect())
    good = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v, _ in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and len(v) == 8}
    want = []
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert top_k(df.where("false")).count() == 0


def test_block_with_huge_values_and_few_candidates():
    v = np.array([[2**30, 1], [2**30, 2], [-(2**30), 3]], np.int64)
    assert search_block(v[:1], np.array([7]), v, np.array([7, 8, 9]), 5)[0] == [[(2**60 + 2, 8), (3 - 2**60, 9)]]
    assert search_block(np.array([[1, 1]]), np.array([1]), np.array([[1, 1]]), np.array([1]), 5)[0] == [[]]


def test_reading_stops_when_outsiders_cannot_qualify():
    rng = np.random.default_rng(3)
    v = rng.integers(-20, 20, (4096, 16))
    v[[5, 900, 4000]] += 400
    v[[17, 3000]] -= 400
    q = np.stack([np.full(16, 3), np.full(16, -3), rng.integers(-9, 9, 16)])
    ids, own = np.arange(4096), np.array([-1, 3000, 1])
    best, read = search_block(q, own, v, ids, 3)
    for i in range(3):
        want = sorted((-int(s), j) for j, s in zip(ids.tolist(), v @ q[i], strict=True) if j != own[i])[:3]
        assert best[i] == [(-s, j) for s, j in want]
    assert read[0] <= 512 and read[2] == 4096  # with dense random values all is read
    again, less = search_block(q, own, v, ids, 3, np.array([10**6, 10**6, 10**6]))
    assert again == [[], [], []] and less.max() <= 256


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<div class="ad">buy</div><header><h1>Site</h1></header>{0}<div id="comments"><p>nice</p></div><aside>more</aside><form><p>mail</p></form><footer>&copy; foot</footer></body></html>"""


def test_article_and_markup(spark):
    article = "<article><header><h1>A &amp; B</h1></header><p><b>one <i>t</i>wo.<br>\n three&nbsp;x<p>four <span class='share'>tell</span><ul><li>a<li>b</ul><div class='comment-list'><p>no</p></div></article>"
    data = [(1, "http://h.example/x", PAGE.format(article)), (2, None, None), (3, "", "plain < text"), (4, "u", "<p>unclosed <b>bold"), (5, "u", "<article>" + "<p>long text " * 30_000), (1, "http://h.example/x", PAGE.format(article))]
    got = main_text(spark.createDataFrame([(*d, "x") for d in data], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(data) and all(r.n_chars == len(r.text) for r in got)
    assert by[1] == "A & B\none two. three x\nfour\na\nb"
    assert by[2] == "" and by[3] == "plain < text" and by[4] == "unclosed bold"
    assert by[5].count("\n") == 29_999
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_style_tree_cuts_what_a_host_repeats(spark):
    rng = random.Random(1)
    words = lambda: " ".join(rng.choice(["red", "blue", "fish", "tree", "sun"]) + str(rng.randrange(99)) for _ in range(12))
    body = "<body><div class='t1'>Welcome to us</div><div class='c'><p>{0}</p><p>{1}</p></div><div class='t2'>All rights</div></body>"
    texts = [(words(), words()) for _ in range(12)]
    pages = [(i, f"https://same.example/{i}", body.format(*t)) for i, t in enumerate(texts)] + [(99, "https://other.example/", body.format("x", "y"))]
    pages += [(100 + i, "https://copies.example/", body.format("same", "page")) for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    for i, (a, b) in enumerate(texts):
        assert got[i] == f"{a}\n{b}"
    assert got[99] == "Welcome to us\nx\ny\nAll rights"
    assert got[100] == "Welcome to us\nsame\npage\nAll rights"
    assert style_tree(df).where("importance < 0 or importance > 1.000001").count() == 0


def test_style_tree_decides_on_pages_with_an_article(spark):
    body = "<body><nav>menu {0}</nav><div class='c'><p>body {0}</p></div><article><div class='x'>Follow us</div><p>more {0}</p></article></body>"
    pages = [(i, f"https://same.example/{i}", body.format(i)) for i in range(12)] + [(99, "https://other.example/", body.format(99))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"body {i}\nmore {i}" for i in range(12))
    assert got[99] == "Follow us\nmore 99"


def test_importance_is_the_larger_entropy(spark):
    """Against a plain version over the nodes of a page."""
    import math
    from collections import Counter, defaultdict

    from skein.llm.html_text import _key, blocks

    rng = random.Random(4)
    part = lambda: rng.choice(["<p>same</p>", f"<p>{rng.randrange(5)}</p>", "<div><b>x</b><p>y</p></div>", "<ul><li>1<li>2</ul>"])
    pages = [(i, f"https://h{i % 3}.example/{i}", f"<body><nav>menu</nav><div class='a'>{''.join(part() for _ in range(3))}</div><p>{i % 4}</p></body>") for i in range(40)]
    seen = defaultdict(set)
    for _, url, html in pages:
        found = defaultdict(list)
        for x in blocks(html):
            steps = x.path.split("/")
            for i in range(2, len(steps) + 1):
                found["/".join(steps[:i])].append((x.text, tuple(steps[i : i + 1])))
        for path, below in found.items():
            seen[url.split("/")[2], path].add((html, tuple(t for t, _ in below), tuple(n for _, n in below)))
    want = {}
    for (site, path), own in seen.items():
        n = len(own)
        share = lambda values: -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n) if n > 1 else 1.0  # noqa: E731, B023
        want[_key(site), _key(path)] = (n, round(max(share([t for _, t, _ in own]), share([s for *_, s in own])), 9))
    got = {(r.site, r.path): (r.pages, round(r.importance, 9)) for r in style_tree(spark.createDataFrame(pages, "page_id long, url string, html string").select("url", "html")).collect()}
    assert got == {k: (n, abs(x)) for k, (n, x) in want.items()}
