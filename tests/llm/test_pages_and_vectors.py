"""Pages, urls and embeddings: brute-force checks and awkward tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import sitetree, topk, urls

PAGES = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    return lambda rows: spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash")).withColumn("noise", F.lit("clash"))


# --- main text -----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy {0}</div>
<article><h1>Head &amp; tail</h1><p><b>One  two&nbsp;three.<br><p>A&lt;b {0} <em>in</em>line</p><aside>side</aside><form>f<input></form>
<ul><li>first<li>second</ul><div class="comments">me too {0}</div></article><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page():
    want = "Head & tail\nOne two three.\nA<b 7 inline\nfirst\nsecond"
    assert sitetree.main_text(PAGE.format(7)) == want
    assert sitetree.main_text(PAGE.format(7).replace("</body></html>", "").replace("</footer>", "")) == want


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p></p>", "<p>a<script>", "<!-- open", "<a href='<p>'>x</a>", "&amp", "<p>" * 5000 + "deep", "<div>" * 3000 + "x", "x" * 300_000])
def test_broken_pages_have_a_text(page):
    text = sitetree.main_text(page)
    assert isinstance(text, str) and (page is None or len(text) <= len(page))


def test_style_tree_removes_what_repeats_on_a_site(spark, pages):
    body = "<html><body><div class=x>Same teaser on every page</div><div class=y>Own words {0} of page {0}</div></body></html>"
    rows = [(i, f"http://a.com/{i}", body.format(i)) for i in range(60)] + [(100, "http://b.org/", body.format("b")), (101, None, None), (102, "nohost", "")]
    rows += [(200 + i, "http://copies.com/", body.format("c")) for i in range(30)]  # copies say nothing about importance
    got = {r.page_id: r for r in sitetree.extract(pages(rows)).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert all(got[i].text == f"Own words {i} of page {i}" for i in range(60))
    assert "Own words c of page c" in got[200].text and got[101].text == got[102].text == ""
    tree = {(r.host, r.path): r for r in sitetree.style_tree(pages(rows)).collect()}
    assert tree["a.com", "/html/body/div.x"].texts == 0 and tree["a.com", "/html/body/div.y"].texts == pytest.approx(1)
    assert sitetree.extract(pages(rows).where("false")).count() == 0


def test_one_rule_for_hosts_of_any_size_and_pages_without_body(pages):
    site = "<html><body><div class=only{0}>Join our club</div><div class=y>Own words {1} of page {1}</div></body></html>"
    rows = [(100 * n + i, f"http://h{n}.com/{i}", site.format(n, f"{n}-{i}")) for n in (2, 5, 19, 20, 60) for i in range(n)]
    bare = "<title>T</title><div class=z>Join our club</div><div class=y>Own words {0} of page {0}</div>"
    rows += [(9000 + i, f"http://bare.com/{i}", bare.format(i)) for i in range(30)] + [(9999, "http://one.com/", site.format("one", "x"))]
    got = {r.page_id: r.text for r in sitetree.extract(pages(rows)).collect()}
    assert got.pop(9999) == "Join our club\nOwn words x of page x"  # a single page says nothing
    assert len(got) == len(rows) - 1 and all(t.startswith("Own words ") and "club" not in t for t in got.values())


ARTICLE = "<article><h1>Title</h1><p>First words {0}.</p><p>Second words {0}.</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        '<body><div class="layout with-sidebar">' + ARTICLE + '<div class="sidebar">side</div></div></body>',
        '<body id="page" class="single"><div id="page" class="single no-comments">' + ARTICLE + "</div></body>",
        '<body><div class="main-content share-enabled">' + ARTICLE + '<div class="share">post it</div></div></body>',
        '<body><div class="widget"><div class="menu">a b c</div>' + ARTICLE + "</div></body>",
        "<body>" + ARTICLE + "<section><h2>Comments</h2><article><p>I agree with all of this, and more so.</p></article></section></body>",
        "<body>" + ARTICLE + "<section><article><p>A remark of a reader</p></article><article><p>Another one</p></article></section></body>",
        "<body><main>" + ARTICLE + "</main><section><article><h1>Aside</h1>elsewhere</article></section></body>",
        '<body><div class="comments"><article><p>Long ' + "remark " * 50 + "</p></article></div>" + ARTICLE + "</body>",
        "<body>" + ARTICLE.replace("</article>", "<article><p>Comment inside</p></article><h3>3 Comments</h3><p>me too</p></article>") + "</body>",
        '<body><div class="header"><h1>Title</h1><p>First words {0}.</p><p>Second words {0}.</p></div><div class="ad">buy</div></body>',
        '<body><div class="nav-wrap widget"><h1>Title</h1><div><p>First words {0}.</p><p>Second words {0}.</p></div></div><div class="comments"><p>x</p></div></body>',
    ],
)
def test_names_never_drop_the_article(page):
    assert sitetree.main_text(page.format(7)) == "Title\nFirst words 7.\nSecond words 7."


def test_pages_without_an_article_keep_suspects_only_if_nothing_else_is_left():
    assert sitetree.main_text('<body><div class="promo"><p>Only words.</p></div><nav>menu</nav></body>') == "Only words."
    assert sitetree.main_text('<body><div class="promo"><p>Words.</p></div><p>Text.</p></body>') == "Text."
    assert sitetree.main_text('<body><div class="ad">buy</div><nav>menu</nav></body>') == ""
    assert sitetree.main_text("<body><article></article><nav>menu</nav></body>") == ""


def test_lists_of_articles_stay_whole():
    page = "<body><div>" + "".join(f"<article><h2>Part {i}</h2><p>Words {i}</p></article>" for i in range(3)) + "</div></body>"
    assert sitetree.main_text(page) == "\n".join(f"Part {i}\nWords {i}" for i in range(3))


def test_the_tree_decides_inside_an_article_unless_nothing_is_left(pages):
    site = "<body><article><h1>On {0}</h1><p class=legal>All rights are reserved.</p><p>Own words {0}</p></article></body>"
    same = "<body><nav>{0}</nav><article><p>Just one text.</p></article></body>"
    rows = [(i, f"http://a.com/{i}", site.format(i)) for i in range(40)] + [(100 + i, f"http://b.com/{i}", same.format(i)) for i in range(40)]
    got = {r.page_id: r.text for r in sitetree.extract(pages(rows)).collect()}
    assert all(got[i] == f"On {i}\nOwn words {i}" and got[100 + i] == "Just one text." for i in range(40))


@pytest.mark.parametrize("limit", [1, 100_000])
def test_style_tree_and_noise_by_brute_force(pages, monkeypatch, limit):
    monkeypatch.setattr(urls, "LIMIT", limit)
    rng = np.random.default_rng(5)
    kinds = ["<div class=teaser>{2}</div>", "<div class=box><section class=own>{0} {1}</section><section class=tag>{2}</section></div>", "<ul><li>{2}<li>{0}</ul>"]
    rows = []
    for i in range(160):
        parts = [kinds[k].format(rng.integers(99), i, rng.integers(3)) for k in rng.permutation(3)[: rng.integers(1, 4)]]
        rows.append((i, f"http://h{rng.integers(6) ** 2}.com/", "<html><body>" + "".join(parts) + "</body></html>"))
    rows += rows[:20]
    values: dict = {}
    for host, page in {(u.split("/")[2], p) for _, u, p in rows}:
        for path, (styles, texts) in sitetree.elements(sitetree.parse(page)).items():
            for h in (host, None):
                values.setdefault((h, path), []).append(("|".join(styles), "|".join(texts)))

    def entropy(xs):
        return 1.0 if len(xs) == 1 else -sum(xs.count(x) / len(xs) * math.log(xs.count(x) / len(xs)) for x in set(xs)) / math.log(len(xs))

    tree = {k: (len(v), entropy([c for _, c in v]), (entropy([s for s, _ in v]) + entropy([c for _, c in v])) / 2) for k, v in values.items()}
    got = sitetree.style_tree(pages(rows))
    found = {(r.host, r.path): (r.n_pages, r.texts, r.importance) for r in got.collect()}
    assert found.keys() == tree.keys() and all(found[k] == pytest.approx(tree[k], abs=1e-9) for k in tree)
    low, want = {}, set()
    for (host, path), (n, *own) in tree.items():
        m, *every = min(tree[None, path][0], sitetree.PAGES), *tree[None, path][1:]
        low[host, path] = "/body" in path and max((n * a + m * b) / (n + m) for a, b in zip(own, every)) < sitetree.IMPORTANCE
    for (host, path), gone in low.items():
        if host and gone and all(v for (h, p), v in low.items() if h == host and p.startswith(path + "/")):
            want.add((host, path))
    want = {(h, p) for h, p in want if (h, p.rpartition("/")[0]) not in want}
    assert want and {(r.host, r.path) for r in sitetree.noise_paths(got).collect()} == want
    texts = {r.page_id: r.text for r in sitetree.extract(pages(rows)).collect()}
    assert all(texts[i] == sitetree.main_text(p, frozenset(q for h, q in want if h == u.split("/")[2])) for i, u, p in rows)


# --- urls ----------------------------------------------------------------------------------------


def test_hosts_paths_and_rules(pages):
    rows = [
        (1, "http://WWW.Example.com/en/1?x=/fr/", None), (2, "https://blog.example.com/en/2#t", ""), (3, "http://x.net/es/", None), (4, "http://net/fr/1", None),
        (5, "http://example.com", None), (6, None, None), (7, "no scheme.com/", None), (8, "http://a.b/?q=http://x.com/", None), (9, "http://É.com/é", None),
        (10, "http://notexample.com/en/", None), (11, "", None), (12, "http://://x.com/", None), (None, "http://x.com/", None), (12, "http://x.com/", None),
    ]
    got = {(r.page_id, r.host): r for r in urls.judge(pages(rows)).collect()}
    of = {i: (r.host, r.path, r.rule) for (i, _), r in got.items()}
    assert of[1] == ("www.example.com", "/en/1", "www.example.com/en/") and of[2] == ("blog.example.com", "/en/2", "example.com/en/")
    assert of[3] == ("x.net", "/es/", "net/es/") and of[4] == ("net", "/fr/1", "net/fr/") and of[5] == ("example.com", "", None)
    assert of[6] == of[7] == of[11] == ("", "", None) and of[8] == ("a.b", "/", None) and of[9] == ("É.com", "/é", "com/")
    assert of[10] == ("notexample.com", "/en/", "com/") and got[12, ":"].path == "//x.com/"
    assert {r.verdict for r in got.values()} <= {"allow", "block"} and got[2, "blog.example.com"].verdict == "block"
    assert urls.judge(pages(rows).where("false")).count() == 0


def test_segmentation_is_the_cheapest():
    model = urls.Unigrams({"cheap": 3.0, "pills": 4.0, "chea": 9.0, "p": 6.0, "ills": 9.0}, 1000.0)

    def best(word):
        if not word:
            return 0.0
        return min(model.cost(word[:k]) + best(word[k:]) for k in range(1, len(word) + 1))

    for word in ("cheappills", "pillscheap", "xcheap", "zzz", ""):
        split = model.split(word)
        assert "".join(split) == word and math.isclose(sum(map(model.cost, split)), best(word))
    assert model.split("cheappills") == ["cheap", "pills"]


def test_concatenated_seed_words_block(pages):
    title = "<title>garden news about roses and casino history</title>"
    rows = [(i, f"http://garden{i}.org/news/{i}", title) for i in range(40)] + [(100 + i, f"http://bestcasinopoker{i}.org/win", title) for i in range(5)]
    rows += [(200, "http://winwin.org/win", title), (201, "http://roses.org/news", title)]
    got = {r.page_id: r.verdict for r in urls.judge(pages(rows)).collect()}
    assert all(got[i] == "allow" for i in [*range(40), 201]) and all(got[100 + i] == "block" for i in range(5))


@pytest.mark.parametrize("limit", [2, 100_000])
def test_every_word_and_token_counts_whatever_fits_a_task(pages, monkeypatch, limit):
    monkeypatch.setattr(urls, "LIMIT", limit, raising=False)
    slug = "very" * 20
    rows = [(i, f"http://green{w}.org/a{i % 3}/{slug}{'xy'[i % 2]}", f"<title>green {w} day</title>") for i, w in enumerate(["tea", "ivy", "hat", "sea"] * 3)]
    rows += [(50 + i, f"http://best{w}.net/{slug}x/b", f"<title>best {w}</title>") for i, w in enumerate(["poker", "casino", "poker"])]
    titles = [w for _, _, t in rows for w in t[7:-8].split()]
    costs = {w: -math.log(titles.count(w) / len(titles)) for w in titles}
    model = urls.Unigrams(costs | {w: min(costs.get(w, math.inf), math.log(1000)) for w in urls.SEEDS}, float(len(titles)))
    said = {}
    for i, url, _ in rows:
        host, _, path = url[7:].partition("/")
        said[i] = ["h:" + w for label in host.split(".") for w in model.split(label)]
        for part in path.split("/"):
            said[i] += ["p:" + part.rstrip("012"), "p:#"] if part[-1].isdigit() else ["p:" + part]
    sides = {s: [i for i in said if bool({"h:" + w for w in urls.SEEDS} & set(said[i])) == s] for s in (True, False)}
    every = {s: [t for i in sides[s] for t in said[i]] for s in sides}
    n = len({t for s in every.values() for t in s})
    odds = {t: math.log((every[True].count(t) + 1) / (len(every[True]) + n)) - math.log((every[False].count(t) + 1) / (len(every[False]) + n)) for i in said for t in said[i]}
    want = {i: math.log(len(sides[True]) / len(sides[False])) + sum(odds[t] for t in said[i]) for i in said}
    got = urls.judge(pages(rows), rules=(("block", "nowhere", "/"),)).collect()
    assert len(sides[True]) == 3 and {r.page_id: r.score for r in got} == pytest.approx(want)


# --- top-k ---------------------------------------------------------------------------------------


def brute(rows, every, k):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in ok)
    data = np.array([np.pad(v, (0, width - len(v))) for _, v in ok])
    ids = np.array([i for i, _ in ok])
    out = set()
    for q in np.flatnonzero(ids % every == 0):
        scores = data @ data[q]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[q]][:k]
        out |= {(int(ids[q]), r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("scale", [0.1, 1.0, 300.0, 1e6])
def test_top_k_against_brute_force(spark, scale, monkeypatch):
    rng = np.random.default_rng(int(scale * 10))
    base = rng.normal(size=(30, 12)) * scale
    rows = [(int(i), (base[i % 30] * (1 + (i % 7 == 0)) + rng.normal(size=12) * 0.05 * scale).tolist()) for i in rng.permutation(700)]
    rows += [(5000, [0.5] * 12), (5001, [0.5] * 12), (5002, [0.5] * 12), (5050, [0.25] * 3), (5100, None), (5101, []), (5102, [float("nan")] * 12), (5103, [1.0, None]), (5150, [float("inf")] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash")).repartition(3)
    got = {tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0"), 5, size=64).collect()}
    assert got == brute(rows, 50, 5)


def test_top_k_of_small_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id bigint, embedding array<float>")
    assert {tuple(r) for r in topk.nearest(df).collect()} == {(0, 1, 50, 131072), (50, 1, 0, 131072)}
    assert topk.nearest(df.where("vec_id = 0")).count() == 0 and topk.nearest(df.where("false")).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [200000.0]), (50, [200000.0]), (1, [-3.0e8, 2.0]), (2, [1e18]), (3, [])]
    got = {tuple(r) for r in topk.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    a, b = 51_200_000, 256 * -300_000_000
    most = (1 << 63) - 1  # no 64-bit number
    each = lambda q, o: {(q, 1, 2, min(most, a * 256 << 54)), (q, 2, o, a * a), (q, 3, 3, 0), (q, 4, 1, a * b)}
    assert got == each(0, 50) | each(50, 0) and a * a == 2621440000000000


def test_reading_stops_early():
    rng = np.random.default_rng(2)
    near = rng.normal(size=(1, 16)) * 100
    rows = np.concatenate([np.repeat(near, 20, 0) + rng.normal(size=(20, 16)), rng.normal(size=(2000, 16)) * 20]).astype(np.int64)
    block = topk.Block(np.arange(len(rows)), rows)
    at, scores = block.search(near[0].astype(np.int64), -1, 5, topk._LEAST)
    want = rows @ near[0].astype(np.int64)
    assert scores.tolist() == sorted(want.tolist(), reverse=True)[:5]
