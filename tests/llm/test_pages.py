import math
from collections import Counter

import pytest

from mailspark.llm import html_text, url_filter
from mailspark.llm.common import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head>
<body class="home"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li>News</ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>comment</p> -->
<div class="w-1/2"><article><h1>Head {n}</h1><p>First   &amp; best\n of {n}<p>Second <b>bold<br>line</b> {n}
<form><label>Mail</label><input value="x>y"></form><ul><li>one {n}<li>two</ul>
<table><tr><td>cell {n}<td>next</table><aside>Aside</aside>&lt;tag&gt; {n}&nbsp;end</article></div>
<div class="box">Try our new thing today</div>
<section id="comments"><p>Reader says {n}</p></section>
<div class="sidebar">links</div><footer>&copy; Site</footer></body></html>"""

WANT = ["Head {n}", "First & best of {n}", "Second bold", "line {n}", "one {n}", "two", "cell {n}", "next",
        "<tag> {n} end"]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows],
                                 "page_id long, url string, html string, host string")


def test_noise_goes_and_article_stays(spark):
    rows = [(n, f"http://a.example.com/{n}", PAGE.format(n=n)) for n in range(12)]
    for r in html_text.main_text(pages(spark, rows)).collect():
        assert r.text.split("\n") == [w.format(n=r.page_id) for w in WANT]


def test_inline_noise_and_comments():
    page = ("<p>Text <b>and</b> <span>more</span> <span class=ad>buy <span>now</span> cheap</span> end</p>"
            "<!--><p>one</p><!---><p>two</p><!-- <p>no</p> --!><p>three <!-- x -->3</p>")
    found, _ = html_text.blocks(page)
    assert [t for _, t, noise, _ in found if not noise] == ["Text and more", "end", "one", "two", "three 3"]
    assert " ".join(t for _, t, noise, _ in found if noise) == "buy now cheap"


def test_template_is_learned_from_the_host(spark):
    """Without names that say so, what repeats on a host goes."""
    body = "<html><body><div class=x1>{}</div><div class=x2><p>Text {n} of this page<p>More {n}</div></body></html>"
    rows = [(n, f"http://b.example.com/{n}", body.format("Always the same", n=n)) for n in range(9)]
    rows += [(100, "http://once.example.com/", body.format("Always the same", n=100))]
    got = {r.page_id: r.text for r in html_text.main_text(pages(spark, rows)).collect()}
    assert all(got[n] == f"Text {n} of this page\nMore {n}" for n in range(9))
    assert got[100].startswith("Always the same")


def test_names_of_wrappers_lose_no_article(spark):
    """Names that say noise don't take what the page is about."""
    long = "A sentence of the article number {n} that is long enough to be one. " * 4
    wrappers = ["div class='post no-sidebar'", "div id='content' class='has-sidebar'",
                "div class='layout with-header'", "section class='legal'", "div class='page sidebar-left'"]
    rows = []
    for h, w in enumerate(wrappers):
        page = (f"<body><div class=x1>Always the same</div><{w}><h1>Head {{n}}</h1><p>{long}</p>"
                f"<div class=sidebar>Links</div></{w.split()[0]}><div class=comments>Reader {{n}}</div></body>")
        rows += [(h * 100 + n, f"http://h{h}.example.com/{n}", page.format(n=n)) for n in range(8)]
        rows += [(h * 100 + 50, f"http://once{h}.example.com/", page.replace("Always the same", "").format(n=50))]
    got = {r.page_id: r.text for r in html_text.main_text(pages(spark, rows)).collect()}
    for i, text in got.items():
        assert text == f"Head {i % 100}\n" + long.format(n=i % 100).strip(), i


def test_template_inside_content_goes(spark):
    page = ("<body><div id=content><div class=box>Try our new thing</div><p>Text {n} of page {n}</p>"
            "<div class=hint>Written by us</div></div></body>")
    rows = [(n, f"http://t.example.com/{n}", page.format(n=n)) for n in range(9)]
    got = html_text.main_text(pages(spark, rows)).collect()
    assert all(r.text == f"Text {r.page_id} of page {r.page_id}" for r in got)


def test_articles_in_nodes_of_one_page(spark):
    """Ids of their own on each page, under much that is the same."""
    same = "".join(f"<div class=b{i}>Same text {i}</div>" for i in range(30))
    page = "<body>" + same + "<div id=p{n}><p>Text {n} of page {n}</p></div></body>"
    rows = [(n, f"http://p.example.com/{n}", page.format(n=n)) for n in range(6)]
    got = html_text.main_text(pages(spark, rows)).collect()
    assert all(r.text == f"Text {r.page_id} of page {r.page_id}" for r in got)


def test_page_without_article_is_empty(spark):
    """On a host of many pages; a host of nearly the same pages isn't judged."""
    body = "<body><div class=x1>Home News About</div>{}<div class=x3>All our pages are made by hand</div></body>"
    rows = [(n, f"http://e.example.com/{n}", body.format(f"<div class=x2><p>Text {n} of this page</div>"))
            for n in range(9)]
    rows += [(100, "http://e.example.com/none", body.format("")), (101, "http://e.example.com/not", body.format(""))]
    one = "<body><div class=x><p>" + "A text that comes many times. " * 40 + "</div><div class=n>{}</div></body>"
    rows += [(200 + n, f"http://f.example.com/{n}", one.format(n)) for n in range(20)]
    got = {r.page_id: r.text for r in html_text.main_text(pages(spark, rows)).collect()}
    assert got[100] == got[101] == ""
    assert all(got[n] == f"Text {n} of this page" for n in range(9))
    assert all(got[200 + n].startswith("A text that comes many times.") for n in range(20))


def test_copies_are_no_template(spark):
    """Copies of a page, and hosts of copies only, keep their article."""
    one = "<body><div class=x><p>A text that comes many times</div></body>"
    rows = [(n, "http://c.example.com/x", one) for n in range(40)]
    assert {r.text for r in html_text.main_text(pages(spark, rows)).collect()} == {"A text that comes many times"}


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "", ""), (None, "http://x/", "<p>a"), (None, "http://x/", "<p>a"),
            (3, "x", "no tags &eacute; &#8364; <"), (4, "http://x/", "<script>only"), (5, "http://d/", deep),
            (6, "http://x/", "<article>" + "<p>word</p>" * 20000 + "</article>"), (7, "u", "<p>a</b></i></p></div>b")]
    docs = pages(spark, rows)
    got = html_text.main_text(docs).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows) and sum(r.page_id is None for r in got) == 2
    assert by_id[None].text == "a" and by_id[1].text == by_id[2].text == by_id[4].text == ""
    assert by_id[1].url is None and by_id[3].text == "no tags é € <" and by_id[5].text == "deep"
    assert by_id[6].text.count("word") == 20000 and by_id[7].text == "a\nb"
    assert html_text.main_text(docs.limit(0)).count() == 0


def test_given_pages(spark, sf_dir):
    """The given pages: what stands in their article, by a plain search."""
    import html
    import re

    docs = table(spark, sf_dir, "pages")
    got = {r.page_id: r.text for r in html_text.main_text(docs).collect()}
    for r in docs.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", article))
        want = [" ".join(html.unescape(p).split()) for p in parts]
        assert got[r.page_id] == "\n".join(w for w in want if w)


# -------------------------------------------------------------------------- urls


def brute_url(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[:min((path.index(c) for c in "?#" if c in path), default=len(path))]


def brute_rule(host, path):
    fits = [(h + p, v) for v, h, p in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


URLS = ["http://Example.COM/en/1?x=/en/#f", "https://www.example.com/en/", "http://example.com/en", "http://x.com",
        "http://notexample.com/en/", "ftp://a.b.net/es/x", "http://b.net/fr/?q", "http://net/es/", "no scheme/com/",
        "http://h?x=://y/z", "http://a.org/en/1", "http://b.org/fr/2", "://", "http://ÄÖ.com/", "http://a\nb.com/x", "",
        None, None]


def test_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, "http://a.com/", "x")]
    docs = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judged(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            continue
        host, path = brute_url(URLS[r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert url_filter.judged(docs.limit(0)).count() == 0


def test_language_models_by_hand(spark):
    urls = [("http://a.com/x", 3, "allow"), ("http://b.net/es/x", 2, "block"), ("http://c.org/", 1, None)]
    df = spark.createDataFrame([(u, n, d, False) for u, n, d in urls], "url string, n long, decided string, held boolean")
    got = {r.gram: r.full for r in url_filter.gram_ratios(df).collect()}
    k = url_filter.ORDER
    counts = {kind: Counter() for kind in ("allow", "block")}
    for u, n, d in urls:
        padded = url_filter.PAD * k + u + url_filter.END
        for i in range(len(u) + 1):
            for j in range(k + 1):
                if d:
                    counts[d][padded[i + j:i + k + 1]] += n

    def probability(c, gram):
        p = url_filter.EVEN
        for length in range(1, len(gram) + 1):
            g = gram[-length:]
            total = sum(v for x, v in c.items() if len(x) == length and x[:-1] == g[:-1])
            p = (c[g] + url_filter.SMOOTHING * p) / (total + url_filter.SMOOTHING)
        return p

    assert len(got) > 20
    for gram, ratio in got.items():
        want = math.log(probability(counts["block"], gram) / probability(counts["allow"], gram))
        assert ratio == pytest.approx(want, abs=1e-9)


def test_models_tell_kinds_apart(spark):
    """URLs that no rule decides are judged by what they look like."""
    rows = [(f"http://s{i}.com/news/article-{i}", ) for i in range(150)]
    rows += [(f"http://s{i}.net/es/casino-win-bonus-{i}", ) for i in range(150)]
    rows += [(f"http://t{i}.org/news/article-{i}", ) for i in range(20)]
    rows += [(f"http://t{i}.org/es/casino-win-bonus-{i}", ) for i in range(20)]
    docs = spark.createDataFrame([(i, u) for i, (u,) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judged(docs).collect()}
    assert all(got[i] == "allow" for i in range(300, 320)) and all(got[i] == "block" for i in range(320, 340))


@pytest.mark.parametrize("often", [1, 20, 10**9])
def test_scores_of_urls(spark, monkeypatch, often):
    """Means over all grams, however many of them are broadcast; long URLs have
    rows of a number and a gram."""
    monkeypatch.setattr(url_filter, "OFTEN", often)
    made = [("http://a.com/" + "xy\u00e9\U0001f600" * 20_000, "allow"), ("http://b.net/es/x", "block"), ("", None),
            ("http://a.com/\n", None), ("x" * 3, "block")]
    urls = spark.createDataFrame([(i, u, 1, d, False) for i, (u, d) in enumerate(made)],
                                 "number long, url string, n long, decided string, held boolean")
    assert url_filter._grams(urls, "number").columns == ["number", "gram"]
    ratios = url_filter.gram_ratios(urls).cache()
    by_gram = {r.gram: r.full for r in ratios.collect()}
    got = {r.number: r.full for r in url_filter.url_scores(urls, ratios).collect()}
    assert len(got) == len(made)
    k = url_filter.ORDER
    for i, (u, _) in enumerate(made):
        padded = url_filter.PAD * k + u + url_filter.END
        want = [by_gram[padded[j:j + k + 1]] for j in range(len(u) + 1)]
        assert got[i] == pytest.approx(sum(want) / len(want), abs=1e-9)


def test_calibration():
    a, b = url_filter.calibrated([(-1.0, False, 50), (1.0, True, 5), (0.5, False, 5), (-0.5, True, 1)])
    assert a > 0 and a * 1.0 + b > 0 > a * -1.0 + b
    assert url_filter.calibrated([]) == (0.0, -1.0)
    assert url_filter.calibrated([(1.0, True, 3)]) == (0.0, 1.0)
