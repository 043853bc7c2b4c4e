"""Main text and host reputation."""

import math
import time
from collections import defaultdict

import pytest

from quotelens.llm import host_reputation, main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site"><a href="/">Brand name</a></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies, please agree.</div><div id="ad-top">Buy now, it is cheap, very cheap indeed.</div>
{body}
<aside>Side note, with text. And more of it.</aside><div class="comments"><p>Reader says: nice article, really, I liked it.</p></div>
<form action="/s"><label>Search</label><input name="q"><button>Go</button></form><footer>&copy; Host. All rights reserved.</footer></body></html>"""
TEXTS = ["First paragraph, of some length, with commas and a stop.", "Second one &amp; more of the same; it has <b>bold</b>text, too.", "Short.", "The last paragraph of the article, which ends here."]
WANT = "First paragraph, of some length, with commas and a stop. Second one & more of the same; it has boldtext, too. Short. The last paragraph of the article, which ends here."


@pytest.mark.parametrize(
    "body",
    [
        "<article><h1>A  title\n here</h1>" + "".join(f"<p>{t}</p>" for t in TEXTS) + "</article>",
        "<main><h1>A title here</h1><section>" + "".join(f"<p>{t}" for t in TEXTS) + "</section></main>",
        "<div class='post-content'><h1>A title here</h1>" + "".join(f"<p>{t}</p>" for t in TEXTS) + "</div>",
        "<div><div><h1>A title here</h1>" + "".join(f"<p>{t}</p>" for t in TEXTS) + "</div></div>",
        "<article><h1>A title here</h1>" + "<br>".join(TEXTS) + "<!-- <p>hidden</p> --><div class='ad'>Buy, buy.</div><script>x</script></article>",
    ],
)
def test_main_text_leaves_boilerplate_out(body):
    assert main_text.main_text(PAGE.format(body=body)) == "A title here " + WANT


LINE = "A long paragraph of the text, with several commas, some words, and a stop at the end."
MANY = "".join(f"<p>{LINE}</p>" for _ in range(40))
ALL = " ".join([LINE] * 40)


@pytest.mark.parametrize(
    ("body", "rest"),
    [
        (f"<div>{MANY}</div><div><p>{LINE}</p></div>", LINE),
        (f"<article>{MANY}</article><article><p>{LINE}</p></article>", LINE),
        (f"<div>{MANY}<ul><li>One.</li><li>Two</li></ul><blockquote>So it is</blockquote><table><tr><td>7</td></tr></table><pre>x = 1</pre><div>End</div></div>", "One. Two So it is 7 x = 1 End"),
    ],
)
def test_split_articles_and_weak_blocks_stay_whole(body, rest):
    assert main_text.main_text(PAGE.format(body=body)) == f"{ALL} {rest}"


def test_main_text_of_odd_pages():
    assert [main_text.main_text(x) for x in (None, "", "   ", "<", "<p", "<!-- x", "<script>a", "<nav>only a menu</nav>")] == ["", "", "", "<", "<p", "", "", ""]
    assert main_text.main_text("<p>a < b and c > d</p>") == "a < b and c > d"
    assert main_text.main_text("<article><p>x&nbsp;&#233;&eacute;&#x4e2d;&lt;</p></article>") == "x éé中<"
    assert main_text.main_text("<article>" + "<div>" * 3000 + "deep text, here." + "</div>" * 3000 + "</article>") == "deep text, here."
    assert main_text.main_text("<article><p>" + "long, text. " * 50_000 + "</p></article>") == " ".join(["long, text."] * 50_000)
    assert main_text.main_text('<article><p title="a > b">in quotes, fine.</p><p class="x>unclosed, quote.</p></article>').startswith("in quotes, fine.")


@pytest.mark.parametrize(
    "part",
    [
        '<section id="related-work"><p>{}</p></section>', '<div class="social-studies"><p>{}</p></div>', '<table id="menu-prices"><tr><td>{}</td></tr></table>', '<section class="notices"><p>{}</p></section>',
        '<h2 id="discussion">{}</h2>', '<div class="news-form"><p>{}</p></div>',
    ],
)
def test_words_that_also_name_parts_of_articles(part):
    html = PAGE.format(body=f"<article><h1>Title</h1>{MANY}{part.format(LINE)}<div class='ad'>Buy, buy.</div><div class='comments'><p>{LINE}</p></div></article>")
    assert main_text.main_text(html) == f"Title {ALL} {LINE}"


def test_a_mark_never_decides_alone():
    assert main_text.main_text(f'<body><div class="sharing-content">{MANY}</div></body>') == ALL
    assert main_text.main_text(f'<body><div class="widget">{MANY}</div></body>') == ALL
    # two times the same page: what the threshold leaves out comes in without it
    html = PAGE.format(body=f"<div><h1>Title</h1>{MANY}</div>")
    assert "Reader says" not in main_text.main_text(html) and "Reader says" in main_text.main_text(html, threshold=0)
    short = f"<body><div class='x'>{MANY}</div><p>tiny</p></body>"
    assert main_text.main_text(short) == ALL and main_text.main_text(short, threshold=0) == f"{ALL} tiny"


@pytest.mark.parametrize("html", ["<a " * 333_000, "<div>" * 100_000 + "deep text, here.", "<b>" * 50_000 + "x<br>" * 50_000, "<div>" * 30_000 + "<li>x" * 30_000, "<div>" * 30_000 + "</x></a>" * 30_000, '<a "' * 100_000 + ">", "<p>x" * 100_000])
def test_hostile_pages_take_time_in_proportion(html):
    start = time.process_time()
    main_text.main_text(html)
    assert time.process_time() - start < 4


def test_ratios_equal_plain_ones():
    html = PAGE.format(body="<article><h1>A title</h1>" + "".join(f"<p>{t}</p><ul><li>{t[:9]}</li><li><a href='#'>{t[3:12]}</a></li></ul>" for t in TEXTS) + "</article>")
    blocks = main_text.blocks_of(html)
    keys = [(e.path, links) for e, _, links in blocks]
    length = [sum(len(t) for k2, (_, t, _) in zip(keys, blocks, strict=True) if k2 == k) / keys.count(k) for k in keys]
    signs = [sum(sum(c in ".,;:!?" for c in t) for k2, (_, t, _) in zip(keys, blocks, strict=True) if k2 == k) / keys.count(k) for k in keys]

    def smooth(values, i):
        near = [(math.exp(-0.5 * d**2), values[i + d]) for d in range(-2, 3) if 0 <= i + d < len(values)]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    fused = [math.sqrt(math.sqrt(a * (1 + b)) * math.sqrt(smooth(length, i) * (1 + smooth(signs, i)))) for i, (a, b) in enumerate(zip(length, signs, strict=True))]
    want = [sum(f for f, k2 in zip(fused, keys, strict=True) if k2 == k) / keys.count(k) for k in keys]
    assert main_text.fused_ratios(blocks).tolist() == pytest.approx(want)
    assert len(set(keys)) > 5


def test_extract_rows(spark):
    rows = [(1, None, "u", "text!"), (2, PAGE.format(body=f"<article><p>{TEXTS[0]}</p></article>"), None, None), (2, "", "u", "x")]
    got = main_text.extract(spark.createDataFrame(rows, "page_id long, html string, url string, text string")).collect()
    assert sorted((r.page_id, r.url or "", r.text) for r in got) == [(1, "u", ""), (2, "", TEXTS[0]), (2, "u", "")]
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


URLS = [
    ("https://Sub.Example.COM:80/en/7?x=1", "sub.example.com:80", "/en/7", "com/en/", "block"), ("http://a.example.com/en/71#x", "a.example.com", "/en/71", "example.com/en/7", "allow"), ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
    ("x://example.net/de/88", "example.net", "/de/88", "example.net/de/8", "block"), ("x://notexample.net/de/88", "notexample.net", "/de/88", "net/de/", "allow"), ("x://ÄB.org/es/", "Äb.org", "/es/", "org/es/", "block"),
    (None, "", "", None, None), ("no scheme/en/7", "", "", None, None), ("://", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://net/de/?q", "net", "/de/", "net/de/", "allow"), ("http://h?p/de/", "h", "", None, None),
]


def test_hosts_paths_and_rules(spark):
    rows = host_reputation.with_parts(spark.createDataFrame([(u,) for u, *_ in URLS], "url string"))
    got = rows.select("host", "path", host_reputation.first_rule(host_reputation.RULES, "rule").alias("rule"), host_reputation.first_rule(host_reputation.RULES, "verdict").alias("verdict")).collect()
    # a port is part of the host, so example.com's rule does not fit the first url; neither does com's
    assert [tuple(r) for r in got][1:] == [u[1:] for u in URLS][1:] and tuple(got[0])[:2] == URLS[0][1:3]


def plain_reputation(hosts, outcomes):
    """The same estimate by plain loops."""
    levels = {h: (h.split(".")[-1], ".".join(h.split(".")[-2:]), h) for h in hosts}
    counts = [defaultdict(lambda: [0, 0]) for _ in range(3)]
    for h in hosts:
        n, k = outcomes.get(h, (0, 0))
        for level in range(3):
            counts[level][levels[h][level]][0] += n
            counts[level][levels[h][level]][1] += k
    n, k = sum(v[0] for v in counts[0].values()), sum(v[1] for v in counts[0].values())
    above = {levels[h][0]: k / n if n else 0.5 for h in hosts}
    for level in range(3):
        units = {u: (*c, above[next(levels[h][max(level - 1, 0)] for h in hosts if levels[h][level] == u)]) for u, c in counts[level].items()}
        some = [(n, k, m) for n, k, m in units.values() if n]
        spread, each, pages = sum(n * (k / n - m) ** 2 for n, k, m in some), sum(m * (1 - m) for _, _, m in some), sum(n * m * (1 - m) for n, _, m in some)
        rho = (spread - each) / (pages - each) if pages > each else 1.0
        tau = 1000.0 if rho <= 0 else min(1000.0, max(1.0, (1 - rho) / rho))
        shrunk = {u: (k + tau * m, n - k + tau * (1 - m)) for u, (n, k, m) in units.items()}
        above = {u: a / (a + b) for u, (a, b) in shrunk.items()}
    return {u: a / (a + b) - 1.645 * math.sqrt(a * b / (a + b) ** 2 / (a + b + 1)) for u, (a, b) in shrunk.items()}


def test_reputation_equals_plain_loops(spark):
    outcomes = {"a.x.com": (40, 39), "b.x.com": (30, 3), "c.y.com": (5, 5), "d.z.org": (50, 2), "e.z.org": (1, 1)}
    hosts = [*outcomes, "new.x.com", "new.z.org", "else.net"]
    got = host_reputation.reputation(spark.createDataFrame([(h,) for h in hosts], "host string"), spark.createDataFrame([(h, *v) for h, v in outcomes.items()], "host string, n long, k long"))
    want = plain_reputation(hosts, outcomes)
    bounds = {r.host: r.bound for r in got.collect()}
    assert bounds == pytest.approx(want)
    assert bounds["a.x.com"] > 0.5 > bounds["d.z.org"]


def test_judging_pages(spark):
    pages = spark.createDataFrame([(i, f"http://good.a.com/xx/{i}", "p") for i in range(20)] + [(100 + i, f"http://bad.b.com/xx/{100 + i}", "p") for i in range(20)] + [(None, None, "p"), (7, "http://good.a.com/xx/7", "p")], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100 + i, 0, 1) for i in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = host_reputation.judge_urls(pages, host_reputation.labelled_pages(pages, labels)).collect()
    assert len(got) == 42
    assert {(r.host, r.verdict) for r in got if r.host} == {("good.a.com", "allow"), ("bad.b.com", "block")}
    none = host_reputation.judge_urls(pages, host_reputation.labelled_pages(pages, labels.limit(0)))
    assert none.count() == 42 and host_reputation.judge_urls(pages.limit(0), host_reputation.labelled_pages(pages.limit(0), labels)).count() == 0


def test_country_registries(spark):
    rows = host_reputation.with_levels(spark.createDataFrame([("www.bbc.co.uk",), ("a.b.com",), ("co.uk",), ("localhost",), ("",), ("u@x.y.org:8080",)], "host string")).collect()
    assert [(r.domain, r.suffix) for r in rows] == [("bbc.co.uk", "co.uk"), ("b.com", "com"), ("co.uk", "uk"), ("localhost", "localhost"), ("", ""), ("y.org", "org")]
