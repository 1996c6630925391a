"""HTML extraction and URL filters."""

import re

import pytest
from pyspark.sql import functions as F

from vecloom.llm import pages, urls

FRAME = "<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header>Site <a href=/>home</a></header><nav><ul>{links}</ul></nav>{main}<footer>&copy; host {n}</footer></body></html>"


def page(n: int, main: str) -> str:
    return FRAME.format(n=n, main=main, links="".join(f"<li><a href=/{k}>menu {k}</a></li>" for k in range(n % 4 + 1)))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b<br>c</p>", "a\nb c"), ("<article><h1>T</h1><p>x &amp; y&#233;<b>z</b></article><p>out", "T\nx & yéz"),
        ("<main><p>in</p><aside>no</aside><div class='cookie-notice'>no</div><form><label>no</label></form><section id=comments><article>no</article></section></main>", "in"),
        ("<p>a<!-- <p>no -->b<script>if (a<b) '</p>'</SCRIPT >c", "abc"), ("<p>a<!-- never closed", "a"), ("<p>1 < 2 and <3", "1 < 2 and <3"), ("<p title='>'>a</p><p title=\"'\">b", "a\nb"),
        ("<p hidden>no</p><p style='display: none'>no</p><div role=navigation>no</div><p>yes\xa0 yes", "yes yes"), ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("<header><h1>no</h1></header><article><header><h1>T</h1></header>x</article>", "T\nx"), ("<p>" + "w " * 200_000, " ".join(["w"] * 200_000)), ("<b>" * 3000 + "deep", "deep"),
    ],
)
def test_one_page(html, text):
    assert pages.main_text(html or "", None) == text


LONG = "a story of some length that makes up the page"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div class='content has-sidebar'><p>{LONG}</p></div>", LONG), (f"<article class='post discussion'><p>{LONG}</p></article>", LONG), (f"<div class='layout no-sidebar'><article>{LONG}</article></div>", LONG),
        (f"<div class='page social-post'><p>{LONG}</p></div>", LONG), (f"<div class='social'><div class='sharing'><article>{LONG}</article></div></div>", LONG),
        (f"<article>{LONG}</article><div class=comments><article>{LONG} no</article></div>", LONG), (f"<article>{LONG}</article><article class=discussion>{LONG} no</article>", LONG),
        (f"<article>{LONG}<div class='comment'>{LONG} no {LONG}</div></article>", LONG), (f"<p>{LONG}</p><div class='cookieNotice'>no</div>", LONG), (f"<p>{LONG}</p><div id='left-sidebar'>no</div>", LONG),
        (f"<aside><article>no</article></aside><div class=widget><main>{LONG}</main></div>", LONG), (f"<div class=share><p>{LONG}</p></div><div class=share>no</div>", LONG),
    ],
)
def test_names_spare_the_article(html, text):
    """Names of classes never rule out the only article, what it is in, or what holds most of the text."""
    assert pages.main_text(html, None) == text


def deduced(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select(F.xxhash64("page_id", "url").alias("page"), urls.host_of(F.col("url")).alias("host"), "html")
    return {r["host"]: pages.Template([t.asDict() for t in r["template"]], [t.asDict() for t in r["regions"]] if r["regions"] else None) for r in pages.templates(df).collect()}


def test_template_alone(spark):
    """Without any rule of tags or names, the slots' figures give the article, on hosts of few and of many pages."""
    d = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = [tuple(r) for r in d.select("page_id", "url", "html").collect()]
    found = deduced(spark, rows)
    host = {r["page_id"]: r["h"] for r in d.select("page_id", urls.host_of(F.col("url")).alias("h")).collect()}
    alone = 0
    for i, _, html in rows:
        want = pages.main_text(html, None)
        got = pages.main_text(html, found[host[i]], rules=False)
        alone += got == want
        assert pages.main_text(html, found[host[i]]) == want  # nothing of the article is dropped
        assert pages.main_text(html, None, rules=False) != want
    assert alone > 0.95 * len(rows)


@pytest.mark.parametrize("size", [2, 3, 5, 9, 40])
def test_roles_of_slots(spark, size):
    """The element with most of the text and all headings is the article: teasers of other stories, link lists and notices that
    differ from page to page stay outside, without a telling tag or name; what is inside stays, however short."""
    rows = []
    for n in range(size):
        teasers = "".join(f"<div class=t><a href=/{k}>Other story {k * n} that one can read next</a></div>" for k in range(3))
        body = "".join(f"<p>{f'sentence {n} {k} ' * 12}</p>" for k in range(3))
        rows.append((n, f"http://i.example/{n}", f"<html><body><div class=a><div class=b>Weather {n}</div>{teasers}</div><div class=c><h1>Title {n}</h1><div class=e>{body}<ul><li>point {n}</ul></div><div class=g>By writer {n}</div></div><div class=f>Printed at {n} o'clock</div></body></html>"))
    template = deduced(spark, rows)["i.example"]
    for n, _, html in rows:
        body = "\n".join(" ".join([f"sentence {n} {k}"] * 12) for k in range(3))
        assert pages.main_text(html, template, rules=False) == f"Title {n}\n{body}\npoint {n}\nBy writer {n}"


def test_templates(spark):
    rows, want = [], {}
    for n in range(60):
        story = [f"story {n} sentence {k} with its own words {n * k} {n + k}" for k in range(4)]
        main = "<div class=content><div class=tools>Print this page</div>" + "".join(f"<p>{s}</p>" for s in story) + "<div class=tools>All rights kept by the host of these pages and of all others that it has</div></div>"
        if n % 2:
            main = f"<article>{main}</article>"
        rows.append((n, f"http://www.{'ac'[n % 2]}.example/{n}", page(n, main)))
        want[n] = "\n".join(["Print this page"] * (n % 2) + story + ["All rights kept by the host of these pages and of all others that it has"] * (n % 2))
    rows += [(100, "http://b.example/1", page(1, "<article><p>alone</p></article>")), (101, None, None), (None, "x", "<p>a</p>"), rows[3]]
    rows += [(200 + n, "http://copies.example/", page(0, "<article><p>the same story on each page of the host</p></article>")) for n in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' as host", "1 as salt", "'t' as template")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in pages.extract_pages(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    texts = dict(got[i][:2] for i in range(len(got)))
    assert {n: texts[n] for n in want} == want
    assert texts[100] == "alone" and texts[101] == "" and texts[None] == "a"
    assert texts[205] == "the same story on each page of the host"
    assert pages.extract_pages(df.filter("page_id < -1")).count() == 0


def test_short_slots(spark):
    """Headlines, captions and lists between tags that occur once a page are kept, however long the body is."""
    rows = [(n, f"http://d.example/{n}", page(n, f"<div><h1>Headline {n}</h1><div class=body><p>{f'body {n} ' * 200}</p></div><figure><figcaption>caption {n}</figcaption></figure><div>Print this page</div></div>")) for n in range(20)]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Headline {n}\n{f'body {n} ' * 199}body {n}\ncaption {n}" for n in range(20)}


@pytest.mark.parametrize("size", [1, 2, 7, 8, 12, 40])
def test_recurring_headings(spark, size):
    """What tags place in the article stays, also if it recurs on every page, on hosts of any size. Elsewhere headings and
    short paragraphs stay if they differ from page to page."""
    rows = [(n, f"http://g.example/{n}", page(n, f"<article><h1>Daily weather report summary</h1><p>{f'rain {n} ' * 30}</p><p>Yes.</p></article>")) for n in range(size)]
    rows += [(100 + n, f"http://h.example/{n}", page(n, f"<div class=top><p>Print this page or send it to a friend</p></div><div><h1>Weather of day {n}</h1><p>{f'rain {n} ' * 30}</p><p>No {n}.</p></div>")) for n in range(size)]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(size):
        body = " ".join([f"rain {n}"] * 30)
        assert got[n] == f"Daily weather report summary\n{body}\nYes."
        assert got[100 + n] == ("Print this page or send it to a friend\n" if size == 1 else "") + f"Weather of day {n}\n{body}\nNo {n}."


def test_slots_choose(spark):
    """On a host with a template the slots choose the text, also where tags name an article that holds a part of it."""
    rows = [(n, f"http://e.example/{n}", page(n, f"<div><h1>Headline {n}</h1><article><p>{f'body {n} ' * 30}</p></article><p>correction {n}</p><p>Print this page</p></div>")) for n in range(20)]
    rows.append((99, "http://f.example/", rows[3][2]))
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {n: f"Headline {n}\n{f'body {n} ' * 29}body {n}\ncorrection {n}" for n in range(20)}
    assert got == want | {99: f"{'body 3 ' * 29}body 3"}  # without a template tags decide


def test_pages_of_data(spark, sf_dir):
    import html

    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in df.collect()}
    for r in pages.extract_pages(df).collect():
        inner = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        blocks = (html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1|ul|li)>", inner))
        assert r["text"] == "\n".join(" ".join(b.split()) for b in blocks if b.strip())


def test_classes_nest():
    rows = [{"token": t, "place": p, "vector": c, "everywhere": True} for t, p, c in [(1, 1.0, 7), (2, 9.0, 7), (3, 20.0, 7), (4, 3.0, 8), (5, 6.0, 8), (6, 8.0, 9), (7, 12.0, 9)]]
    t = pages.Template(rows)
    assert t.gap[8] == (7, 1) and t.slots == {1, 2, 3, 4, 5}  # class 9 crosses token 2


def test_globs():
    import fnmatch
    import random

    import numpy as np

    rng = random.Random(6)
    patterns = ["".join(rng.choice("abé字*?") for _ in range(rng.randint(0, 7))) for _ in range(90)] + ["*", "", "a" * 100 + "*b", "a?b", "?", "??", "*?é"]
    texts = ["".join(rng.choice("abé字😀") for _ in range(rng.randint(0, 9))) for _ in range(300)] + ["", "a" * 130 + "b", "aéb", "a😀b"]
    raw = "".join(texts).encode()
    got = urls.Globs(patterns).match(np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    for i, t in enumerate(texts):
        assert got[i].tolist() == [fnmatch.fnmatchcase(t, p) for p in patterns]


def test_urls(spark, same):
    from vecloom.llm import queries

    same(queries.op9_url_globs, urls.ORACLE_SQL)
    rows = [
        (1, "http://Sub.NET/x", "sub.net", "/x", None, "allow"), (2, "http://a.NET", "a.net", "", None, "allow"), (3, "HTTP://A.net/x?y#z", "a.net", "/x", "net/", "block"),
        (4, "https://m.example.net/en/1", "m.example.net", "/en/1", "example.net/en/", "allow"), (5, "https://myexample.com/de/", "myexample.com", "/de/", None, "allow"), (6, "https://example.com/de/?q", "example.com", "/de/", "example.com/de/", "block"),
        (7, "https://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"), (8, None, "", "", None, "allow"), (9, "no scheme", "", "", None, "allow"), (10, "http://my-spam.org/a", "my-spam.org", "/a", None, "block"),
        (11, "http://a.org/login.php", "a.org", "/login.php", None, "block"), (None, "http://a.org/" + "p" * 20000 + ".exe", "a.org", "/" + "p" * 20000 + ".exe", None, "block"), (12, "http://casino.org/about/", "casino.org", "/about/", None, "allow"),
    ]
    df = spark.createDataFrame([(*r[:2], "h", "r") for r in rows], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df).collect()}
    assert got[1][2:] == ("net/", "block")  # sub.net is a subdomain of net
    for r in rows[1:]:
        assert got[r[0]] == r[2:], r[0]
    assert urls.judge_urls(df.filter("page_id < -1")).count() == 0
