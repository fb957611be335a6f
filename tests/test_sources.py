"""Walks, selectors and blocks against plain Python and fixed pages."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from jobloom.sources import postings_json as J
from jobloom.sources import records as R
from jobloom.sources import sitemap
from jobloom.sources.selectors import Selector, read_texts

FILES = "url string, status int, body string"


def index(*urls, tag="sitemap", lastmod=None):
    date = f"<lastmod>{lastmod}</lastmod>" if lastmod else ""
    return f"<{tag}index>" * (tag == "sitemap") + "<urlset>" * (tag == "url") + "".join(f"<{tag}><loc>{u}</loc>{date}</{tag}>" for u in urls)


def urlset(*urls, lastmod=None):
    return index(*urls, tag="url", lastmod=lastmod) + "</urlset>"


def plain_walk(files: dict, roots, job=None, smap=None, include=None, since=None, max_files=50, max_urls=10**9, depth=3):
    """A queue, one file after the other; files: url -> (status, [(loc, lastmod)], is index)."""
    queue, seen, urls, out, errors, n = [(u, 0) for u in roots], set(), {}, [], [], 0
    keep = lambda u, d: (not smap or re.search(smap, u)) and (not since or not d or d >= since)
    while queue:
        if n >= max_files or len(out) >= max_urls:
            return out, errors, n, True
        url, level = queue.pop(0)
        if level > depth or url in seen:
            continue
        seen.add(url)
        n += 1
        status, listed, is_index = files.get(url, (404, [], False))
        if status != 200:
            errors.append((url, f"HTTP {status}"))
            continue
        nested, cut = [], False
        for loc, date in listed:
            if not is_index and len(out) >= max_urls:
                cut = True
                break
            if is_index or (re.search(r"\.xml$", loc) and not (job and re.search(job, loc))):
                nested.append((loc, date))
            elif (not job or re.search(job, loc)) and (not include or re.search(include, loc, re.I)) and (not since or not date or date >= since) and loc not in urls:
                urls[loc] = 1
                out.append((loc, date))
        queue += [(u, level + 1) for u, d in nested if keep(u, d)]
        if cut:
            return out, errors, n, True
    return out, errors, n, False


def walked(spark, rows, roots, **kw):
    w = sitemap.frontier_walk(spark.createDataFrame(rows, FILES), roots, **kw)
    return [(r.url, r.lastmod) for r in w.entries.orderBy("found").collect()], sorted(map(tuple, w.errors.collect())), w.files, w.truncated


def test_a_chain_of_four_files(spark):
    """The root is level 0; the file at level 3 is read, the one below it isn't."""
    rows = [(f"https://a.b/{k}.xml", 200, index(f"https://a.b/{k + 1}.xml")) for k in range(3)] + [("https://a.b/3.xml", 200, urlset("https://a.b/job/3", "https://a.b/4.xml")), ("https://a.b/4.xml", 200, urlset("https://a.b/job/4"))]
    assert walked(spark, rows, ["https://a.b/0.xml"])[0] == [("https://a.b/job/3", None)]
    files = spark.createDataFrame([(u, b) for u, _, b in rows], "url string, body string")
    assert [r.url for r in sitemap.walk(files, spark.createDataFrame([("https://a.b/0.xml",)], "url string"), "/job/").collect()] == ["https://a.b/job/3"]


def test_a_file_that_lists_itself_and_one_that_is_gone(spark):
    rows = [("r.xml", 200, index("r.xml", "gone.xml", "bad.xml", "c.xml", "c.xml")), ("c.xml", 200, urlset("https://a.b/job/1?x", "https://a.b/job/1", "nonsense", "r.xml", "https://a.b/list.xml?p=2")), ("bad.xml", 503, "x"), ("https://a.b/list.xml?p=2", 200, "<loc>https://a.b/job/2&amp;c</loc>")]
    got = walked(spark, rows, ["r.xml"], job_pattern="/job/")
    assert got == ([("https://a.b/job/1", None), ("https://a.b/job/2&c", None)], [("bad.xml", "HTTP 503"), ("gone.xml", "HTTP 404")], 5, False)


def test_walks_of_random_trees(spark):
    """Files that list files and jobs at random, with every filter and cap, against a queue."""
    rng = random.Random(7)
    for trial in range(7):
        names = [f"https://h.x/{'abc'[k % 3]}{k}.xml" for k in range(10)]
        jobs = [f"https://h.x/{'Job' if k % 2 else 'job'}/{'xyz'[k % 3]}-{k}" for k in range(12)]
        files, rows = {}, []
        for u in names[:9]:
            is_index, status, date = rng.random() < 0.5, rng.choice([200, 200, 200, 200, 500]), lambda: rng.choice([None, "2026-01-05", "2026-03-05"])
            listed = [(rng.choice(names if is_index else names + jobs * 2), date()) for _ in range(rng.randrange(5))]
            tag = "sitemap" if is_index else "url"
            body = f"<{tag}index>" * is_index + "<urlset>" * (not is_index) + "".join(f"<{tag}><loc>{x}</loc>" + (f"<lastmod>{d}</lastmod>" if d else "") + f"</{tag}>" for x, d in listed)
            files[u] = (status, listed, is_index)
            rows.append((u, status, body))
        kw = {"job": rng.choice([None, "(?i)/job/"]), "smap": rng.choice([None, "/[ab]"]), "include": rng.choice([None, "/JOB/[xy]"]), "since": rng.choice([None, "2026-02-01"]), "max_files": rng.choice([3, 50]), "max_urls": rng.choice([2, 10**9]), "depth": rng.choice([1, 3])}
        out, errors, n, truncated = plain_walk(files, names[:2], **kw)
        got = walked(spark, rows, names[:2], job_pattern=kw["job"], sitemap_pattern=kw["smap"], include_pattern=kw["include"], since=kw["since"], max_files=kw["max_files"], max_urls=kw["max_urls"] if kw["max_urls"] < 10**9 else None, depth=kw["depth"])
        assert got == (out, sorted(errors), n, truncated), (trial, kw, files)


def test_the_first_of_equals_is_the_best_block(spark):
    """Two postings of one block with as many keys: the first, on every page."""
    rows = [(k, f'<script type="application/ld+json">[{{"@type":"JobPosting","a":"first {k}"}},{{"@type":"JobPosting","a":"second {k}"}}]</script><script type="application/ld+json">{{"@type":"JobPosting","a":"third"}}</script>') for k in range(12)]
    got = {r.page_id: r.posting for r in J.best_block(J.collect_postings(spark.createDataFrame(rows, "page_id long, html string"))).collect()}
    assert all(f"first {k}" in got[k] for k in range(12))


PAGE = """<!doctype html><html><body class="x"><div id="main" data-role="Pay Box"><p class="pay">12 tr<br>net<img src=a>
</p><ul class=tags><li class="tag a">SQL<li class=tag>Go<li>none</ul><p>one<p>two</div><section><div class=pay><b>99</b> tr</div><span lang=en-GB>hi</span><em>a</em><em>b</em><input name=q></section>
<table><tr><td>1<td>2<tr><td>3</table></body></html>"""


@pytest.mark.parametrize(
    "selector, texts",
    [
        (".pay", ["12 trnet\n", "99 tr"]), ("div.pay", ["99 tr"]), ("#main .pay", ["12 trnet\n"]), ("section > .pay, #main > p", ["12 trnet\n", "one", "two", "99 tr"]), ("ul.tags > li.tag", ["SQL", "Go"]), ("li", ["SQL", "Go", "none"]),
        ("[data-role~=Box] li:first-child", ["SQL"]), ('[data-role="pay box" i] > p + p', ["two"]), ("[lang|=en]", ["hi"]), ("span ~ em", ["a", "b"]), ("span + em", ["a"]), ("em + em", ["b"]), ("section *", ["99 tr", "99", "hi", "a", "b", ""]), ("body > div b", []), ("body div b", ["99"]),
        ("[class^=ta]", ["SQLGonone", "SQL", "Go"]), ("[class$=g]", ["Go"]), ("[data-role*='y B'] p.pay", ["12 trnet\n"]), ("[name]", [""]), ("td", ["1", "2", "3"]), ("tr:first-child > td", ["1", "2"]), (".missing", []),
    ],
)
def test_selectors(selector, texts):
    assert read_texts(PAGE, [Selector(selector)]) == [texts]


@pytest.mark.parametrize("selector", ["", "a,", "> a", "a >", "p:hover", "a[", ".", "a b,,c"])
def test_selectors_that_cannot_be_read(selector):
    with pytest.raises(ValueError, match="selector"):
        Selector(selector)


def test_fallbacks(spark):
    """The void element that hid a page's end before; the first element counts for pay even if it is empty."""
    pages = ['<div class="pay">12 tr<br>net</div><p>unrelated tail</p><div class="pay">99</div>', '<div class="pay"> </div><div class="pay">99</div><i class=s>SQL</i><i class=s> </i>', "", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", R.fallbacks(F.col("html"), ".pay", ".s").alias("f"), R.selected(F.col("html"), ".pay").alias("all")).orderBy("k").collect()
    assert [(r.f.salary_text, r.f.skills) for r in rows] == [("12 trnet", None), (None, ["SQL"]), (None, None), (None, None)]
    assert rows[0]["all"] == ["12 trnet", "99"]
    assert spark.range(1).select(R.fallbacks(F.lit(PAGE)).alias("f")).first().f == (None, None)
