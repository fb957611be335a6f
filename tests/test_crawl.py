"""The data sources over stored pages and answers: all kinds of events, budgets, pushed filters, offsets and replays."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from jobloom.sources import crawl
from jobloom.sources import postings_json as J


@pytest.fixture()
def formats(spark):
    crawl.register(spark)


def page(k: int) -> str:
    block = f'<script type="application/ld+json">{{"@type":"JobPosting","title":"Job {k}","a":1}}</script>'
    return (block if k % 3 else "<p>none</p>") + f'<b class="pay"> {k} tr </b><i class=s>SQL</i>'


def pages(spark, n=60):
    rows = [(k, f"s{k % 2}", None if k == 7 else f"https://a.b/{'about' if k % 10 == 9 else 'job'}/x-{k}.html", 404 if k % 7 == 1 else 200, None if k == 12 else page(k)) for k in range(n)]
    return spark.createDataFrame(rows, "k long, source string, url string, status int, html string")


def plain_events(rows, budget):
    left, out = {}, []
    for r in sorted(rows, key=lambda r: (r.source, r.k)):
        if r.url is None:
            continue
        if "about" in r.url:
            out.append((r.source, "skipped", r.url, None, None, None, "excluded"))
            continue
        own = re.search(r"-(\d+)\.html", r.url)[1]
        out.append((r.source, "seen", r.url, own, None, None, None))
        left[r.source] = left.get(r.source, budget) - 1
        if left[r.source] < 0:
            continue
        if r.status != 200 or not r.html:
            out.append((r.source, "error", r.url, own, None, None, f"HTTP {r.status}"))
        elif r.k % 3 == 0:
            out.append((r.source, "skipped", r.url, own, None, None, "no posting"))
        else:
            out.append((r.source, "job", r.url, own, f"Job {r.k}", f"{r.k} tr", None))
    return sorted(out, key=str)


def read(spark, path, **options):
    opts = {"path": str(path), "excludePatterns": '["/about/"]', "externalIdPattern": r"-(\d+)\.html", "salarySelector": ".pay", "skillsSelector": ".s"} | options
    return spark.read.format("postings").options(**opts).load()


def events(df):
    got = df.select("source", "kind", "url", "external_id", F.get_json_object("posting", "$.title"), "salary_text", "message", "skills").collect()
    assert all((r.skills == ["SQL"]) == (r.kind == "job") for r in got)
    return sorted((tuple(r)[:7] for r in got), key=str)


@pytest.mark.parametrize("budget", [None, 0, 4, 1000])
def test_all_kinds_of_events(spark, tmp_path, formats, budget):
    """A source in several files: its budget goes on from file to file."""
    df = pages(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    crawl.write_pages(df, str(tmp_path / "p"), "k")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(crawl.parquet_files(str(tmp_path / "p"))) > 1
    got = events(read(spark, f"file:{tmp_path}/p", **({} if budget is None else {"maxDetailPages": str(budget)})))
    assert got == plain_events(df.collect(), 10**9 if budget is None else budget)
    if budget is None:
        assert {x[1] for x in got} == {"seen", "job", "skipped", "error"}


def test_filters_are_pushed_down(spark, tmp_path, formats):
    df = pages(spark)
    crawl.write_pages(df, str(tmp_path / "p"), "k")
    whole = read(spark, tmp_path / "p", maxDetailPages="5")
    for keep, cond in ((lambda e: e[0] == "s1", F.col("source") == "s1"), (lambda e: e[1] == "seen", F.col("kind") == "seen"), (lambda e: e[0] == "s0" and e[1] in ("job", "error"), (F.col("source") == "s0") & F.col("kind").isin("job", "error")), (lambda e: e[2].endswith("5.html"), F.col("url").endswith("5.html"))):
        assert events(whole.where(cond)) == [e for e in plain_events(df.collect(), 5) if keep(e)]
    r = crawl.PageReader({"path": str(tmp_path / "p")})
    from pyspark.sql.datasource import EqualTo, IsNotNull

    rest = list(r.pushFilters([EqualTo(("source",), "none"), IsNotNull(("url",))]))
    assert [type(x).__name__ for x in rest] == ["IsNotNull"] and r.partitions() == []


def test_pages_are_read_as_the_columns_read_them(spark):
    """The readers without Columns find the same best posting as those with."""
    bodies = ['{"@type":"JobPosting","a":1}', '<![CDATA[ {"@type":"JobPosting","b":1,} ]]>', "{&quot;@type&quot;:&quot;x:JobPosting&quot;,&quot;c&quot;:[1,]}", "broken {", '{"@graph":[{"@type":["A","JobPosting"],"d":1,"e":2},{"@type":"JobPosting","f":1,"g":2}]}', '[{"@type":"Person"}]', ""]
    htmls = ["".join(f"<script type='application/ld+json'>{b}</script>" for b in bodies[i:j]) for i in range(len(bodies)) for j in range(i + 1, len(bodies) + 1)]
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")
    best = {r.page_id: json.loads(r.posting) for r in J.best_block(J.collect_postings(df)).collect()}
    for k, h in enumerate(htmls):
        assert J.best_of_page(h) == best.get(k), h


def answers(spark, path, part=None):
    """Three queries; ids of the second overlap the first; the third fails on its second page. part: (k, n) writes the k-th of n parts."""
    date = lambda k: f"2026-0{1 + k % 9}-01T00:00:00+07:00"
    body = lambda ids, n: json.dumps({"meta": {"nbPages": n}, "data": [{"jobId": k, "jobUrl": f"https://a.b/{k}", "lastUpdatedOn": date(k)} for k in ids]})
    rows = [("a", p, 200, body(range(10 * p, 10 * p + 10), 3)) for p in range(3)] + [("b", p, 200, body(range(10 * p + 5, 10 * p + 15), 9)) for p in range(9)]
    rows += [("c", 0, 200, body(range(200, 204), 5)), ("c", 1, 500, None), ("", 0, 200, body([9, 8, 7, 6, 5], 1)), ("e", 0, 200, body([], 0))]
    rows = [r for i, r in enumerate(rows) if part is None or (7 * i) % part[1] == part[0]]
    spark.createDataFrame(rows, crawl.ANSWERS).repartition(3).write.mode("append").parquet(str(path))


def plain_search(queries, most, since=None):
    """The stored search of `answers`, in order."""
    months = lambda k: 1 + k % 9
    pages = {"a": [list(range(10 * p, 10 * p + 10)) for p in range(3)], "b": [list(range(10 * p + 5, 10 * p + 15)) for p in range(9)], "c": [list(range(200, 204)), None], "": [[9, 8, 7, 6, 5]], "e": [[]]}
    share, seen, n, out = -(-most // len(queries)), set(), 0, []
    for q in queries:
        mine, over = 0, False
        if q not in pages:
            break  # waits
        for p, ids in enumerate(pages[q]):
            if over or n >= most or mine >= share:
                break
            if ids is None:
                out.append(("error", None, q, p))
                break
            for k in ids:
                if n >= most or mine >= share:
                    over = True
                    break
                if k in seen:
                    continue
                seen.add(k)
                out.append(("seen", str(k), q, p))
                if since and months(k) < since:
                    if not q:
                        over = True
                        break
                    out.append(("skipped", str(k), q, p))
                    continue
                out.append(("job", str(k), q, p))
                n, mine = n + 1, mine + 1
    return sorted(out, key=str)


@pytest.mark.parametrize("queries, most, since", [(["a", "b", "c"], 60, None), (["a", "b"], 24, None), (["c", "x", "e", "a"], 100, None), ([], 10, None), ([], 10, 7), (["b", "a"], 30, 4)])
def test_a_search_in_batches(spark, tmp_path, formats, queries, most, since):
    """Answers come in four parts, in no order; the query, started anew after each, goes on from its offset, and each record comes once."""
    counts = []
    for k in range(4):
        answers(spark, tmp_path / "in", (k, 4))
        stream = spark.readStream.format("search_pages").options(path=str(tmp_path / "in"), queries=json.dumps(queries), maxJobs=str(most), **({"since": f"2026-0{since}-01"} if since else {})).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        got = sorted(((r.kind, r.external_id, r.query, r.page) for r in spark.read.schema(crawl.FOUND).parquet(str(tmp_path / "out")).collect()), key=str)
        counts.append(len(got))
    assert got == plain_search(queries or [""], most, since)
    assert counts == sorted(counts) and len(got) > 0


def test_offsets_are_replayed(spark, tmp_path):
    """A reader that begins anew gives the same rows between the same offsets, also once more is stored."""
    options, at, batches = {"path": str(tmp_path / "in"), "queries": '["a","b","c"]', "maxJobs": "60"}, {"query": 0, "page": 0}, []
    for k in range(4):
        answers(spark, tmp_path / "in", (k, 4))
        r = crawl.SearchReader(options)
        assert r.initialOffset() == {"query": 0, "page": 0}
        end = r.latestOffset()
        batches.append((at, end, [row for s in r.partitions(at, end) for row in r.read(s)]))
        at = end
    assert at == {"query": 2, "page": 2} and len({str(b[1]) for b in batches}) > 1
    for start, end, rows in reversed(batches):
        again = crawl.SearchReader(options)
        assert [row for s in again.partitions(start, end) for row in again.read(s)] == rows
