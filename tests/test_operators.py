"""Sources, lifecycle and streaming on small tables of our own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobloom.functions.text import html_to_text
from jobloom.operators import lifecycle as L
from jobloom.operators.fit import Group, Profile, score
from jobloom.operators.normalize import normalize
from jobloom.operators.search import JobFilters
from jobloom.sources import catalogue as C
from jobloom.sources import postings_json as J
from jobloom.sources import sitemap
from jobloom.streaming.misses import MissCounter, first_seen, run_stream


def test_walk(spark):
    files = spark.createDataFrame(
        [
            ("root", "<sitemapindex><sitemap><loc>child.xml</loc></sitemap><sitemap><loc>root</loc></sitemap><sitemap><loc>gone.xml</loc></sitemap></sitemapindex>"),
            ("child.xml", "<urlset><url><loc>https://A.b/job/1?x=1</loc><lastmod>2026-01-01</lastmod></url><url><loc>https://a.b/job/1/</loc></url><url><loc>https://a.b/about</loc></url><url><loc>more.xml</loc></url></urlset>"),
            ("more.xml", "<loc>https://a.b/job/2&amp;c</loc>"),
        ],
        "url string, body string",
    )
    got = {(r.url, r.lastmod) for r in sitemap.walk(files, spark.createDataFrame([("root",)], "url string"), "/job/").collect()}
    assert got == {("https://a.b/job/1", "2026-01-01"), ("https://a.b/job/2&c", None)}


def test_postings_in_pages(spark):
    pages = spark.createDataFrame(
        [
            (1, '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","a":1,}]}</script><script type=application/ld+json>broken {</script>'),
            (2, '<script type="application/ld+json">[{"@type":["Thing","x:JobPosting"],"a":1},{"@type":"JobPosting","a":1,"b":2}]</script>'),
            (3, '<script type="text/javascript">{"@type":"JobPosting"}</script>'),
            (4, None),
        ],
        "page_id long, html string",
    )
    assert {r.page_id: r["count"] for r in J.collect_postings(pages).groupBy("page_id").count().collect()} == {1: 1, 2: 2}
    best = {r.page_id: r.posting for r in J.best_block(J.collect_postings(pages)).collect()}
    assert '"b": 2' in best[2]


def test_stream_equals_replay(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a", "OPEN", 0), (1, "b", "OPEN", 2), (2, "c", "OPEN", 0)], "source_id long, external_id string, status string, miss_count int")
    sweeps = [[(1, "a")], [(1, "b"), (2, "c")], [(1, "b")]]
    want = stored
    for rows in sweeps:
        want = L.reap_missing(want, spark.createDataFrame(rows, "source_id long, external_id string"))
    for k, rows in enumerate(sweeps):
        spark.createDataFrame(rows, "source_id long, external_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"s{k}"))
    sink = MissCounter(spark, str(tmp_path / "state"), stored)
    for k in range(3):
        run_stream(spark.readStream.schema("source_id long, external_id string").parquet(str(tmp_path / "in" / f"s{k}")), lambda df, _, k=k: sink(df, k), str(tmp_path / f"cp{k}"))
    key = lambda df: sorted(map(tuple, df.select(*L.KEY, "status", "miss_count").collect()))
    assert key(sink.state()) == key(want)
    sink(spark.createDataFrame([(1, "a")], "source_id long, external_id string"), 2)  # a replayed batch changes nothing
    assert key(sink.state()) == key(want)
    again = MissCounter(spark, str(tmp_path / "state"), stored)  # a restart goes on from what is there
    assert again.version == 2 and key(again.state()) == key(want)


def test_no_sweep_no_reaping(spark):
    stored = spark.createDataFrame([(1, "a", "OPEN", 0)], "source_id long, external_id string, status string, miss_count int")
    none = spark.createDataFrame([], "source_id long, external_id string")
    assert L.reap_missing(stored, none).first().status == "OPEN"


def test_fit_flags_and_range(spark):
    p = Profile(years=2, core=[Group(["csharp"], 35)], exclusive=["sap"], other_stacks=["java", "sap"], senior_words=["lead"], languages=["req-japanese"], home=["Thủ Đức"])
    rows = spark.createDataFrame(
        [(1, "lead dev", ["csharp"], [], [], None, None, None, None), (2, "dev", ["sap"], [], [], None, None, None, None), (3, "dev", ["csharp"], ["req-japanese"], [], "MID", 2, "REMOTE", "thu duc"), (4, "dev", [], [], [], None, None, None, None), (5, "dev", ["csharp"], [], [], "INTERN", 0, "REMOTE", "Thủ Đức")],
        "k int, title_key string, title_skills array<string>, declared array<string>, text_skills array<string>, level string, years_min int, work_mode string, district string",
    )
    got = {r.k: r.r for r in rows.select("k", score(p).alias("r")).collect()}
    assert got[1].flags == ["too-senior"] and got[2].flags == ["other-stack"] and got[3].flags == ["lang-required"]
    assert got[4].band == "unknown" and got[5].band == "stretch"
    assert all(0 <= r.score <= 100 for r in got.values())


def test_filters_parse_junk():
    f = JobFilters.parse({"q": [" ring "], "source": "x", "from": "15", "salary": "on", "days": ""})
    assert (f.q, f.source_id, f.salary_from, f.salary_only, f.posted_within) == ("ring", None, 15, True, None)


def test_html(spark):
    x = spark.range(1).select(html_to_text(F.lit("<p>a&nbsp;&amp;lt;</p><style>p{}</style><li>b</li>")).alias("x")).first().x
    assert x == "a < • b"


def test_first_seen_in_a_stream(spark, tmp_path):
    rows = [(1, "a", "2026-01-01 00:00:00"), (1, "a", "2026-01-01 00:05:00"), (1, "b", "2026-01-01 00:06:00"), (2, "a", "2026-01-01 00:07:00")]
    spark.createDataFrame(rows, "user_id long, kind string, at string").selectExpr("user_id", "kind", "cast(at as timestamp) ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, kind string, ts timestamp").parquet(str(tmp_path / "in"))
    seen = []
    run_stream(first_seen(stream, ["user_id", "kind"]), lambda df, _: seen.extend((r.user_id, r.kind) for r in df.collect()), str(tmp_path / "cp"))
    assert sorted(seen) == [(1, "a"), (1, "b"), (2, "a")]


def test_sources_must_be_complete(spark):
    source = spark.createDataFrame([("a", "A", "h", "API", None, None, 1, ""), ("b", "B", "h", "MANUAL", None, None, 2, "")], C.SOURCE)
    target = lambda *codes: spark.createDataFrame([(c, True, [], None) for c in codes], C.TARGET)
    assert {r.code: r.config for r in C.seeds(source, target("a", "b")).collect()} == {"a": None, "b": None}
    with pytest.raises(ValueError, match=r"b \(no target\), x \(not in the catalogue\)"):
        C.seeds(source, target("a", "x"))
    with pytest.raises(ValueError, match="by hand"):
        C.adapter("b", C.MANUAL)
    with pytest.raises(ValueError, match="no adapter"):
        C.adapter("z", "FTP")


def test_raw_records_come_back(spark, tmp_path):
    rows = [("s", "1", "2026-01-31 23:00:00", "old"), ("s", "1", "2026-02-01 01:00:00", "new"), ("t", "a/b", "2026-02-01 00:00:00", "x")]
    df = spark.createDataFrame(rows, "source string, external_id string, at string, payload string").withColumn("at", F.col("at").cast("timestamp"))
    C.write_raw(df, str(tmp_path / "raw"))
    got = {(r.source, r.external_id, r.payload, r.month) for r in C.read_raw(spark, str(tmp_path / "raw")).collect()}
    assert got == {("s", "1", "new", "2026-02"), ("t", "a/b", "x", "2026-02")}


def test_profile_errors_name_their_path():
    for config, path in (({"yers": 1}, "yers"), ({"core": [{"skills": ["a"], "weight": 1}, {"skills": []}]}, r"core\[1\]"), ({"bonus": ["a", 3]}, r"bonus\[1\]"), ({"years": "2"}, "years"), ({"great": 10}, "bands")):
        with pytest.raises(ValueError, match=path):
            Profile.parse(config)


def test_normalize_never_throws(spark):
    """Postings that are empty, of other kinds or broken give rows that say what they lack; other columns pass through."""
    postings = ["{}", "[]", "nonsense", "", None, '{"title":5,"hiringOrganization":"x","jobLocation":7,"baseSalary":[],"skills":{"name":"a"},"employmentType":{}}', '{"title":"Dev","jobLocation":["Hà Nội",null,{"address":{"addressRegion":"N/A"}}],"jobLocationType":"telecommute"}']
    df = spark.createDataFrame([(i, p, None, None, None, None, "kept") for i, p in enumerate(postings)], "k int, posting string, page_url string, salary_text string, skills array<string>, work_mode string, mine string")
    rows = {r.k: r for r in normalize(df, as_of=F.lit("2026-01-01").cast("timestamp")).collect()}
    assert len(rows) == len(postings) and all(r.mine == "kept" for r in rows.values())
    assert all(rows[i].parse_status == "PARTIAL" and rows[i].title == "" for i in range(5))
    assert rows[5].title == "5" and rows[5].skills == ["a"] and rows[5].employment_type is None
    assert rows[6].work_mode == "REMOTE" and [x.slug for x in rows[6].locations] == ["ha-noi"]
