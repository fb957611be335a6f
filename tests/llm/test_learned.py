"""Operators that learn or search: held-out accuracy, bounds and brute force; and awkward tables for all of them."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobloom.llm import classifier, decontaminate, licenses, linededup, packing, rules, sharding, simhash, suffixes, wrappers
from jobloom.llm.common import table


# --- classifier ------------------------------------------------------------------------------------------------


def test_labeller_accuracies_are_recovered():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    votes = np.zeros((len(truth), 4), dtype=np.int64)
    for k, right in enumerate((0.9, 0.85, 0.8, 0.6)):
        says = np.where(rng.random(len(truth)) < right, truth, ~truth)
        votes[:, k] = np.where(rng.random(len(truth)) < 0.8, np.where(says, classifier.GOOD, classifier.BAD), classifier.NONE)
    patterns, index, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = classifier.fit_labellers(patterns, count)
    assert ((p[index.ravel()] > 0.5) == truth).mean() > 0.9


def test_held_out_accuracy(spark):
    """Fitted on half of the labelled documents, the scorers agree with the other half's labels."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = classifier.fit(docs, labels.where(seen))
    scored = classifier.classify(docs, model).withColumnRenamed("quality", "q")
    out = scored.join(labels.where(~seen), "doc_id").collect()
    assert len(out) > 50
    assert np.mean([(r.clean < 0.5) == (r.toxic == 1) for r in out]) > 0.9
    assert np.mean([(r.q >= 0.5) == (r.quality == 1) for r in out]) > 0.8


def test_the_fit_does_not_depend_on_partitions(spark):
    """More rows than are fitted: the documents in 3 and in 7 partitions give the same weights, so the same rows."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    a, b = (classifier.fit(docs.repartition(n), labels, train_rows=300) for n in (3, 7))
    assert np.array_equal(a.quality, b.quality) and np.array_equal(a.abuse, b.abuse)


# --- rules -----------------------------------------------------------------------------------------------------


def test_binomial_tail(spark):
    rows = [(k, n) for n in (10, 300, 5000) for k in (0, 1, 5, 9)]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", rules.log_binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("v")).collect()
    for r in got:
        want = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert math.isclose(math.exp(r.v), want, rel_tol=1e-9)


def test_certified_cutoffs_hold(spark):
    """A rule that good documents never break is certified for a large stratum, never for one of ten labels."""
    zero = {r: 0.0 for r in rules.CUTOFFS}
    rows = [("big", *(zero | {"symbols": 0.0 if k % 4 else 0.5}).values(), k % 4 > 0) for k in range(12_000)]
    rows += [("small", *(zero | {"symbols": 0.0 if k % 4 else 0.5}).values(), k % 4 > 0) for k in range(12)]
    held = spark.createDataFrame(rows, "stratum string, " + ", ".join(f"{r} double" for r in rules.CUTOFFS) + ", good boolean")
    assert {(r.stratum, r.rule) for r in rules.certified_cutoffs(held).collect()} == {("big", "symbols")}


# --- decontamination -------------------------------------------------------------------------------------------


def edits_within(item: str, text: str) -> int:
    """Fewest edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def test_benchmark_matches(spark, docs):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(8, 20)))) for k in range(8)] + [(8, "tiny one"), (9, ""), (10, None)]
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(40))
        if i % 3:
            t = list(rng.choice(items[:8])[1])
            for _ in range(rng.randint(0, 9)):
                t[rng.randrange(len(t))] = rng.choice("abcdefgh")
            text = text[:60] + " " + "".join(t) + " " + text[60:]
        rows.append((i, text))
    rows += [(60, "holds Tiny, ONE there"), (61, None), (62, "")]
    got = {(r.doc_id, r.item_id): r.n_edits for r in decontaminate.benchmark_matches(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for k, item in items:
        w = decontaminate.folded((item or "").encode()).decode()
        if not w:
            continue
        allowed = max(0, min(int(len(w) * decontaminate.RATE), (len(w) - decontaminate.Q) // decontaminate.Q)) if len(w) >= decontaminate.Q else 0
        for i, text in rows:
            if (e := edits_within(w, decontaminate.folded((text or "").encode()).decode())) <= allowed:
                want[i, k] = e
    assert got == want


# --- pages -----------------------------------------------------------------------------------------------------


def page(k: int) -> str:
    body = "".join(f"<p>Paragraph {j} of page {k} says caf&eacute; &amp;\n tea.</p>" for j in range(1 + k % 4))
    note = "<div class='cookie-notice'>We use cookies.</div>" if k % 2 else ""
    return f"<html><head><title>T{k}</title><style>p{{}}</style></head><body><nav><ul><li>Home</li><li>News</li></ul></nav>{note}<article><h1>Title {k}</h1>{body}</article><div class=\"comments\"><p>Reader {k}: no!</p></div><footer>© us</footer><script>var x = '<p>no</p>';</script></body></html>"


def test_main_text(spark):
    rows = [(k, f"https://h{k % 2}.example/{k}", page(k)) for k in range(24)] + [(100, None, None), (101, "x", ""), (None, "https://h0.example/z", page(3))]
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(24):
        text = "\n".join([f"Title {k}", *(f"Paragraph {j} of page {k} says café & tea." for j in range(1 + k % 4))])
        assert got[k] == (text, len(text))
    assert got[100] == got[101] == ("", 0) and got[None] == got[3]


def extracted(spark, htmls: list[str]) -> list[str]:
    rows = [(k, f"https://one.example/{k}", h) for k, h in enumerate(htmls)]
    return [r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_copies_are_no_evidence(spark):
    """A host of copies keeps their body; so does an article copied among other pages, and a caption that pages share."""
    body = "<html><body><article><h1>Title</h1><div class='body'>The whole text.</div></article></body></html>"
    assert extracted(spark, [body] * 5) == ["Title\nThe whole text."] * 5
    plain = "<html><body><div class='x'><h1>Title</h1><div class='body'>The whole text.</div></div></body></html>"
    others = [f"<html><body><div class='x'><h1>Other {k}</h1><p>Words of page {k}.</p></div></body></html>" for k in range(4)]
    assert extracted(spark, [plain] * 5 + others)[:5] == ["Title\nThe whole text."] * 5
    shown = [f"<html><body><article><p>Text {k}.</p><figcaption>By us</figcaption></article></body></html>" for k in range(4)]
    assert extracted(spark, shown) == [f"Text {k}.\nBy us" for k in range(4)]


def test_template_text_of_different_pages_goes(spark):
    htmls = [f"<html><body><div class='x'><div class='slogan'>Best news in town</div><p>Words of page {k}, a few more of them.</p></div></body></html>" for k in range(6)]
    assert extracted(spark, htmls) == [f"Words of page {k}, a few more of them." for k in range(6)]


def test_names_in_the_article_drop_nothing(spark):
    html = "<html><body><div class='cookie-notice'>Cookies!</div><div id='footer'>Us</div><article><h2 id='related-work'>Related work</h2><section id='social-reform'><p>Reform.</p></section><div class='market-share'>A third.</div><h2 id='copyright'>Copyright</h2><p>Law of <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object>a thing</object>.</p><div class='share-buttons'>Send</div></article></body></html>"
    assert extracted(spark, [html]) == ["Related work\nReform.\nA third.\nCopyright\nLaw of x=1 and a thing."]


def test_the_wrapper_tells_neutral_blocks_apart(spark):
    """Three nameless blocks on one path: only the host's wrapper says which of them is the article."""
    htmls = [f"<html><body><div><div>Our shop, our news, our friends, all that you see here every day and more</div><div><p>Words {k} of page {k}.</p><p>More of {k}.</p></div><div>Read on, write to us, and come back for what is new tomorrow</div></div></body></html>" for k in range(6)]
    want = [f"Words {k} of page {k}.\nMore of {k}." for k in range(6)]
    assert extracted(spark, htmls) == want
    # Without the host's other pages the blocks can't be told apart.
    assert extracted(spark, htmls[:1]) != want[:1]


def test_pages_of_one_host_differ_in_structure():
    """Whatever the order, the wrapper of some pages matches each of them: every text has a slot, texts of one role the same one."""
    htmls = [f"<body><div><ul><li>a</li>{'<li>b</li>' * (k % 3)}</ul></div><article><h1>T</h1>{'<p>x</p>' * (1 + k % 4)}{'<h2>s</h2><p>y</p>' * (k % 2)}{'<table><tr><td>1</td><td>2</td></tr></table>' * (k % 5 == 0)}</article>{'<div>note</div>' * (k % 3 == 1)}<div>end</div></body>" for k in range(30)]
    trees = [wrappers.parse(h) for h in htmls]
    for seed in range(5):
        wrapper, rest = None, [wrappers.shape(t) for t in random.Random(seed).sample(trees, len(trees))]
        for one in rest:
            wrapper = one if wrapper is None else wrappers.align(wrapper, one)
        w = wrappers.Wrapper(wrapper)
        slots = [w.texts(t) for t in trees]
        assert all(k >= 0 for page in slots for k, _ in page)
        assert len({k for page in slots for k, t in page if t == "x"}) == 1
        assert {k for page in slots for k, t in page if t in "xy"}.isdisjoint(k for page in slots for k, t in page if t in ("a", "b", "T"))
        assert w.n < 40


def test_markup_that_ends_early_drops_nothing(spark):
    html = "<html><body><article><p>a</p><svg/><p>b</p><button>send<p>c</p><svg><path d='x'/></svg><noscript>d</noscript><p>e<math><mi>f</mi></math></p><select><option>no</option></select><p>g</p></article></body></html>"
    assert extracted(spark, [html]) == ["a\nb\nsend\nc\nd\nef\ng"]


def test_awkward_pages(spark):
    """Nulls, repeated rows, clashing columns, a very long and a very deep page, an empty table; partitions don't matter."""
    long = "<html><body><article>" + "".join(f"<p>Part {k}</p><h2>H{k % 7}</h2>" for k in range(20_000)) + "</article></body></html>"
    deep = "<div>" * 5000 + "far down" + "</div>" * 5000
    rows = [(k, f"https://h.example/{k}", page(k)) for k in range(12)] + [(3, "https://h.example/3", page(3)), (None, None, None), (20, "https://h.example/l", long), (21, "https://d.example/", deep), (22, "https://e.example/", "<p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as wrapper", "'c' as content", "0 as text", "'s' as slot")
    out = wrappers.extract(df.repartition(1)).collect()
    key = lambda r: (str(r.page_id), r.text)
    assert sorted(out, key=key) == sorted(wrappers.extract(df.repartition(7)).collect(), key=key)
    by = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and by[None] == by[22] == "" and by[21] == "far down"
    assert by[20].split("\n") == [x for k in range(20_000) for x in (f"Part {k}", f"H{k % 7}")]
    assert all(by[k].split("\n")[0] == f"Title {k}" for k in range(12))
    assert wrappers.extract(df.where("false")).count() == 0


def plainly(html: str) -> str:
    """What stands in the page's article by the standard library's parser: blocks between tags that aren't inline."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        within, held, blocks = False, "", []

        def cut(self):
            if self.held.strip():
                self.blocks.append(" ".join(self.held.split()))
            self.held = ""

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.held += " "
            elif tag not in wrappers.INLINE:
                self.cut()
            self.within = self.within or tag == "article"

        def handle_endtag(self, tag):
            if tag not in wrappers.INLINE:
                self.cut()
            self.within = self.within and tag != "article"

        def handle_data(self, data):
            self.held += data if self.within else ""

    reader = Article()
    reader.blocks = []
    reader.feed(html or "")
    reader.cut()
    return "\n".join(reader.blocks)


def alone(html: str) -> str:
    """What a page's own structure gives, without its host's wrapper."""
    return wrappers.main_text(wrappers.parse(html), None, frozenset())


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><p>one</p>" + "<div>" * 120 + "<p>deep<p>deeper</p>" + "</div>" * 120 + "<p>after</p><h2>more</h2></article>", "one\ndeep\ndeeper\nafter\nmore"),
        ("<article><p>one</p>" + "<div>" * 120 + "<p>deep</article><p>out</p>", "one\ndeep"),
        ("<p title=don't>Hello world, it's me</p>", "Hello world, it's me"),
        ("<p data-x=a>b</p><p title = 'x>y' lang=\"a>b\" alt=it's>c</p><p title=\">d</p>", "b\nc\nd"),
        ("<article><header><h1>Title</h1></header><p>Body</p></article><header>Site</header>", "Title\nBody"),
        ("<div class=header>Site</div><article><div class=header>Title</div><p>Body</p><div class='notice'>Note.</div><div class='cookie-notice'>Cookies</div><div class='share-buttons'>Send</div></article>", "Title\nBody\nNote."),
        ("<main><header><h1>Title</h1></header><p>Body</p><div class='notice'>We moved</div></main>", "Title\nBody"),
    ],
)
def test_no_text_of_an_article_is_lost(spark, html, text):
    assert alone(html) == text
    assert extracted(spark, [html]) == [text]


def test_very_deep_pages_are_read_in_one_pass():
    deep = "<div>" * 200_000 + "<span>x</span>" + "</div>" * 200_000
    assert alone(f"<article>{deep}<p>after</p></article>") == "x\nafter"


def test_wrappers_tell_the_article_without_names(spark):
    """With no element named article, nav, footer or ad the wrappers give the same texts; pages by themselves don't."""
    import re

    html = {r.page_id: (r.url, r.html) for r in table(spark, "/root/testdata/sf0.1", "pages").collect()}
    rows = [(k, u, re.sub(r"(</?)(?:article|nav|footer)\b", r"\1div", h).replace(' class="ad"', "")) for k, (u, h) in html.items()]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {k: plainly(h) for k, (_, h) in html.items()}
    assert got == want
    assert sum(alone(h) != want[k] for k, _, h in rows) > 50


def test_extraction_of_the_pages_table(spark):
    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    out = wrappers.op8_extraction(spark, sf).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in out} == {k: (plainly(h), len(plainly(h))) for k, h in html.items()} and len(out) == len(html)


# --- awkward tables --------------------------------------------------------------------------------------------

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 0, 1), (5, 0, 0), (77, 1, 1)], LABELS)
    items = spark.createDataFrame([(1, "the quick brown fox jumps over"), (1, "the quick brown fox jumps over"), (None, None), (3, "")], ITEMS)
    return {
        "classify": lambda d: classifier.classify(d, classifier.fit(d, labels)),
        "rules": lambda d: rules.apply_rules(d, labels),
        "licenses": licenses.scan_licenses,
        "lines": linededup.remove_repeated_lines,
        "bytes": suffixes.remove_repeated_bytes,
        "near": simhash.near_duplicates,
        "shard": sharding.shard,
        "packed": lambda d: packing.packed_documents(d).where("piece = 0"),
        "matches": lambda d: decontaminate.benchmark_matches(d, items),
    }


ROWWISE = ["classify", "rules", "licenses", "lines", "bytes", "near", "shard", "packed"]


LONG = " ".join(f"word{k % 977}" for k in range(60_000))
FOX = "the quick brown fox jumps over the lazy dog again and again"


def first_of(out, doc_id):
    return [r for r in out if r.doc_id == doc_id]


def check_awkward(name, out):
    """The defined result of every odd row, by operator."""
    size = lambda t: len((t or "").encode())
    if name == "classify":
        assert all(0 <= r.quality <= 1 and 0 <= r.clean <= 1 and r.kept == (min(r.quality, r.clean) >= 0.5) for r in out)
        assert first_of(out, 2)[0].quality == first_of(out, 3)[0].quality
    elif name == "rules":
        assert {(r.doc_id, r.n_words) for r in out} == {(1, 12), (1, 6), (None, 0), (None, 4), (2, 0), (3, 0), (4, 0), (5, 60_000), (6, 7)}
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in out)
        assert first_of(out, 5)[0].n_repeat_words == 60_000
    elif name == "licenses":
        assert {(r.doc_id, r.n_words) for r in out} == {(1, 12), (1, 6), (None, 0), (None, 4), (2, 0), (3, 0), (4, 0), (5, 60_000), (6, 7)}
        assert all((r.n_base, r.first_word, r.labels, r.score) == (0, None, "", 0.0) for r in out)
    elif name == "lines":
        assert {(r.doc_id, r.text) for r in out if r.doc_id in (1, 2, 3, 4)} == {(1, FOX), (1, "another text under the same id"), (2, ""), (3, None), (4, " \n\t\n ")}
        assert all((r._removed, r._windows) == (0, 0) for r in out)
        # Other columns pass through, those that the operator might use itself too.
        assert all((r.id, r.th, r.kept, r.size, r.gram, r.runs, r.shard, r["__h"]) == (1, "x", "y", 0, "z", "r", 0, "h") for r in out)
    elif name == "bytes":
        assert {(r.doc_id, r.n_bytes, r.n_removed) for r in out if r.doc_id != 5} == {(1, size(FOX), 0), (1, 30, 0), (None, 0, 0), (None, 18, 0), (2, 0, 0), (3, 0, 0), (4, 5, 0), (6, size("naïve café — déjà vu 你好 世界"), 0)}
        (long,) = first_of(out, 5)
        period = size(" ".join(f"word{k}" for k in range(977)) + " ")
        assert (long.n_bytes, long.n_removed, long.n_spans) == (size(LONG), size(LONG) - period, 1)
    elif name == "near":
        zero = {r.fingerprint for r in out if r.doc_id in (2, 3, 4)}
        assert zero == {"0" * 16} and {r.component_id for r in out if r.fingerprint == "0" * 16} == {2}
        assert {r.component_id for r in out if r.doc_id == 1} == {1}
    elif name == "shard":
        assert sorted(r.size for r in out) == sorted(size(t) + 16 for t in (FOX, FOX, "another text under the same id", None, "text without an id", "", None, " \n\t\n ", LONG, "naïve café — déjà vu 你好 世界"))
        assert all(0 <= r.shard < 40 for r in out)
    elif name == "packed":
        assert {r.length for r in out if r.doc_id in (2, 3)} == {1} and all(r.start == 0 for r in out)


@pytest.mark.parametrize("name", [*ROWWISE, "matches"])
def test_awkward_table(spark, awkward, name):
    out = operators(spark)[name](awkward).collect()
    if name in ROWWISE:
        assert len(out) == awkward.count()
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in awkward.collect())
        check_awkward(name, out)
    else:
        assert [(r.doc_id, r.item_id, r.n_edits, r.start, r.length) for r in out] == [(1, 1, 0, 0, 30), (1, 1, 0, 0, 30)]


@pytest.mark.parametrize("stage", ["line_dedup", "simhash_near_dedup", "op6"])
def test_clashing_columns_pass_through(spark, awkward, stage):
    """Columns named as the operators' own are kept, in operators that keep all columns."""
    from jobloom.llm import neardup

    odd = awkward.selectExpr("*", "1 as __id", "2 as __ks", "3 as __r", "4 as __th", "'b' as `best.id`")
    f = {"line_dedup": linededup.remove_repeated_lines, "simhash_near_dedup": neardup.one_of_each_group, "op6": simhash.one_of_each_group}[stage]
    out = f(odd)
    assert set(odd.columns) <= set(out.columns)
    rows = out.collect()
    assert rows and all((r["__id"], r["__ks"], r["__r"], r["__th"], r["__h"], r["best.id"], r.id, r.th) == (1, 2, 3, 4, "h", "b", 1, "x") for r in rows)
    if stage != "line_dedup":
        # Repeated rows leave one, texts without words are one group.
        assert sorted(r.text or "" for r in rows) == sorted([FOX, "another text under the same id", "", "text without an id", LONG, "naïve café — déjà vu 你好 世界"])


@pytest.mark.parametrize("name", [*ROWWISE, "matches"])
def test_empty_table(spark, awkward, name):
    assert operators(spark)[name](awkward.where("false")).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows(spark, sf, awkward, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, awkward, sf)
    if stage == "best_fit_packing":
        assert out.where("piece = 0").count() == awkward.count()
        return
    assert out.columns == corpus_pipeline.COLUMNS
    given, kept = ([(r.doc_id, r.text) for r in d.collect()] for d in (awkward, out))
    left = Counter(given)
    left.subtract(kept)
    assert min(left.values()) >= 0
    if stage == "simhash_near_dedup":
        assert sorted(t or "" for _, t in kept) == sorted([FOX, "another text under the same id", "", "text without an id", LONG, "naïve café — déjà vu 你好 世界"])
    elif stage == "line_dedup":
        assert sum(left.values()) == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, sf, awkward, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, awkward.where("false"), sf)
    assert out.count() == 0
    if stage != "best_fit_packing":
        assert out.columns == corpus_pipeline.COLUMNS


def test_pipeline_runs(spark, sf):
    """Every stage takes what the last one kept: the result's documents are those of the stages applied one by one."""
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    d = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf)
    assert ids == {r.doc_id for r in d.select("doc_id").collect()}
