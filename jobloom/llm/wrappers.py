"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import difflib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import cut, small_batches, table

# Elements by their part in a page.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr object math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded mfenced semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPEN_ENDED = frozenset("p li dt dd tr td th thead tbody tfoot option".split())
ASIDE = frozenset("head nav header footer aside form menu dialog title".split())
#: Containers whose class, role or (outside an article) id may mark what isn't the article.
CONTAINER = frozenset("div section ul ol dl table".split())
_MARK = r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|side-?bar|menu|nav\w*|footer|header|masthead|cookies?|consent|notices?|alert|popup|modal|share|social|comments?|disqus|respond|related|recommend\w*|subscribe|newsletter|signup|login|breadcrumbs?|widget|toolbar|pagination|copyright)"
_PART = r"(?:site|page|top|bottom|left|right|primary|secondary|bar|box|list|links?|items?|posts|articles|stories|buttons?|icons?|wrap|wrapper|container|area|block|inner|outer|\d+)"
#: Whole class names of such words; "market-share" isn't one.
MARKED = re.compile(rf"@?(?:{_PART}[-_])*{_MARK}(?:[-_]?(?:{_MARK}|{_PART}))*", re.I)
#: What heads or notes an article when it stands within one: names of such words alone mark nothing there.
_OWN = r"(?:header|masthead|notices?|alert)"
OWN = re.compile(rf"@?(?:{_PART}[-_])*{_OWN}(?:[-_]?(?:{_OWN}|{_PART}))*", re.I)
MAIN = re.compile(r"(?:^|[-_ #@])(?:article|content|post|entry|story|main)(?:$|[-_ \d])", re.I)
#: A quote counts as one only where a value begins; within an unquoted value it is a letter.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?|[^=>])*+)>""", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content isn't text of the page; without an end tag the first two run to the page's end, the others hold nothing.
_SKIPPED = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "template", "svg", "iframe", "textarea", "select", "button")}
#: What stands before a name in a label, by the attribute it is from.
_SIGN = {"class": "", "id": "#", "role": "@"}
#: Elements whose text is the article's even if all pages of a host agree in it.
TEXTUAL = frozenset("article main h1 h2 h3 h4 h5 h6 p blockquote pre li td th dd dt".split())
#: Elements that a descent to the article goes through where the markup doesn't name it.
HOLDERS = frozenset("html body div section table tbody tr td center".split())
#: Text in elements deeper than this is that of the one around them; their ends are still told from those of outer ones.
DEPTH = 100
#: Distinct structures of a host are folded in so many parts, and the parts' wrappers then into one.
PARTS = 16
#: Different pages with the same text in a slot, and their share of the host's different pages, from which on it is the host's, not the article's.
SAME, SHARE = 3, 0.5
#: Wrappers are sent to all executors up to this size together; beyond it pages and wrappers are joined by host.
SMALL = 32 << 20

# A part of a wrapper is [label, flags, parts]: an element; text, with label TEXT; or a group with label GROUP of which any part may stand, any number of times.
TEXT, GROUP = "#", "()"
OPTIONAL, REPEATED = 1, 2


def parse(html: str) -> list:
    """The page's tree: an element is (label, children), text between elements a string, white space as one space."""
    top: list = []
    stack: list[tuple[str, str, list]] = [("", "", top)]
    #: Names of the open elements below DEPTH, and how many there are of each.
    deeper: list[str] = []
    names: Counter[str] = Counter()
    held: list[str] = []
    unclosed: set[str] = set()

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                stack[-1][2].append(text)

    at = 0
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in _SKIPPED:
            if m[1] or m[3].endswith("/") or name in unclosed:
                continue
            if end := _SKIPPED[name].search(html, at):
                at = end.end()
            elif name in ("script", "style"):
                at = len(html)
            else:
                unclosed.add(name)
            continue
        if name in INLINE:
            if name == "br":
                held.append(" ")
            continue
        flush()
        if m[1]:
            if names[name]:
                while (last := deeper.pop()) != name:
                    names[last] -= 1
                names[name] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    deeper.clear()
                    names.clear()
                    break
            continue
        ends = lambda last: last == "p" or last == name and name in OPEN_ENDED
        while deeper and ends(deeper[-1]):
            names[deeper.pop()] -= 1
        while not deeper and len(stack) > 1 and ends(stack[-1][0]):
            stack.pop()
        if name in VOID:
            continue
        if deeper or len(stack) > DEPTH:
            deeper.append(name)
            names[name] += 1
            continue
        marks = " ".join(_SIGN[kind] + x for g in _NAMED.findall(m[3]) if (kind := g[0].lower()) != "id" or name in CONTAINER for x in "".join(g[1:]).split()) if m[3] else ""
        element = (f"{name}.{re.sub(r'\d+', '0', marks)}" if marks else name, [])
        stack[-1][2].append(element)
        stack.append((name, *element))
    if at < len(html):
        held.append(html[at:])
    flush()
    return top


def name_of(label: str) -> str:
    return label.partition(".")[0]


def folded(parts: list, only=None) -> list:
    """`parts` with what recurs as one: neighbours of one label as a repeated part, others from the first to the last as a repeated group."""
    first: dict[str, int] = {}
    spans: list[list[int]] = []
    for k, p in enumerate(parts):
        for label in [q[0] for q in p[2]] if p[0] == GROUP else [p[0]]:
            if only is None or only(label):
                at = first.setdefault(label, k)
                if at < k:
                    while spans and spans[-1][1] >= at:
                        at = min(at, spans.pop()[0])
                    spans.append([at, k])
    out, done = [], 0
    for a, b in spans:
        out += parts[done:a]
        members: dict[str, list] = {}
        for p in parts[a : b + 1]:
            for q in p[2] if p[0] == GROUP else [p]:
                members[q[0]] = merged(members[q[0]], q) if q[0] in members else q
        if len(members) == 1:
            (p,) = members.values()
            out.append([p[0], p[1] | REPEATED, p[2]])
        else:
            out.append([GROUP, REPEATED, [members[x] for x in sorted(members)]])
        done = b + 1
    return out + parts[done:]


def shape(tree: list) -> list:
    """A page's own wrapper: its elements in order; paragraphs, items and the like that recur are repeated already."""
    parts = [[TEXT, 0, []] if isinstance(x, str) else [x[0], 0, shape(x[1])] for x in tree]
    return folded(parts, lambda label: name_of(label) not in HOLDERS or name_of(label) in OPEN_ENDED)


def merged(a: list, b: list) -> list:
    """The part that matches what `a` or `b`, of one label, matches."""
    if a[0] == GROUP:
        members = {p[0]: p for p in a[2]}
        for p in b[2]:
            members[p[0]] = merged(members[p[0]], p) if p[0] in members else p
        return [GROUP, a[1] | b[1], [members[x] for x in sorted(members)]]
    return [a[0], a[1] | b[1], align(a[2], b[2])]


def align(a: list, b: list) -> list:
    """The wrapper that matches what `a` or `b` matches. Where the two part, what recurs becomes a repeated part or group, then what only one has optional."""
    labels = lambda w: [p[0] for p in w]
    if labels(a) != labels(b):
        a, b = folded(a), folded(b)
    if labels(a) == labels(b):
        return [merged(x, y) for x, y in zip(a, b)]
    out = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, labels(a), labels(b), autojunk=False).get_opcodes():
        if kind == "equal":
            out += [merged(x, y) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [[p[0], p[1] | OPTIONAL, p[2]] for p in (*a[i:j], *b[k:m])]
    return folded(out)


class Wrapper:
    """A wrapper with its parts numbered in order."""

    def __init__(self, parts: list):
        self.parts, self.n = self._numbered(parts, 0)
        #: Of each slot: the elements around it, their labels, whether it may stand more than once.
        self.slots: dict[int, tuple[list[int], list[str], bool]] = {}
        self.labels: dict[int, str] = {}
        self._walk(self.parts, [], [], False)
        #: Slots in elements that are no article by name.
        self.frame = {k for k, (_, names, _) in self.slots.items() if is_aside(names)}

    def _walk(self, parts: list, above: list[int], names: list[str], repeated: bool) -> None:
        for label, flags, inner, k in parts:
            again = repeated or bool(flags & REPEATED)
            if label == TEXT:
                self.slots[k] = above, names, again
            elif label == GROUP:
                self._walk(inner, above, names, again)
            else:
                self.labels[k] = label
                self._walk(inner, [*above, k], [*names, label], again)

    def _numbered(self, parts: list, n: int) -> tuple[list, int]:
        out = []
        for label, flags, inner in parts:
            k = n
            inner, n = self._numbered(inner, n + 1)
            out.append((label, flags, inner, k))
        return out, n

    def texts(self, tree: list) -> list[tuple[int, str]]:
        """(slot, text) of a page's texts in page order: each goes to the slot it meets where the page is matched against the wrapper; -1 for none."""
        out: list[tuple[int, str]] = []

        def walk(children: list, parts: list) -> None:
            at = 0
            for x in children:
                label = TEXT if isinstance(x, str) else x[0]
                met = None
                for k in (*range(at, len(parts)), *range(at)):
                    p = parts[k]
                    if p[0] == GROUP:
                        met = next((q for q in p[2] if q[0] == label), None)
                    elif p[0] == label:
                        met = p
                    if met:
                        at = k if p[0] == GROUP or p[1] & REPEATED else k + 1
                        break
                if isinstance(x, str):
                    out.append((met[3] if met else -1, x))
                else:
                    walk(x[1], met[2] if met else [])

        walk(tree, self.parts)
        return out

    def content(self, seen: dict[int, tuple[int, int, bool]], different: int) -> set[int]:
        """The slots that hold the article, from what is `seen` in each: (different pages, letters, whether all have one text).

        Slots with one text on SAME pages and a SHARE of the `different` ones are the template's, those in elements that are
        no article by name the page's frame. The region is the element named as the article, else the deepest that holds most
        of the letters of the other slots. Its slots are the article's, but for the template's; none of these is in an
        element that the markup names as the article.
        """
        slots, frame = self.slots, self.frame
        least = max(SAME, SHARE * different)
        fixed = {k for k, (_, _, again) in slots.items() if not again and k in seen and seen[k][2] and seen[k][0] >= least}

        def under(but: set[int]) -> dict[int, int]:
            out: dict[int, int] = {}
            for k, (above, _, _) in slots.items():
                if k not in but and k in seen:
                    for x in above:
                        out[x] = out.get(x, 0) + seen[k][1]
            return out

        region, named = region_of(self.parts, self.labels, under(frame), under(frame | fixed))
        inside = {k for k, (above, _, _) in slots.items() if (region is None or region in above) and k not in frame}
        if not named:
            rest = {k for k in inside if k not in fixed or slots[k][1] and name_of(slots[k][1][-1]) in TEXTUAL}
            inside = rest or inside
        return inside


def is_aside(path: list[str]) -> bool:
    """Whether an element on the path holds what isn't the article."""
    within = article = False
    for x in path:
        name, _, marks = x.partition(".")
        # The article's own header is part of it.
        if name in ASIDE and not (name == "header" and within):
            return True
        if name in CONTAINER:
            for mark in marks.split():
                if article and OWN.fullmatch(mark):
                    continue
                # An id within the article is a place to link to, "related" or "copyright" as well.
                if MARKED.fullmatch(mark[1:] if mark[0] == "#" and name != "section" and not within else mark):
                    return True
        article = article or name == "article"
        within = article or within or name == "main"
    return False


def region_of(parts: list, labels: dict[int, str], every: dict[int, int], free: dict[int, int]) -> tuple[int | None, bool]:
    """(the part that holds the article, whether its markup says so). `every` and `free` have the letters under each element, without and with the template's left out."""
    marks = lambda k: labels[k].partition(".")[2]
    for wanted in (lambda k: name_of(labels[k]) == "article", lambda k: name_of(labels[k]) == "main" or not {"main", "#main", "@main"}.isdisjoint(marks(k).split()), lambda k: bool(MAIN.search(marks(k)))):
        if found := [k for k in every if wanted(k)]:
            return max(found, key=lambda k: (every[k], -k)), True
    best, inner = None, parts
    while True:
        whole = sum(free.get(k, 0) for label, _, below, k in flat(inner)) if best is None else free.get(best, 0)
        deeper = [(free.get(k, 0), -k, below) for label, _, below, k in flat(inner) if name_of(label) in HOLDERS and free.get(k, 0) >= 0.6 * whole > 0]
        if not deeper:
            return best, False
        _, k, inner = max(deeper, key=lambda x: x[:2])
        best = -k


def flat(parts: list) -> list:
    """The parts, those of groups in their stead."""
    return [q for p in parts for q in (p[2] if p[0] == GROUP else [p])]


def main_text(tree: list, wrapper: Wrapper | None, content: frozenset[int]) -> str:
    """The texts of the page's content slots, joined by line ends; if it has none, those that its own structure gives."""
    if wrapper is not None and (found := [t for k, t in wrapper.texts(tree) if k in content]):
        return "\n".join(found)
    own = Wrapper(shape(tree))
    texts = own.texts(tree)
    seen: dict[int, tuple[int, int, bool]] = {}
    for k, t in texts:
        seen[k] = (1, seen.get(k, (1, 0, False))[1] + len(t), False)
    content = own.content(seen, 1)
    return "\n".join(t for k, t in texts if k in content)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def _rows(pages: DataFrame, url_col: str, html_col: str, *others: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return pages.select(*others, F.lower(F.regexp_extract(text(url_col), HOST, 1)).alias("host"), text(html_col).alias("html"))


def _with(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` with their host's row of `known`, which goes to all executors if it is small; html isn't shuffled then."""
    size = known.agg(F.sum(sum(F.octet_length(c) for c in known.columns if c != "host"))).first()[0] or 0
    return rows.join(F.broadcast(known) if size <= SMALL else known, "host", "left")


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): for each host the wrapper of all its pages as JSON.

    Every page counts. Pages' own structures, in which what recurs is one already, are made distinct before the shuffle and aligned
    one by one in order, in PARTS parts a host, whose wrappers are aligned in turn: a host with any share of the pages
    neither fills a task nor is sampled, and the pages' order and partitions don't matter. A wrapper has each label at most once beside
    another where pages differ, so that it doesn't grow with the pages.
    """

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, str]] = set()
        for batch in small_batches(batches):
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.add((host, json.dumps(shape(parse(html)), ensure_ascii=False)))
            if len(found) > 10_000:
                yield emit(found)
                found = set()
        yield emit(found)

    def emit(found: set) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*found)) or [[], []])], ["host", "what"])

    def fold(keys: list[str]):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, wrapper = None, []
            make = lambda: pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([json.dumps(wrapper, ensure_ascii=False)])], ["host", "wrapper"])
            for batch in batches:
                for *key, what in zip(*(batch.column(k).to_pylist() for k in (*keys, "what"))):
                    if key != last:
                        if last is not None:
                            yield make()
                        last, wrapper = key, json.loads(what)
                    else:
                        wrapper = align(wrapper, json.loads(what))
            if last is not None:
                yield make()

        return of

    found = _rows(pages, url_col, html_col).mapInArrow(shapes, "host string, what string").distinct().withColumn("part", F.pmod(F.xxhash64("what"), F.lit(PARTS)))
    parts = found.repartition("host", "part").sortWithinPartitions("host", "part", F.length("what"), "what").mapInArrow(fold(["host", "part"]), "host string, wrapper string")
    return parts.withColumnRenamed("wrapper", "what").repartition("host").sortWithinPartitions("host", F.length("what"), "what").mapInArrow(fold(["host"]), "host string, wrapper string")


def content_slots(pages: DataFrame, wrappers: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, content): the slots of each host's wrapper that hold the article.

    All pages are matched against their host's wrapper; each slot's different pages, letters and texts' hashes are combined before the
    shuffle. Pages with the same texts outside the frame are one page, whatever stands around it.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in small_batches(batches):
            out = []
            for host, html, w in zip(*(batch.column(k).to_pylist() for k in ("host", "html", "wrapper"))):
                if host not in known:
                    known = {} if len(known) > 1000 else known
                    known[host] = Wrapper(json.loads(w))
                own: dict[int, list[str]] = {}
                for k, text in known[host].texts(parse(html)):
                    own.setdefault(k, []).append(text)
                page = xxhash.xxh64_intdigest("\n".join(t for k in sorted(own) if k not in known[host].frame for t in own[k]).encode("utf-8", "surrogatepass")) >> 1
                out.append((host, -2, page, 0, 0))
                out += [(host, k, page, sum(map(len, ts)), zlib.crc32("\n".join(ts).encode("utf-8", "surrogatepass"))) for k, ts in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["host", "slot", "page", "size", "h"])

    rows = _with(_rows(pages, url_col, html_col), wrappers).select("host", "html", "wrapper").mapInArrow(seen, "host string, slot int, page long, size long, h long")
    each = rows.groupBy("host", "slot", "page").agg(F.max("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    slots = each.groupBy("host", "slot").agg(F.count("*").alias("n"), F.sum("size").alias("size"), (F.min("lo") == F.max("hi")).alias("one"))
    # A row for each slot of a wrapper, not for its pages.
    stats = slots.groupBy("host").agg(F.collect_list(F.struct("slot", "n", "size", "one")).alias("slots"))

    @F.pandas_udf("string")
    def decide(wrapper: pd.Series, stats: pd.Series) -> pd.Series:
        out = []
        for w, own in zip(wrapper, stats):
            found = {s["slot"]: (s["n"], s["size"], s["one"]) for s in own}
            different = found.pop(-2, (0, 0, False))[0]
            out.append(json.dumps(sorted(Wrapper(json.loads(w)).content(found, different))))
        return pd.Series(out)

    return wrappers.join(stats, "host").select("host", "wrapper", decide("wrapper", "slots").alias("content"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of `pages`: what stands in the content slots of its host's wrapper.

    Blocks stand in page order, one to a line, references decoded, white space as one space. Null and empty html give
    ''. Pages without a host that can be read share one wrapper. A page without text in its host's content slots is read by its own
    structure. Repeated rows and null ids are answered row by row; other columns are ignored; an empty table gives an
    empty result.
    """
    known = cut(content_slots(pages, cut(infer_wrappers(pages, url_col, html_col)), url_col, html_col))
    rows = _rows(pages, url_col, html_col, F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, tuple[Wrapper, frozenset[int]]] = {}
        for batch in small_batches(batches):
            texts = []
            for host, html, w, c in zip(*(batch.column(k).to_pylist() for k in ("host", "html", "wrapper", "content"))):
                if host not in ready:
                    ready = {} if len(ready) > 1000 else ready
                    ready[host] = Wrapper(json.loads(w or "[]")), frozenset(json.loads(c or "[]"))
                texts.append(main_text(parse(html), *ready[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return _with(rows, known).select("page_id", "url", "host", "html", "wrapper", "content").mapInArrow(of, "page_id long, url string, text string, n_chars long")


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
