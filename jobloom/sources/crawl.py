"""Spark data sources over what was fetched: `postings` reads stored pages, `search_pages` streams stored answers of a search."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from math import ceil
from urllib.parse import urlsplit

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from jobloom.sources.postings_json import best_of_page
from jobloom.sources.selectors import Selector, read_texts

SEEN, JOB, SKIPPED, ERROR = "seen", "job", "skipped", "error"
#: One row an event: a page that is listed is seen, and gives a job, or says why it was skipped or what went wrong.
EVENTS = "source string, kind string, url string, external_id string, posting string, salary_text string, skills array<string>, message string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:", path, re.I):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), path


def parquet_files(path: str) -> list[str]:
    """The Parquet files below a path, in the order of their names."""
    fs, at = opened(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [at]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(x.path for x in found if x.type == pafs.FileType.File and x.path.endswith(".parquet") and not x.base_name.startswith(("_", ".")))


def id_of(url: str, pattern: str | None) -> str:
    """A posting's id: what the pattern finds in its URL, else the path; without a pattern the last part of the path."""
    path = urlsplit(url).path
    if not pattern:
        return next((x for x in reversed(path.split("/")) if x), url)
    m = re.search(pattern, url)
    return path if not m else m[1] if m.re.groups and m[1] is not None else m[0]


def write_pages(pages: DataFrame, path: str, order: str) -> None:
    """Pages (source, url, status, html) as `postings` reads them: clustered by source, in the order of the column `order` within it.

    A source may fill many files.
    """
    pages.repartitionByRange("source", order).sortWithinPartitions("source", order).select("source", "url", "status", "html").write.parquet(path)


@dataclass
class PagePart(InputPartition):
    """A row group of a file, and how many pages of its sources may still be read in full when it begins; null: all."""

    file: str
    group: int
    left: dict[str, int] | None


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        number = options.get("maxDetailPages")
        self.budget = None if number is None else int(number)
        self.exclude = [re.compile(x) for x in json.loads(options.get("excludePatterns", "[]"))]
        self.id_pattern = options.get("externalIdPattern")
        self.salary, self.skills = (options.get(k) for k in ("salarySelector", "skillsSelector"))
        for x in filter(None, (self.salary, self.skills)):
            Selector(x)
        self.sources: set[str] | None = None
        self.kinds: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Sources prune row groups by their statistics; without jobs, skips or errors no page is read."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("source",), ("kind",)):
                yield f
            elif f.attribute == ("source",):
                self.sources = values if self.sources is None else self.sources & values
            else:
                self.kinds = values if self.kinds is None else self.kinds & values

    def partitions(self) -> list[PagePart]:
        """A part for each row group that may hold a wanted source; footers, and URLs until a source's budget is used up, are all that is read here."""
        fs, parts, left = opened(self.path)[0], [], {}
        for file in parquet_files(self.path):
            with fs.open_input_file(file) as f:
                data = pq.ParquetFile(f)
                at = data.schema_arrow.get_field_index("source")
                for g in range(data.num_row_groups):
                    stats = data.metadata.row_group(g).column(at).statistics
                    only = stats.min if stats is not None and stats.has_min_max and stats.min == stats.max and not stats.null_count else None
                    if self.sources is not None and stats is not None and stats.has_min_max and not any(stats.min <= s <= stats.max for s in self.sources if s is not None):
                        continue
                    parts.append(PagePart(file, g, None if self.budget is None else dict(left)))
                    if self.budget is None or only is not None and left.get(only, self.budget) <= 0:
                        continue
                    for source, url in zip(*(c.to_pylist() for c in data.read_row_group(g, ["source", "url"]).columns)):
                        if not self._excluded(url):
                            left[source] = left.get(source, self.budget) - 1
        return parts

    def _excluded(self, url: str | None) -> bool:
        return url is None or any(x.search(url) for x in self.exclude)

    def read(self, part: PagePart) -> Iterator[tuple]:
        fs = opened(self.path)[0]
        wanted = lambda kind: self.kinds is None or kind in self.kinds
        whole = any(map(wanted, (JOB, SKIPPED, ERROR)))
        selectors = [x and Selector(x) for x in (self.salary, self.skills)]
        left = None if part.left is None else dict(part.left)
        with fs.open_input_file(part.file) as f:
            batches = pq.ParquetFile(f).iter_batches(64, [part.group], ["source", "url", *(["status", "html"] if whole else [])])
            for batch in batches:
                for page in batch.to_pylist():
                    source, url = page["source"], page["url"]
                    if self.sources is not None and source not in self.sources or url is None:
                        continue
                    if self._excluded(url):
                        if wanted(SKIPPED):
                            yield source, SKIPPED, url, None, None, None, None, "excluded"
                        continue
                    own = id_of(url, self.id_pattern)
                    if wanted(SEEN):
                        yield source, SEEN, url, own, None, None, None, None
                    if left is not None:
                        left[source] = left.get(source, self.budget) - 1
                        if left[source] < 0:
                            continue
                    if whole:
                        event = self._told(page, own, selectors)
                        if wanted(event[1]):
                            yield event

    def _told(self, page: dict, own: str, selectors: list) -> tuple:
        source, url, html = page["source"], page["url"], page["html"]
        if page["status"] != 200 or not html:
            return source, ERROR, url, own, None, None, None, f"HTTP {page['status']}"
        posting = best_of_page(html)
        if posting is None:
            return source, SKIPPED, url, own, None, None, None, "no posting"
        pay, skills = read_texts(html, selectors) if any(selectors) else ([], [])
        return source, JOB, url, own, json.dumps(posting, ensure_ascii=False), (pay[0].strip() or None) if pay else None, [x.strip() for x in skills if x.strip()] or None, None


class PostingPages(DataSource):
    """`spark.read.format("postings").option("path", ...)`: EVENTS of stored pages (source, url, status, html), see `write_pages`.

    Options: maxDetailPages, of each source, beyond which pages are only seen; excludePatterns, a JSON list; externalIdPattern;
    salarySelector and skillsSelector. Filters on source and kind are pushed down. Pages without a URL give
    nothing. The path is one that Python can open on every machine.
    """

    @classmethod
    def name(cls) -> str:
        return "postings"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


#: Answers of a search as they are stored; body: JSON with data, a list of records, and meta.nbPages.
ANSWERS = "query string, page int, status int, body string"
FOUND = "kind string, external_id string, url string, record string, message string, query string, page int"


@dataclass
class Step(InputPartition):
    """A page of a query, and what its records give: (place, kind)."""

    query: str
    page: int
    file: str
    group: int
    row: int
    events: list[tuple[int, str]] = field(default_factory=list)
    error: str | None = None


def when(text: object) -> datetime | None:
    """A date of a record, without its zone."""
    try:
        return datetime.fromisoformat(str(text)[:19])
    except ValueError:
        return None


class SearchReader(DataSourceStreamReader):
    """Offsets are the next (query, page); a batch is the pages between two of them, as far as answers are stored.

    What a page gives depends on those before it, so the steps are found in order from the first page on, and again after a
    restart: from stored answers they are the same each time. They wait at the first answer that isn't stored yet, so that offsets only
    grow, and end with the budget, which bounds what the driver reads and holds.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.queries = [q for q in (x.strip() for x in json.loads(options.get("queries", "[]"))) if q] or [""]
        self.most = int(options["maxJobs"])
        self.share = max(1, ceil(self.most / len(self.queries)))
        self.since = when(options["since"]) if options.get("since") else None
        self.known: set | None = None
        self.steps: list[tuple[int, Step]] = []

    def _answers(self) -> dict[tuple[str, int], tuple[str, int, int]]:
        """Where each answer is: a line a page."""
        fs, out = opened(self.path)[0], {}
        for file in parquet_files(self.path):
            with fs.open_input_file(file) as f:
                data = pq.ParquetFile(f)
                for g in range(data.num_row_groups):
                    for row, (q, p) in enumerate(zip(*(c.to_pylist() for c in data.read_row_group(g, ["query", "page"]).columns))):
                        out.setdefault((q or "", p), (file, g, row))
        return out

    def _answer(self, at: tuple[str, int, int]) -> dict:
        file, group, row = at
        with opened(self.path)[0].open_input_file(file) as f:
            return pq.ParquetFile(f).read_row_group(group, ["status", "body"]).slice(row, 1).to_pylist()[0]

    def _plan(self, answers: dict[tuple[str, int], tuple[str, int, int]]) -> list[tuple[int, Step]]:
        ids, steps, fetched = set(), [], 0
        for k, query in enumerate(self.queries):
            taken, page, stop = 0, 0, False
            while not stop and fetched < self.most and taken < self.share:
                at = answers.get((query, page))
                if at is None:
                    return steps
                answer = self._answer(at)
                if answer["status"] != 200:
                    # One query that fails doesn't end the others.
                    steps.append((k, Step(query, page, *at, error=f"HTTP {answer['status']}")))
                    break
                body = json.loads(answer["body"])
                records, step = body.get("data") or [], Step(query, page, *at)
                if not records:
                    break
                for i, r in enumerate(records):
                    if fetched >= self.most or taken >= self.share:
                        stop = True
                        break
                    own = str(r["jobId"])
                    if own in ids:
                        continue
                    ids.add(own)
                    step.events.append((i, SEEN))
                    updated = when(r.get("lastUpdatedOn") or r.get("approvedOn"))
                    if self.since and updated and updated < self.since:
                        if not query:  # newest first: all that follows is older
                            stop = True
                            break
                        step.events.append((i, SKIPPED))
                        continue
                    step.events.append((i, JOB))
                    taken, fetched = taken + 1, fetched + 1
                steps.append((k, step))
                page += 1
                total = (body.get("meta") or {}).get("nbPages") or 0
                stop = stop or 0 < total <= page
        return steps

    def _ready(self) -> None:
        answers = self._answers()
        if self.known != set(answers):
            self.steps, self.known = self._plan(answers), set(answers)

    def _index(self, offset: dict) -> int:
        here = (offset["query"], offset["page"])
        return sum((k, s.page) < here for k, s in self.steps)

    def initialOffset(self) -> dict:
        return {"query": 0, "page": 0}

    def latestOffset(self) -> dict:
        self._ready()
        return {"query": self.steps[-1][0], "page": self.steps[-1][1].page + 1} if self.steps else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Step]:
        self._ready()
        return [s for _, s in self.steps[self._index(start) : self._index(end)]]

    def read(self, step: Step) -> Iterator[tuple]:
        if step.error:
            yield ERROR, None, None, None, step.error, step.query, step.page
            return
        records = json.loads(self._answer((step.file, step.group, step.row))["body"])["data"]
        for i, kind in step.events:
            r = records[i]
            yield kind, str(r["jobId"]), r.get("jobUrl"), json.dumps(r, ensure_ascii=False) if kind == JOB else None, "older than the last run" if kind == SKIPPED else None, step.query, step.page


class SearchPages(DataSource):
    """`spark.readStream.format("search_pages").option("path", ...)`: FOUND of stored ANSWERS, query by query and page by page.

    Options: queries, a JSON list (none: one search for all); maxJobs, shared evenly among them; since, a date. A record is taken
    from the first query that finds it. Records older than `since` are skipped, and end a search for all, which has the newest first. An
    answer that failed is an error and ends its query; one that isn't stored yet is waited for.
    """

    @classmethod
    def name(cls) -> str:
        return "search_pages"

    def schema(self) -> str:
        return FOUND

    def streamReader(self, schema) -> SearchReader:
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and turns on the pushing of filters, which `postings` needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PostingPages, SearchPages):
        spark.dataSource.register(source)
