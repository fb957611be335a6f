"""Sitemaps: entries of files, and bounded walks over an index, as joins over a table of files (url, body)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import canonical_url
from jobloom.sources.store import shared_folder

#: Files are read so many levels below the roots, which are level 0.
DEPTH = 3
#: Files that a walk reads at most.
MAX_FILES = 50


def decode_xml(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _inner(block: Column, tag: str) -> Column:
    raw = F.regexp_extract(block, rf"(?is)<{tag}[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</{tag}>", 1)
    return F.nullif(decode_xml(F.trim(raw)), F.lit(""))


def entries(body: Column) -> Column:
    """array<struct<loc, lastmod>> of a file's url and sitemap blocks; bare loc elements if it has no blocks."""
    blocks = F.regexp_extract_all(body, F.lit(r"(?is)<(?:url|sitemap)\b[^>]*>.*?</(?:url|sitemap)>"), 0)
    bare = F.regexp_extract_all(body, F.lit(r"(?is)<loc[^>]*>.*?</loc>"), 0)
    full = F.transform(F.when(F.size(blocks) > 0, blocks).otherwise(bare), lambda b: F.struct(_inner(b, "loc").alias("loc"), _inner(b, "lastmod").alias("lastmod")))
    return F.filter(full, lambda e: e.loc.isNotNull())


def is_index(body: Column) -> Column:
    return body.rlike(r"(?i)<sitemapindex\b")


def is_nested(loc: Column, job_pattern: str) -> Column:
    """An entry that is a sitemap itself though a urlset lists it."""
    return loc.rlike(r"(?i)\.xml(\.gz)?([?#]|$)") & ~loc.rlike(job_pattern)


def walk(files: DataFrame, roots: DataFrame, job_pattern: str, depth: int = DEPTH, since: str | None = None, max_urls: int | None = None) -> DataFrame:
    """(url, lastmod) of job entries in files up to `depth` levels below `roots` (url), each canonical URL once.

    A file that is missing gives nothing and harms nothing; a file that lists itself is read once a level. With `since` only entries
    that changed from that day on count, and those that don't say. With `max_urls` the last changed stay, not the first found as in
    `frontier_walk`, and a column truncated says whether others were left out.
    """
    level, found = roots.select("url").distinct(), None
    for _ in range(depth + 1):
        read = files.join(level, "url", "left_semi").select(is_index(F.col("body")).alias("index"), F.inline(entries(F.col("body"))))
        nested = F.col("index") | is_nested(F.col("loc"), job_pattern)
        jobs = read.where(~nested & F.col("loc").rlike(job_pattern)).select(canonical_url(F.col("loc")).alias("url"), "lastmod")
        found = jobs if found is None else found.unionByName(jobs)
        level = read.where(nested).select(F.col("loc").alias("url")).distinct()
    out = found.groupBy("url").agg(F.max("lastmod").alias("lastmod"))
    if since is not None:
        out = out.where(F.col("lastmod").isNull() | (F.left("lastmod", F.lit(10)) >= since))
    if max_urls is None:
        return out
    # One more than asked tells whether any is left out.
    first = out.orderBy(F.desc_nulls_last("lastmod"), "url").limit(max_urls + 1)
    return first.withColumn("truncated", F.lit(first.count() > max_urls)).orderBy(F.desc_nulls_last("lastmod"), "url").limit(max_urls)


@dataclass
class Walk:
    """What a walk found: entries (url, lastmod, found: level, file and place, by which they are ordered), errors (url, message), files read, whether more was there."""

    entries: DataFrame
    errors: DataFrame
    files: int
    truncated: bool


def frontier_walk(
    files: DataFrame, roots: list[str], job_pattern: str | None = None, sitemap_pattern: str | None = None, include_pattern: str | None = None, since: str | None = None, max_files: int = MAX_FILES, max_urls: int | None = None, depth: int = DEPTH
) -> Walk:
    """A walk in breadth over `files` (url, status, body), each read once, level by level from `roots` to `depth` below them.

    A level is the files that the one before listed, in the order of the lists, without those read before; its files and all they list
    are written once and joined on. Index entries, and entries of a urlset that are sitemaps themselves, are followed if they fit
    `sitemap_pattern` and changed at `since` or don't say when; the others are jobs if they fit `job_pattern`, `include_pattern`
    (case aside) and `since`, each canonical URL once, the first found. Files that are missing or have another status than 200 are
    errors and count as read. The walk stops at `max_files` files or `max_urls` jobs; truncated says whether anything was left to read then.
    """
    spark = files.sparkSession
    folder = shared_folder(spark)
    fits = lambda c, p, flags="": c.rlike(flags + p) if p else F.lit(True)
    changed = lambda c: F.lit(True) if since is None else F.coalesce(F.try_to_timestamp(c) >= F.lit(since).cast("timestamp"), F.lit(True))
    job = F.col("loc").rlike(job_pattern) if job_pattern else F.lit(False)
    nested = F.col("index") | (F.col("loc").rlike(r"(?i)\.xml(\.gz)?([?#]|$)") & ~job)
    queue = spark.createDataFrame([(u, [i]) for i, u in enumerate(roots)], "url string, at array<int>")
    levels, visited, n_files, truncated = [], [], 0, False
    stop = None
    for level in range(depth + 1):
        fresh = queue.groupBy("url").agg(F.min("at").alias("at"))
        if visited:
            fresh = fresh.join(reduce(DataFrame.union, visited), "url", "left_anti")
        # At most max_files rows.
        fresh = fresh.orderBy("at").limit(max(max_files - n_files, 0))
        own = files.select("url", "status", "body", F.lit(True).alias("there"))
        good = F.col("there") & (F.coalesce(F.col("status"), F.lit(200)) == 200) & (F.coalesce(F.col("body"), F.lit("")) != "")
        read = fresh.join(own, "url", "left").select(
            "url", "at", F.when(good, F.lit(None).cast("string")).otherwise(F.concat(F.lit("HTTP "), F.coalesce(F.when(F.col("there"), F.col("status").cast("string")), F.lit("404")))).alias("error"),
            F.coalesce(is_index(F.col("body")), F.lit(False)).alias("index"), F.when(good, entries(F.col("body"))).alias("entries"),
        )
        read.write.parquet(f"{folder}/files-{level}")
        read = spark.read.schema(read.schema).parquet(f"{folder}/files-{level}")
        visited.append(read.select("url"))
        listed = read.select("url", "at", "index", F.posexplode("entries").alias("pos", "e")).select("at", "index", "pos", "e.loc", "e.lastmod")
        jobs = listed.where(~nested & (job if job_pattern else F.lit(True)) & fits(F.col("loc"), include_pattern, "(?i)") & changed(F.col("lastmod")))
        jobs = jobs.select(F.lit(level).alias("level"), "at", "pos", canonical_url(F.col("loc")).alias("url"), "lastmod").where("url is not null")
        levels.append((read, listed, jobs))
        count = read.count()
        n_files += count
        found = reduce(DataFrame.union, [x[2] for x in levels]).groupBy("url").agg(F.min(F.struct("level", "at", "pos", "lastmod")).alias("f"))
        if max_urls is not None:
            # At most max_urls rows; the last tells where the walk ends.
            last = found.orderBy("f").limit(max_urls).agg(F.count("*").alias("n"), F.max("f").alias("f")).first()
            if last.n >= max_urls > 0:
                stop = last.f
                before = F.col("at") <= F.lit(stop.at)
                more = listed.where((F.col("at") == F.lit(stop.at)) & (F.col("pos") > stop.pos)).limit(1).count() or queue.where(~before).limit(1).count()
                children = listed.where(nested & before & ((F.col("at") < F.lit(stop.at)) | (F.col("pos") < stop.pos)) & fits(F.col("loc"), sitemap_pattern) & changed(F.col("lastmod")))
                truncated = bool(more or children.limit(1).count())
                n_files -= read.where(~before).count()
                break
        following = listed.where(nested & fits(F.col("loc"), sitemap_pattern) & changed(F.col("lastmod"))).select(F.col("loc").alias("url"), F.concat("at", F.array("pos")).alias("at"))
        if n_files >= max_files:
            last = read.agg(F.max("at")).first()[0]
            rest = queue.where(F.col("at") > F.lit(last)) if last is not None else queue
            truncated = bool(rest.limit(1).count() or following.limit(1).count())
            break
        queue = following
        if level == depth or not queue.limit(1).count():
            break
    errors = reduce(DataFrame.union, [r.where("error is not null").select(F.lit(k).alias("level"), "at", "url", "error") for k, (r, *_) in enumerate(levels)])
    if stop is not None:
        found = found.where(F.col("f") <= F.struct(F.lit(stop.level).alias("level"), F.lit(stop.at).alias("at"), F.lit(stop.pos).alias("pos"), F.lit(stop.lastmod).alias("lastmod")))
        errors = errors.where((F.col("level") < stop.level) | ((F.col("level") == stop.level) & (F.col("at") <= F.lit(stop.at))))
    return Walk(found.select("url", "f.lastmod", F.struct("f.level", "f.at", "f.pos").alias("found")), errors.select("url", F.col("error").alias("message")), n_files, truncated)
