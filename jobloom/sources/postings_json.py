"""JSON-LD postings in pages: blocks, loose parsing, and the nodes that are postings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 8
# Fields a posting must have.
REQUIRED = ["title", "description", "hiringOrganization", "datePosted", "jobLocation"]


#: An ld+json script, quoted type or not.
BLOCK = r"""(?is)<script[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""


def blocks(html: Column) -> Column:
    """Bodies of all ld+json scripts."""
    return F.regexp_extract_all(html, F.lit(BLOCK), 1)


# References in blocks that were escaped as a whole; & comes last.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def loose_json(c: Column) -> Column:
    """The text of the first reading that is JSON: as it is, without CDATA, with references decoded, without trailing commas; else null."""
    a = F.trim(c)
    b = F.trim(F.regexp_replace(a, r"^\s*(?://)?\s*<!\[CDATA\[|(?://)?\s*\]\]>\s*$", ""))
    d = decode_entities(b)
    e = F.regexp_replace(d, r",(\s*[}\]])", "$1")
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in (a, b, d, e)])


def is_posting_type(kind: object) -> bool:
    return any(isinstance(k, str) and k.endswith("JobPosting") for k in (kind if isinstance(kind, list) else [kind]))


def is_posting(kind: Column) -> Column:
    """The same of a JSON text of a node's type: a text, or a list of texts."""
    return F.coalesce(F.exists(F.when(kind.startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array(kind)), lambda k: k.endswith("JobPosting")), F.lit(False))


def _walk(node: object, depth: int = 0) -> Iterator[dict]:
    if depth > DEPTH:
        return
    if isinstance(node, list):
        for x in node:
            yield from _walk(x, depth + 1)
    elif isinstance(node, dict):
        if is_posting_type(node.get("@type")):
            yield node
        else:
            for x in node.values():
                if isinstance(x, (dict, list)):
                    yield from _walk(x, depth + 1)


def best_of_page(html: str) -> dict | None:
    """The posting with most keys among a page's blocks, the first of equals, read as `loose_json` reads; for readers that have no Column."""
    best = None
    for body in re.findall(BLOCK, html):
        bare = re.sub(r"^\s*(?://)?\s*<!\[CDATA\[|(?://)?\s*\]\]>\s*$", "", body.strip()).strip()
        plain = bare
        for a, b in ENTITIES:
            plain = plain.replace(a, b)
        for text in (body.strip(), bare, plain, re.sub(r",(\s*[}\]])", r"\1", plain)):
            try:
                found = json.loads(text)
            except ValueError:
                continue
            for node in _walk(found):
                best = node if best is None or len(node) > len(best) else best
            break
    return best


def nodes(text: Column) -> Column:
    """Every posting node of a JSON text, down to DEPTH: Catalyst has no walk of unknown depth."""

    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [json.dumps(n, ensure_ascii=False) for n in _walk(json.loads(t))] if t is not None else [])

    return of(text)


def collect_postings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, block, node, posting): a row for each posting node, by its block and its place there; blocks that can't be read give none."""
    rows = pages.select(id_col, F.posexplode(blocks(F.col(html_col))).alias("block", "body"))
    return rows.select(id_col, "block", F.posexplode(nodes(loose_json(F.col("body")))).alias("node", "posting"))


@F.udtf(returnType="node int, posting string")
class WalkedPostings:
    """The posting nodes of a JSON text wherever they stand, down to DEPTH."""

    def eval(self, text: str):
        for k, node in enumerate(_walk(json.loads(text))):
            yield k, json.dumps(node, ensure_ascii=False)


def _upper_nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, block, text, found, more): of each readable block the postings among the top, its elements and those of its graph, and whether others may lie deeper."""
    rows = pages.select(id_col, F.posexplode(blocks(F.col(html_col))).alias("block", "body")).select(id_col, "block", loose_json(F.col("body")).alias("text")).where("text is not null")
    kind = lambda v: F.try_variant_get(v, "$['@type']", "string")
    rows = rows.withColumn("v", F.parse_json("text"))
    top = is_posting(kind(F.col("v")))
    # Null where the top is neither a list nor has a list as its graph.
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$['@graph']", "array<variant>"))
    among = F.filter(F.coalesce(listed, F.array().cast("array<variant>")), lambda x: is_posting(kind(x)))
    found = F.when(top, F.array(F.to_json("v"))).otherwise(F.transform(among, lambda x: F.to_json(x)))
    rows = rows.select(id_col, "block", "text", found.alias("found"))
    # Every posting's type is said in the text; escapes might hide one.
    return rows.withColumn("more", (F.regexp_count("text", F.lit('JobPosting"')) > F.size("found")) | F.col("text").contains("\\u"))


def plain_postings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, block, node, posting) of the postings at the top of a block, in its list or in its graph, by built-in functions alone."""
    return _upper_nodes(pages, id_col, html_col).select(id_col, "block", F.posexplode("found").alias("node", "posting"))


def all_postings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, block, node, posting) of every posting node: plain blocks by built-in functions, those that say more by a walk in Python.

    The same nodes as `collect_postings`; keys of plain ones are in the order of their names.
    """
    rows = _upper_nodes(pages, id_col, html_col)
    deep = rows.where("more").select(id_col, "block", "text").lateralJoin(WalkedPostings(F.col("text").outer())).select(id_col, "block", "node", "posting")
    return rows.where("not more").select(id_col, "block", F.posexplode("found").alias("node", "posting")).union(deep)


def best_block(postings: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Of a page's postings the one with most keys, the first of equals."""
    n = F.size(F.json_object_keys("posting"))
    return postings.groupBy(id_col).agg(F.max_by("posting", F.struct(n, -F.col("block"), -F.col("node"))).alias("posting"))


def missing_fields(posting: Column) -> Column:
    """Required fields that a posting lacks; a remote one needs no place."""
    remote = F.get_json_object(posting, "$.jobLocationType") == "TELECOMMUTE"
    lacks = lambda f: F.get_json_object(posting, f"$.{f}").isNull()
    return F.array_compact(F.array(*[F.when(lacks(f) & (~F.coalesce(remote, F.lit(False)) if f == "jobLocation" else F.lit(True)), F.lit(f)) for f in REQUIRED]))


def demo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with 0 to 2 posting blocks each: plain, in a graph with a trailing comma, beside a broken one."""
    p = F.col("page_id").cast("string")
    one = F.concat(F.lit('<script type="application/ld+json">{"@type":"JobPosting","title":"Job '), p, F.lit('","jobLocation":"x"}</script>'))
    two = F.concat(F.lit('<script type=application/ld+json>{"@graph":[{"@type":["Thing","JobPosting"],"title":"Other '), p, F.lit('",}]}</script>'))
    extra = F.when(F.col("page_id") % 3 == 1, one).when(F.col("page_id") % 3 == 2, F.concat(one, two)).otherwise(F.lit(""))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.col("html"), extra).alias("html"))
