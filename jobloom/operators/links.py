"""What hangs on postings: companies and their other names, places, skills, saved postings; each step joins and gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.sources.model import ALIVE

REMOTE, REMOTE_TEXT = "remote", "Làm từ xa"
SAVED_LIMIT = 20


def merge_companies(companies: DataFrame, names: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies, names) after postings' companies were `seen` (key, slug, name, website, logo_url).

    A key that is known leads to its company, which stays as it is. Others meet by slug: what is said of website and logo replaces
    what was there, and the key becomes one more of the company's names; the first name of a new slug names it. companies has
    (slug, name, website, logo_url), names (key, slug).
    """
    fresh = seen.where(F.col("slug").isNotNull()).join(names.select("key"), "key", "left_anti")
    first = lambda c: F.first(c, ignorenulls=True)
    each = fresh.groupBy("slug").agg(F.min("name").alias("_name"), first("website").alias("_website"), first("logo_url").alias("_logo"))
    merged = companies.join(each, "slug", "full_outer").select("slug", F.coalesce("name", "_name").alias("name"), F.coalesce("_website", "website").alias("website"), F.coalesce("_logo", "logo_url").alias("logo_url"))
    return merged, names.unionByName(fresh.groupBy("key").agg(F.min("slug").alias("slug")))


def company_of(keys: DataFrame, names: DataFrame) -> DataFrame:
    """`keys` (key, slug) with company: the known one of a key, else its own slug."""
    known = names.select("key", F.col("slug").alias("known"))
    return keys.join(known, "key", "left").withColumn("company", F.coalesce("known", "slug")).drop("known")


def link_locations(links: DataFrame, postings: DataFrame, known: DataFrame) -> DataFrame:
    """`links` (posting_id, slug, raw) with those of `postings` (posting_id, locations: array<struct<raw, slug>>, work_mode) added or renewed; none is taken away.

    A remote posting without a province hangs on REMOTE; slugs that aren't in `known` (slug) are left out.
    """
    first_raw = F.try_element_at("locations", F.lit(1)).raw
    placed = F.filter("locations", lambda x: x.slug.isNotNull())
    remote = F.when((F.size(placed) == 0) & (F.col("work_mode") == "REMOTE"), F.array(F.struct(F.coalesce(first_raw, F.lit(REMOTE_TEXT)).alias("raw"), F.lit(REMOTE).alias("slug"))))
    each = postings.select("posting_id", F.posexplode(F.coalesce(remote, placed)).alias("at", "x"))
    new = each.groupBy("posting_id", F.col("x.slug").alias("slug")).agg(F.min_by("x.raw", "at").alias("new")).join(known.select("slug"), "slug", "left_semi")
    return links.join(new, ["posting_id", "slug"], "full_outer").select("posting_id", "slug", F.coalesce("new", "raw").alias("raw"))


def link_skills(links: DataFrame, found: DataFrame, postings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """`links` (posting_id, slug, origin) with those of `postings` (posting_id) replaced by what was `found`; an empty catalogue (slug) changes nothing."""
    if catalogue.isEmpty():
        return links
    fresh = found.join(catalogue.select("slug"), "slug", "left_semi").dropDuplicates(["posting_id", "slug"]).select("posting_id", "slug", "origin")
    return links.join(postings.select("posting_id"), "posting_id", "left_anti").select("posting_id", "slug", "origin").unionByName(fresh)


def toggle_saved(saved: DataFrame, wishes: DataFrame, postings: DataFrame, limit: int = SAVED_LIMIT) -> DataFrame:
    """`saved` (user_id, posting_id, saved_at) after wishes (user_id, posting_id, at, save boolean), a user's last one for each posting.

    Taking away always works; what is saved stays saved with its time; postings that aren't there are left out; beyond `limit` postings
    a user's later wishes fall away.
    """
    last = wishes.groupBy("user_id", "posting_id").agg(F.max_by(F.struct("save", "at"), "at").alias("w")).select("user_id", "posting_id", "w.*")
    kept = saved.join(last.where("not save"), ["user_id", "posting_id"], "left_anti")
    new = last.where("save").join(postings.select("posting_id"), "posting_id", "left_semi").join(kept, ["user_id", "posting_id"], "left_anti").select("user_id", "posting_id", F.col("at").alias("saved_at"), F.lit(True).alias("new"))
    rows = kept.select("user_id", "posting_id", "saved_at", F.lit(False).alias("new")).unionByName(new)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("new", "saved_at", "posting_id"))
    return rows.withColumn("place", place).where(~F.col("new") | (F.col("place") <= limit)).select("user_id", "posting_id", "saved_at")


def saved_postings(saved: DataFrame, postings: DataFrame) -> DataFrame:
    """Saved postings, the last saved first."""
    return saved.join(postings, "posting_id").orderBy(F.desc("saved_at"), "posting_id")


def save_context(saved: DataFrame, users: DataFrame, allowed: Column, limit: int = SAVED_LIMIT) -> DataFrame:
    """(user_id, count, can_save, can_unsave, reason) of all `users` (user_id)."""
    per = saved.groupBy("user_id").agg(F.count("*").alias("count"))
    full = F.col("count") >= limit
    rows = users.join(per, "user_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return rows.select("user_id", "count", (allowed & ~full).alias("can_save"), allowed.alias("can_unsave"), F.when(~allowed, "not-allowed").when(full, "full").alias("reason"))


def saved_due(saved: DataFrame, postings: DataFrame, as_of: Column, hours: int = 20) -> DataFrame:
    """Alive saved postings not looked at for `hours`, never looked at first."""
    due = F.col("status").isin(ALIVE) & (F.col("checked_at").isNull() | (F.col("checked_at") < as_of - F.expr(f"interval {hours} hours")))
    return postings.where(due).join(saved.select("posting_id").distinct(), "posting_id", "left_semi").orderBy(F.asc_nulls_first("checked_at"), "posting_id")


def record_status(postings: DataFrame, probes: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(postings, audit) after `probes` (posting_id, new_status, new_expires_on): proof of life resets misses, every change is a row of the audit."""
    rows = postings.join(probes, "posting_id", "left")
    status, end = F.coalesce("new_status", "status"), F.coalesce("new_expires_on", "expires_on")
    change = lambda name, old, new: F.when(~old.eqNullSafe(new), F.struct(F.lit(name).alias("field"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value")))
    audit = rows.select("posting_id", F.inline(F.array_compact(F.array(change("status", F.col("status"), status), change("expires_on", F.col("expires_on"), end)))), as_of.alias("at"))
    alive = F.col("new_status").isNotNull() & F.col("new_status").isin(*ALIVE)
    return rows.select(*[{"status": status.alias("status"), "expires_on": end.alias("expires_on"), "miss_count": F.when(alive, 0).otherwise(F.col("miss_count")).alias("miss_count")}.get(c, F.col(c)) for c in postings.columns]), audit


def sweep_scope(stored: DataFrame, targets: DataFrame) -> DataFrame:
    """Stored postings that a sweep may count as missed: all of a source without targets, those within its URL pattern, none of one collected by queries.

    targets: (source_id, kind: 'query', 'url' or null, pattern).
    """
    rows = stored.join(targets, "source_id", "left")
    return rows.where(F.col("kind").isNull() | (F.col("kind") == "url") & F.rlike("url", F.col("pattern"))).select(*[F.col(c) for c in stored.columns])
