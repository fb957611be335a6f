"""Edits of field dictionaries: a dictionary and its edits are rows of arrays, applied and compared by match keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import clean_term, let, match_key

#: Stands before terms that only support others.
GRAY = "~"
MOST_TERMS, MOST_DAYS = 150, 365
EDITS = ["add", "add_gray", "remove", "promote", "add_exclude", "remove_exclude", "add_province", "remove_province"]


def is_gray(term: Column) -> Column:
    return term.startswith(GRAY)


def term_label(term: Column) -> Column:
    """A term as readers see it."""
    return F.when(is_gray(term), F.substring(term, len(GRAY) + 1, 1 << 20)).otherwise(term)


def same_term(a: Column, b: Column) -> Column:
    return match_key(a) == match_key(b)


def is_slug(c: Column) -> Column:
    return c.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & (F.length(c) <= 60)


def keys_of(terms: Column) -> Column:
    return F.transform(terms, lambda t: match_key(term_label(t)))


def _once(terms: Column, keys: Column) -> Column:
    """Each term whose key doesn't stand earlier."""
    return let(keys, lambda ks: F.filter(terms, lambda t, i: F.array_position(ks, F.get(ks, i)) == i + 1))


def unique_terms(terms: Column) -> Column:
    return _once(terms, F.transform(terms, match_key))


def _without(terms: Column, keys: Column) -> Column:
    """Terms whose label's key isn't among `keys`."""
    return F.filter(terms, lambda t: ~F.array_contains(keys, match_key(term_label(t))))


def _within(terms: Column, keys: Column) -> Column:
    return F.filter(terms, lambda t: F.array_contains(keys, match_key(term_label(t))))


def read_edits(params: Column) -> Column:
    """struct of EDITS and max_age_days, max_age_set, from a map of request parameters to values: terms cleaned, once each; junk dropped.

    An age of 0 sets no limit, one of 1 to MOST_DAYS sets it, others change nothing.
    """
    none = F.array().cast("array<string>")
    values = lambda k: F.coalesce(F.try_element_at(params, F.lit(k)), none)
    terms = lambda k: let(F.filter(F.transform(values(k), clean_term), lambda t: t.isNotNull()), unique_terms)
    slugs = lambda k: F.array_distinct(F.filter(values(k), is_slug))
    age = F.try_element_at(values("max_age_days"), F.lit(1))
    days = F.when(age.rlike(r"^\d{1,3}$"), age.cast("int"))
    fits = F.coalesce(days <= MOST_DAYS, F.lit(False))
    return F.struct(*[(slugs if k.endswith("province") else terms)(k).alias(k) for k in EDITS], F.when(fits & (days > 0), days).alias("max_age_days"), fits.alias("max_age_set"))


def apply_edits(saved: Column, edits: Column) -> Column:
    """struct(keywords, excludes, provinces, max_age_days) after edits: terms are removed, promoted, added, then gray ones added; MOST_TERMS stay."""

    def keywords(kept: Column) -> Column:
        promoted = let(F.concat(F.transform(edits["promote"], match_key), F.transform(edits["add"], match_key)), lambda up: F.transform(kept, lambda t: F.when(F.array_contains(up, match_key(term_label(t))), term_label(t)).otherwise(t)))
        added = let(keys_of(kept), lambda ks: F.filter(edits["add"], lambda t: ~F.array_contains(ks, match_key(t))))
        return let(F.concat(promoted, added), lambda now: F.concat(now, let(keys_of(now), lambda ks: F.transform(F.filter(edits["add_gray"], lambda t: ~F.array_contains(ks, match_key(t))), lambda t: F.concat(F.lit(GRAY), t)))))

    def more(kept: Column, extra: Column, key) -> Column:
        return F.concat(kept, let(F.transform(kept, key), lambda ks: F.filter(extra, lambda t: ~F.array_contains(ks, key(t)))))

    same = lambda t: t
    excludes = let(F.transform(edits["remove_exclude"], match_key), lambda ks: F.filter(saved["excludes"], lambda t: ~F.array_contains(ks, match_key(t))))
    return F.struct(
        F.slice(let(let(F.transform(edits["remove"], match_key), lambda ks: _without(saved["keywords"], ks)), keywords), 1, MOST_TERMS).alias("keywords"),
        F.slice(let(excludes, lambda kept: more(kept, edits["add_exclude"], match_key)), 1, MOST_TERMS).alias("excludes"),
        let(F.array_except(saved["provinces"], edits["remove_province"]), lambda kept: more(kept, edits["add_province"], same)).alias("provinces"),
        F.when(edits["max_age_set"], edits["max_age_days"]).otherwise(saved["max_age_days"]).alias("max_age_days"),
    )


def diff(saved: Column, draft: Column) -> Column:
    """The fewest edits that make `draft` of `saved`: applied to `saved` they give `draft`'s terms."""

    def of(k: Column) -> Column:
        labels = lambda terms: F.transform(terms, term_label)
        old = lambda gray: F.filter(saved["keywords"], lambda t: is_gray(t) == F.lit(gray))
        new = lambda gray: F.filter(draft["keywords"], lambda t: is_gray(t) == F.lit(gray))
        demoted = let(keys_of(old(False)), lambda ks: _within(new(True), ks))
        fresh = lambda gray: _without(new(gray), k.saved)
        out = {
            "add": labels(fresh(False)), "add_gray": labels(F.concat(fresh(True), demoted)), "remove": labels(F.concat(_without(saved["keywords"], k.draft), demoted)), "promote": labels(let(keys_of(old(True)), lambda ks: _within(new(False), ks))),
            "add_exclude": let(F.transform(saved["excludes"], match_key), lambda ks: F.filter(draft["excludes"], lambda t: ~F.array_contains(ks, match_key(t)))), "remove_exclude": let(F.transform(draft["excludes"], match_key), lambda ks: F.filter(saved["excludes"], lambda t: ~F.array_contains(ks, match_key(t)))),
            "add_province": F.array_except(draft["provinces"], saved["provinces"]), "remove_province": F.array_except(saved["provinces"], draft["provinces"]),
        }
        changed = ~draft["max_age_days"].eqNullSafe(saved["max_age_days"])
        return F.struct(*[out[e].alias(e) for e in EDITS], F.when(changed, draft["max_age_days"]).alias("max_age_days"), changed.alias("max_age_set"))

    return let(F.struct(keys_of(saved["keywords"]).alias("saved"), keys_of(draft["keywords"]).alias("draft")), of)


def entries(edits: Column) -> Column:
    """array<struct(key, value)>: edits as request parameters."""
    of = lambda e: F.transform(edits[e], lambda v: F.struct(F.lit(e).alias("key"), v.alias("value")))
    each = [of(e) for e in ("remove", "promote", "add", "add_gray", "remove_exclude", "add_exclude", "remove_province", "add_province")]
    age = F.when(edits["max_age_set"], F.array(F.struct(F.lit("max_age_days").alias("key"), F.coalesce(edits["max_age_days"], F.lit(0)).cast("string").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return F.concat(*each, age)


def has_changes(edits: Column) -> Column:
    return F.size(entries(edits)) > 0


def saveable(draft: Column, known_provinces: Column) -> Column:
    """The draft with unknown provinces dropped, null if none of its terms is a strong one: such a field would hold nothing."""
    strong = F.exists(draft["keywords"], lambda t: ~is_gray(t))
    return F.when(strong, draft.withField("provinces", F.filter(draft["provinces"], lambda p: F.array_contains(known_provinces, p))))


def without_keyword(draft: Column, label: Column) -> Column:
    return draft.withField("keywords", let(match_key(label), lambda k: F.filter(draft["keywords"], lambda t: match_key(term_label(t)) != k)))


def with_promoted(draft: Column, label: Column) -> Column:
    return draft.withField("keywords", let(match_key(label), lambda k: F.transform(draft["keywords"], lambda t: F.when(is_gray(t) & (match_key(term_label(t)) == k), term_label(t)).otherwise(t))))


def without_exclude(draft: Column, term: Column) -> Column:
    return draft.withField("excludes", let(match_key(term), lambda k: F.filter(draft["excludes"], lambda t: match_key(t) != k)))


def with_province(draft: Column, slug: Column, on: bool) -> Column:
    rest = F.array_remove(draft["provinces"], slug)
    return draft.withField("provinces", F.array_append(rest, slug) if on else rest)


def with_max_age(draft: Column, days: Column) -> Column:
    return draft.withField("max_age_days", days)
