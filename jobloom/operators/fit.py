"""How well a posting fits a candidate's profile: an additive score of array intersections, flags and a band."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import let, tech_key


@dataclass
class Group:
    skills: list[str]
    weight: float


@dataclass
class Profile:
    """Weights and words; every list may be empty."""

    years: int = 0
    core: list[Group] = field(default_factory=list)
    databases: list[str] = field(default_factory=list)
    bonus: list[str] = field(default_factory=list)
    bonus_each: float = 3
    bonus_cap: float = 15
    other_stacks: list[str] = field(default_factory=list)
    exclusive: list[str] = field(default_factory=list)
    mixed_penalty: float = -10
    frontends: list[str] = field(default_factory=list)
    own_frontends: list[str] = field(default_factory=list)
    frontend_penalty: float = -8
    senior_words: list[str] = field(default_factory=list)
    too_senior_gap: int = 3
    within: float = 20
    plus_one: float = 14
    plus_two: float = 6
    unknown: float = 10
    under: float = 5
    senior_cap: float = 12
    language_words: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    language_penalty: float = -10
    english: list[str] = field(default_factory=list)
    english_penalty: float = -5
    remote: float = 5
    home: list[str] = field(default_factory=list)
    home_points: float = 5
    domain: list[str] = field(default_factory=list)
    domain_points: float = 5
    requirements: list[str] = field(default_factory=list)
    gaps: list[str] = field(default_factory=list)
    great: float = 70
    good: float = 50
    stretch: float = 30

    def __post_init__(self) -> None:
        bad = [g for g in self.core if not g.skills or g.weight < 0]
        if bad or self.years < 0 or not self.great >= self.good >= self.stretch:
            raise ValueError(f"profile: {'core' if bad else 'years' if self.years < 0 else 'bands'}")

    @staticmethod
    def parse(config: dict) -> Profile:
        """From a JSON object; an error names the path of the first value that doesn't fit."""
        known = {f.name: f for f in fields(Profile)}
        for key, value in config.items():
            if key not in known:
                raise ValueError(f"{key}: unknown")
            if key == "core":
                for i, g in enumerate(value if isinstance(value, list) else [None]):
                    if not isinstance(g, dict) or not isinstance(g.get("skills"), list) or not g["skills"] or not isinstance(g.get("weight"), (int, float)):
                        raise ValueError(f"core[{i}]: skills and weight expected")
            elif known[key].default_factory is list:
                for i, x in enumerate(value if isinstance(value, list) else [None]):
                    if not isinstance(x, str):
                        raise ValueError(f"{key}[{i}]: text expected")
            elif isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"{key}: number expected")
        return Profile(**{k: [Group(g["skills"], g["weight"]) for g in v] if k == "core" else v for k, v in config.items()})


def has_word(key: Column, word: str) -> Column:
    """Whether a word or phrase stands alone in a tech key."""
    return F.concat(F.lit(" "), key, F.lit(" ")).contains(F.concat(F.lit(" "), tech_key(F.lit(word)), F.lit(" ")))


def same_text(a: Column, b: Column) -> Column:
    return tech_key(a) == tech_key(b)


def names_of(slugs: Column, names: dict[str, str]) -> Column:
    """Skills' names; a slug that has none stands for itself."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    return F.transform(slugs, lambda s: F.coalesce(F.try_element_at(known, s), s) if known is not None else s)


def score(p: Profile) -> Column:
    """struct(score, band, flags, matched, missing, reasons) of rows (title_key, title_skills, declared, text_skills, level, years_min, work_mode, district).

    A core group counts whole if a skill is in the title or declared, half if only in the text. Flags (another stack, too
    senior, a language asked for) make the band 'off'. Without any skill but requirements the band is 'unknown'; interns and freshers stay
    at 'stretch'. missing has the profile's gaps that the posting asks for.
    """
    strong = F.array_union("title_skills", "declared")
    sets = F.struct(F.col("title_skills").alias("title"), F.col("declared").alias("declared"), strong.alias("strong"), F.array_union(strong, F.col("text_skills")).alias("every"))
    return let(sets, lambda x: let(_points(p, x), lambda y: _banded(p, y)))


def _points(p: Profile, x: Column) -> Column:
    """struct(total, flags, under, technical, matched, missing, reasons) of a posting's sets of skills."""
    title, strong, every = x.title, x.strong, x.every
    lits = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    has = lambda a, xs: F.arrays_overlap(a, lits(xs)) if xs else F.lit(False)
    word = lambda xs: F.greatest(F.lit(False), F.lit(False), *[has_word(F.col("title_key"), w) for w in xs])
    zero = F.lit(0.0)
    total = sum((F.when(has(strong, g.skills), F.lit(float(g.weight))).when(has(every, g.skills), F.lit(g.weight / 2)).otherwise(zero) for g in p.core), zero)
    total += F.least(F.size(F.array_intersect(every, lits(p.bonus))) * p.bonus_each, F.lit(p.bonus_cap))
    stack = [s for g in p.core for s in g.skills if s not in p.databases]
    other, exclusive = has(title, p.other_stacks), has(title, p.exclusive)
    other_flag = exclusive | (other & ~has(title, stack))
    total += F.when(other & ~other_flag, p.mixed_penalty).otherwise(zero)
    total += F.when(has(strong, p.frontends) & ~has(every, p.own_frontends), p.frontend_penalty).otherwise(zero)
    gap = F.col("years_min") - p.years
    too_senior = word(p.senior_words) | F.coalesce(F.col("level").isin("LEAD", "MANAGER"), F.lit(False)) | F.coalesce(gap >= p.too_senior_gap, F.lit(False))
    under = F.coalesce(F.col("level").isin("INTERN", "FRESHER"), F.lit(False))
    points = F.when(under, p.under).when(gap.isNull(), p.unknown).when(gap <= 0, p.within).when(gap == 1, p.plus_one).otherwise(p.plus_two)
    total += F.when(F.col("level") == "SENIOR", F.least(points, F.lit(p.senior_cap))).otherwise(points)
    language = word(p.language_words) | has(F.col("declared"), p.languages)
    total += F.when(~language & has(every, p.languages), p.language_penalty).otherwise(zero)
    total += F.when(has(every, p.english) | word(p.english), p.english_penalty).otherwise(zero)
    flexible = F.coalesce(F.col("work_mode").isin("REMOTE", "HYBRID"), F.lit(False))
    total += F.when(flexible, p.remote).otherwise(zero)
    near = F.array_contains(F.transform(lits(p.home), tech_key), tech_key(F.col("district"))) if p.home else F.lit(False)
    total += F.when(near, p.home_points).otherwise(zero)
    total += F.when(has(every, p.domain), p.domain_points).otherwise(zero)
    wanted = [s for g in p.core for s in g.skills] + p.bonus
    return F.struct(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(total + 0.5).cast("double"))).alias("total"), F.array_compact(F.array(F.when(other_flag, F.lit("other-stack")), F.when(too_senior, F.lit("too-senior")), F.when(language, F.lit("lang-required")))).alias("flags"),
        under.alias("under"), (F.size(F.array_except(every, lits(p.requirements))) > 0).alias("technical"), F.array_intersect(lits(wanted), every).alias("matched"), F.array_intersect(lits(p.gaps), every).alias("missing"),
        F.array_compact(F.array(F.when(flexible, F.lower("work_mode")), F.when(near, F.col("district")), F.when(has(every, p.domain), F.lit("domain")))).alias("reasons"),
    )


def _banded(p: Profile, x: Column) -> Column:
    band = F.when(F.size(x.flags) > 0, "off").when(~x.technical, "unknown").when(x.total >= p.great, "great").when(x.total >= p.good, "good").when(x.total >= p.stretch, "stretch").otherwise("off")
    band = F.when(x.under & band.isin("great", "good"), "stretch").otherwise(band)
    return F.struct(x.total.cast("int").alias("score"), band.alias("band"), x.flags.alias("flags"), x.matched.alias("matched"), x.missing.alias("missing"), x.reasons.alias("reasons"))


def explain(result: Column, names: dict[str, str]) -> Column:
    """A score in words: what matches, what is missing, then the other reasons."""
    part = lambda word, slugs: F.when(F.size(slugs) > 0, F.concat(F.lit(word), F.array_join(names_of(slugs, names), ", ")))
    return F.array_join(F.array_compact(F.concat(F.array(part("khớp ", result.matched), part("thiếu ", result.missing)), result.reasons)), " · ")


def report(fits: DataFrame) -> DataFrame:
    """(part, key, n) of scored postings (verdict, fit, role): verdicts, and of those in the field bands, flags, roles, and gaps among great and good ones."""
    inside = F.col("verdict") != "reject"
    one = lambda part, c: F.struct(F.lit(part).alias("part"), c.alias("key"))
    many = lambda part, cs: F.transform(cs, lambda c: one(part, c))
    own = F.concat(F.array(one("band", F.col("fit.band")), one("role", F.col("role"))), many("flag", F.col("fit.flags")), F.when(F.col("fit.band").isin("great", "good"), many("gap", F.col("fit.missing"))).otherwise(F.array().cast("array<struct<part:string,key:string>>")))
    rows = F.concat(F.array(one("verdict", F.col("verdict"))), F.when(inside, own).otherwise(F.array().cast("array<struct<part:string,key:string>>")))
    return fits.select(F.inline(rows)).groupBy("part", "key").agg(F.count("*").alias("n"))
