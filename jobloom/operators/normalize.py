"""A declared posting (JSON-LD) as one typed row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import classify as C
from jobloom.functions import salary as S
from jobloom.functions import text as T
from jobloom.functions.places import ADDRESS, extract_locations, json_items, only_location

DESCRIPTION_BYTES, EXPERIENCE_LETTERS, MODE_LETTERS = 8 * 1024, 1200, 400
# What a row says of what its posting lacks, and the name of a company that isn't named.
LACKS = {"title": "thiếu title", "company": "thiếu hiringOrganization.name", "description": "thiếu description", "posted": "thiếu/sai datePosted", "place": "thiếu jobLocation"}
UNNAMED = "Không rõ"


Get = Callable[[Column, str], Column]


def of_variant(v: Column, path: str) -> Column:
    """What `get_json_object` gives of a JSON text, of a variant that is parsed already."""
    return F.try_variant_get(v, path, "string")


#: The texts of a posting that are read.
FIELDS = "url title description datePosted validThrough experienceRequirements jobLocationType employmentType industry occupationalCategory skills qualifications".split()


def of_fields(fields: Column) -> Get:
    """What `of_variant` gives, where FIELDS were taken out of a variant already."""
    return lambda v, path: fields[path[2:]] if path[2:] in FIELDS else of_variant(v, path)


def text_at(posting: Column, path: str, get: Get = F.get_json_object) -> Column:
    """A text or number at a path of a JSON text; '' for anything else."""
    return F.coalesce(get(posting, path), F.lit(""))


def record_at(posting: Column, path: str, get: Get = F.get_json_object) -> Column:
    """The object at a path, or the first of an array's elements if it is one; else null."""
    x = F.ltrim(get(posting, path))
    first = get(posting, f"{path}[0]")
    # A missing text isn't looked for as an array: `&` with a null on its left takes its right side, too.
    return F.when(x.startswith("{"), x).when(F.coalesce(x.startswith("["), F.lit(False)) & F.ltrim(first).startswith("{"), first)


#: Ways of working in both places, folded: a text whose folding holds none of them names none.
HYBRID_WORDS = ["hybrid", "ket hop"]


def is_hybrid(title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, F.left(description, F.lit(MODE_LETTERS))))
    return text.rlike(rf"(?<![a-z0-9_]){T.either([*HYBRID_WORDS, 'kết hợp'])}(?![a-z0-9_])")


def industry_of(posting: Column, get: Get = F.get_json_object) -> Column:
    """The first industry that is said, else the first occupational category, cut as a label."""
    first = lambda path: F.try_element_at(F.filter(F.transform(json_items(get(posting, path)), T.normalize_whitespace), lambda x: x != ""), F.lit(1))
    return T.let(F.coalesce(first("$.industry"), first("$.occupationalCategory")), T.truncate_label)


def positive_number(c: Column) -> Column:
    """A number from a text's digits and points; null unless above zero."""
    return T.let(F.regexp_replace(c, r"[^\d.]", "").try_cast("double"), lambda n: F.when(n > 0, n))


def years_text(months: Column) -> Column:
    """Months of experience as the text that `years_of_experience` reads."""
    return F.concat(F.floor(months / 12 + 0.5).cast("string"), F.lit(" năm kinh nghiệm"))


def logo_of(organization: Column) -> Column:
    """A logo's address: the text itself or its url."""
    logo = F.get_json_object(organization, "$.logo")
    return F.when(F.ltrim(logo).startswith("{") | F.ltrim(logo).startswith("["), F.nullif(text_at(record_at(organization, "$.logo"), "$.url"), F.lit(""))).otherwise(F.nullif(logo, F.lit("")))


def declared_skills(posting: Column, more: Column, get: Get = F.get_json_object) -> Column:
    """Distinct items of skills, categories and qualifications, then `more`, lists in texts taken apart."""
    named = lambda x: F.when(F.ltrim(x).startswith("{"), F.get_json_object(x, "$.name")).otherwise(x)
    none = F.array().cast("array<string>")
    several = lambda text: F.flatten(F.transform(F.filter(F.transform(json_items(text), named), lambda x: x.isNotNull()), lambda x: T.skill_texts(x)))
    # A text that is no JSON is the only item.
    of = lambda text: F.when(text.isNull(), none).when(F.ltrim(text).startswith("{") | F.ltrim(text).startswith("["), F.coalesce(several(text), none)).otherwise(T.skill_texts(text))
    extra = F.when(F.size(more) > 0, F.flatten(F.transform(more, lambda x: T.skill_texts(x)))).otherwise(none)
    return F.array_distinct(F.concat(*[of(get(posting, p)) for p in ("$.skills", "$.occupationalCategory", "$.qualifications")], extra))


#: The texts of an employer that are read.
FIRM = "name sameAs url logo".split()


def of_firm(name: str) -> Column:
    """A text of the employer: of `_firm`, taken out of the variant, or where that is no object (a list, a text) of `_org`, which is there for these and for logos."""
    return F.when(F.col("_firm").isNotNull(), F.col(f"_firm.{name}")).otherwise(F.get_json_object("_org", f"$.{name}"))


def normalize(postings: DataFrame, id_pattern: str | None = None, street_first: bool = False, as_of: Column | None = None, compose: bool = False) -> DataFrame:
    """One typed row for each row of `postings`: (posting: JSON text, page_url, salary_text, skills, work_mode); other columns pass through.

    Nothing throws: what is missing is listed in parse_error, and parse_status is PARTIAL if anything is. Pay is the declared
    one, else the page's text if that is public. Schedules are read in the whole description, of which DESCRIPTION_BYTES are kept.
    A posting without a date counts as posted `as_of` (now). With `compose` letters and marks are composed (NFC) before they are stored.
    """
    # The JSON is parsed once a row.
    row, p = T.step(postings, _v=F.try_parse_json(T.nfc(F.col("posting")) if compose else F.col("posting"))), F.col("_v")
    # Its object is taken apart once as well.
    texts = lambda path, names, more="": F.try_variant_get(p, path, f"struct<{','.join(f'{x}:string' for x in names)}{more}>")
    row, get = T.step(row, _f=texts("$", FIELDS, ",baseSalary:variant"), _firm=texts("$.hiringOrganization", FIRM), _address=texts("$.jobLocation.address", ADDRESS)), of_fields(F.col("_f"))
    text, record, items = (lambda path: text_at(p, path, get)), (lambda path: record_at(p, path, get)), (lambda path: get(p, path))
    row = row.withColumns(dict(
        url=T.canonical_url(F.coalesce(F.nullif(text("$.url"), F.lit("")), F.col("page_url"))), title=T.normalize_whitespace(text("$.title")), _org=F.when(F.col("_firm").isNull() | F.col("_firm.logo").isNotNull(), record("$.hiringOrganization")), _full=T.html_to_text(text("$.description")),
        _only=only_location(F.col("_address"), street_first), posted_at=C.parse_date(text("$.datePosted")), expires_at=C.parse_date(text("$.validThrough"), True),
        _base=F.col("_f.baseSalary"), _experience=record("$.experienceRequirements"), company_name=F.coalesce(F.nullif(T.normalize_whitespace(F.coalesce(of_firm("name"), F.lit(""))), F.lit("")), F.lit(UNNAMED)),
    ))
    # Folded once a row: the title, the whole description, and its beginning where that is shorter. Plain ASCII has nothing to be folded but its case.
    folded = lambda c: F.lower(F.when(F.length(c) == F.octet_length(c), c).otherwise(T.remove_diacritics(c)))
    row = row.withColumns(dict(_title=folded(F.col("title")), _plain=folded(F.col("_full"))))
    row = row.withColumns(dict(_declared=S.parse_salary_json(F.col("_base")), locations=F.coalesce("_only", extract_locations(F.when(F.col("_address").isNull(), items("$.jobLocation")), street_first))))
    # What is written counts only where no public pay is declared.
    written = F.when(~F.coalesce("_declared.is_public", F.lit(False)), F.col("salary_text"))
    raws = F.transform("locations", lambda x: x.raw)
    row = row.withColumns(dict(_place=F.when(F.size("locations") == 1, F.get("locations", F.lit(0)).raw)))
    # Of one place its text is read as it is, of several each.
    district = F.coalesce(C.district_of(F.col("_place")), F.when(F.size("locations") > 1, C.first_district(raws)))
    schedule = C.parse_schedule(F.nullif(F.col("_full"), F.lit("")), folded=F.col("_plain"))
    row = row.withColumns(dict(
        external_id=F.coalesce(F.nullif(T.id_from_url(F.col("url"), id_pattern), F.lit("")), F.left(F.sha2("url", 256), F.lit(24))), title_norm=T.title_key(F.col("_title")), company_key=T.company_key(F.col("company_name")),
        description_text=F.nullif(T.truncate_bytes(F.col("_full"), DESCRIPTION_BYTES), F.lit("")), _telecommute=F.upper(text("$.jobLocationType")) == "TELECOMMUTE",
        _months=positive_number(F.get_json_object("_experience", "$.monthsOfExperience")),
    ))
    row = row.withColumns(dict(_written=S.parse_salary(written), district=district, schedule=schedule))
    plain_experience = F.when(F.col("_experience").isNull(), F.nullif(text("$.experienceRequirements"), F.lit("")))
    head = lambda n: F.when(F.length("_full") <= n, F.col("_plain")).otherwise(S.plain(F.left("description_text", F.lit(n))))
    # As folding the whole would give, each part being folded where it is not empty.
    asked = F.concat_ws(" ", F.when(F.col("title") != "", F.col("_title")), F.when(plain_experience.isNotNull() | F.col("_months").isNotNull(), F.nullif(S.plain(F.concat_ws(" ", plain_experience, years_text(F.col("_months")))), F.lit(""))), F.when(F.col("_full") != "", head(EXPERIENCE_LETTERS)))
    row = row.withColumns(dict(
        salary=F.when(F.col("_declared.is_public"), F.col("_declared")).when(F.col("_written.is_public"), F.col("_written")).otherwise(F.coalesce("_declared", S.hidden())),
        # The two lie apart, so that no word is found across them.
        _remote=F.coalesce("_telecommute", F.lit(False)) | C.remote_in(F.concat_ws("\n", "_title", head(MODE_LETTERS))), _years=T.let(asked, C.years_in),
    ))
    # Written out again only where it is asked for.
    salary_raw = F.when(F.col("_declared.is_public") | ~F.col("_written.is_public") & F.col("_declared").isNotNull(), F.left(F.to_json("_base"), F.lit(300))).otherwise(T.normalize_whitespace(F.col("salary_text")))
    problems = [
        F.when(F.col("title") == "", LACKS["title"]), F.when(F.col("company_name") == UNNAMED, LACKS["company"]), F.when(F.col("description_text").isNull(), LACKS["description"]), S.salary_problem(F.col("salary.out_of_range"), salary_raw),
        F.when(F.col("posted_at").isNull(), LACKS["posted"]), F.when((F.size("locations") == 0) & ~F.col("_remote"), LACKS["place"]),
    ]
    row = row.withColumns(dict(level=F.coalesce(C.level_named(F.col("_title")), C.level_from_years(F.col("_years.min"))), parse_error=F.nullif(F.concat_ws("; ", *problems), F.lit(""))))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    both = F.concat_ws(" ", "_title", "_plain")
    either_place = both.contains(HYBRID_WORDS[0]) | both.contains(HYBRID_WORDS[1])
    kind, listed = items("$.employmentType"), F.ltrim(items("$.employmentType")).startswith("[")
    made = {
        "external_id": F.col("external_id"), "url": F.col("url"), "title": F.col("title"), "title_norm": F.col("title_norm"), "company_name": F.col("company_name"), "company_key": F.col("company_key"),
        # The key is a match key already, and empty only where the name's is.
        "company_slug": F.coalesce(F.nullif(F.left(F.replace(F.col("company_key"), F.lit(" "), F.lit("-")), F.lit(120)), F.lit("")), F.lit(T.UNNAMED_SLUG)),
        "company_website": F.nullif(F.coalesce(F.nullif(of_firm("sameAs"), F.lit("")), of_firm("url")), F.lit("")), "company_logo_url": logo_of(F.col("_org")), "description_text": F.col("description_text"),
        "content_hash": F.sha2(F.concat_ws("|", "title", "company_key", F.coalesce("description_text", F.lit("")), number("salary.min"), number("salary.max")), 256), "salary": F.col("salary"), "salary_raw": salary_raw,
        "employment_type": C.employment_type(json_items(kind), F.when(~listed, kind)), "work_mode": F.coalesce("work_mode", F.when(F.col("_remote"), "REMOTE").when(either_place & is_hybrid(F.col("title"), F.col("description_text")), "HYBRID").otherwise("ONSITE")),
        "level": F.col("level"), "years_min": F.col("_years.min"), "years_max": F.col("_years.max"), "industry": industry_of(p, get), "district": F.col("district"), "saturday": F.col("schedule.saturday"), "schedule_raw": F.col("schedule.raw"),
        "posted_at": F.coalesce("posted_at", F.current_timestamp() if as_of is None else as_of), "expires_at": F.col("expires_at"), "locations": F.col("locations"), "skills": declared_skills(p, F.col("skills"), get),
        "parse_status": F.when(F.col("parse_error").isNull(), "OK").otherwise("PARTIAL"), "parse_error": F.col("parse_error"),
    }
    given = {"posting", "page_url", "salary_text", *made}
    return row.select(*[F.col(f"`{c}`") for c in postings.columns if c not in given], *[c.alias(name) for name, c in made.items()])
