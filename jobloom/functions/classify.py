"""Level, experience, place, schedule, dates, and dictionary matching, Column -> Column."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.salary import plain
from jobloom.functions.text import either, fold, let, match_key, normalize_whitespace, tech_key

# Words in titles, from high levels to low.
LEVEL_WORDS = {
    "MANAGER": ["manager", "quan ly", "truong phong", "giam doc", "director", "head of", "chief", "cto", "ceo", "cfo", "truong bo phan", "pho phong"],
    "LEAD": ["team lead", "tech lead", "teamlead", "techlead", "leader", "truong nhom", "to truong", "principal", "architect", "chu tri"],
    "SENIOR": ["senior", "sr ", "cao cap", "chuyen gia", "expert", "chuyen vien cao cap"],
    "JUNIOR": ["junior", "jr ", "moi ra truong", "it kinh nghiem"],
    "FRESHER": ["fresher", "entry level", "entry-level", "khong yeu cau kinh nghiem", "chua co kinh nghiem"],
    "INTERN": ["intern", "internship", "thuc tap", "ttv", "tap su", "trainee", "hoc viec"],
}
ROLES_NOT_MANAGING = ["project manager", "product manager", "product owner", "account manager", "community manager", "brand manager", "quan ly du an", "quan ly san pham"]
LEVEL_ORDER = ["INTERN", "FRESHER", "JUNIOR", "MID", "SENIOR", "LEAD", "MANAGER"]


# How experience is written in folded text.
YEAR_WORDS, SPAN_WORDS = ["nam", "year"], ["-", "–", "den", "to"]
AT_LEAST = ["it nhat", "tren", "tu", "toi thieu", "+", "minimum", "at least"]
NO_EXPERIENCE = ["khong yeu cau kinh nghiem", "chua co kinh nghiem", "no experience"]
#: A single number above this isn't years of experience.
MOST_YEARS = 40


def years_of_experience(c: Column) -> Column:
    """struct(min, max) in years: none asked for is 0 to 0, a range is put in order, one number is open if a minimum is spoken of."""
    return let(plain(c), years_in)


def years_in(text: Column) -> Column:
    """`years_of_experience` of a text that is folded already. A pattern is looked for only where what it begins or ends with is there."""
    unit, span = either(YEAR_WORDS), either(SPAN_WORDS)
    holds = lambda words: reduce(or_, [text.contains(w) for w in words])
    number = lambda found, pattern, k: F.nullif(F.regexp_extract(found, pattern, k), F.lit("")).cast("int")
    one, pair = rf"(\d{{1,2}})\s*\+?\s*{unit}", rf"(\d{{1,2}})\s*{span}\s*(\d{{1,2}})\s*{unit}"
    told = lambda low, high: F.struct(low.cast("int").alias("min"), high.cast("int").alias("max"))
    none = F.lit(None).cast("int")

    def single(n: Column) -> Column:
        return told(F.when(n <= MOST_YEARS, n), F.when((n <= MOST_YEARS) & ~holds(AT_LEAST), n))

    def of_pair(x: Column) -> Column:
        return F.when(x.a.isNotNull(), told(F.least(x.a, x.b), F.greatest(x.a, x.b))).otherwise(let(F.when(x.a.isNull() & holds(YEAR_WORDS), number(text, one, 1)), single))

    # Of a pair both numbers are read in the few letters where it stands.
    both = lambda found: F.when(found != "", F.struct(number(found, pair, 1).alias("a"), number(found, pair, 2).alias("b")))
    return F.when(holds(NO_EXPERIENCE), told(F.lit(0), F.lit(0))).when(holds(YEAR_WORDS), let(let(F.when(holds(YEAR_WORDS), F.regexp_extract(text, pair, 0)), both), of_pair)).otherwise(told(none, none))


def level_from_years(n: Column) -> Column:
    return F.when(n == 0, "FRESHER").when(n < 2, "JUNIOR").when(n < 5, "MID").when(n.isNotNull(), "SENIOR")


def infer_level(title: Column, experience: Column) -> Column:
    """The first level whose words a title holds (as substrings, so that they also hit inside words), else by years."""
    return F.coalesce(let(plain(title), level_named), let(years_of_experience(F.concat_ws(" ", title, experience)).min, level_from_years))


def level_named(text: Column) -> Column:
    """The level that a title says, folded already. One that holds no word of any level, as most do, is looked through once."""
    role = text.rlike(either(ROLES_NOT_MANAGING))
    level = F.coalesce(*[F.when(text.rlike(either(words)) & (~role if level == "MANAGER" else F.lit(True)), F.lit(level)) for level, words in LEVEL_WORDS.items()])
    return F.when(text.rlike(either([w for words in LEVEL_WORDS.values() for w in words])), level)


# Named areas, and the numbered districts that still exist.
AREAS = {
    "binh thanh": "Bình Thạnh", "tan binh": "Tân Bình", "tan phu": "Tân Phú", "phu nhuan": "Phú Nhuận", "go vap": "Gò Vấp", "binh tan": "Bình Tân", "thu duc": "Thủ Đức", "binh chanh": "Bình Chánh", "hoc mon": "Hóc Môn", "cu chi": "Củ Chi",
    "nha be": "Nhà Bè", "can gio": "Cần Giờ", "thu dau mot": "Thủ Dầu Một", "di an": "Dĩ An", "thuan an": "Thuận An", "ben cat": "Bến Cát", "tan uyen": "Tân Uyên", "vung tau": "Vũng Tàu", "ba ria": "Bà Rịa", "phu my": "Phú Mỹ",
}
NUMBERED = [1, 3, 4, 5, 6, 7, 8, 10, 11, 12]
MERGED = ["binh duong", "ba ria", "vung tau", "thu dau mot", "di an", "ben cat"]
ADMIN_PREFIX = r"^(thanh pho|tp|tinh|quan|huyen|phuong|xa|thi xa|thi tran|khu vuc|kv)\s+"


# How a numbered district and an industrial zone are called, in folded text.
DISTRICT_WORDS = ["quan", "district", "q.", "q"]
ZONES_BEFORE, ZONES_AFTER = ["kcn", "kcx", "khu cong nghiep", "khu che xuat"], ["industrial park"]
#: Letters in the name of a zone, at least and at most.
ZONE_NAME = (2, 24)


def zone_name(part: Column) -> Column:
    """The name of the industrial zone in a part of an address, as written: all that follows the word for it, or the last words before; else null."""
    low, high = ZONE_NAME
    name = rf"[a-z0-9\p{{M}} ]{{{low},{high}}}"

    def cut(folded: Column) -> Column:
        behind = F.length(F.regexp_extract(folded, rf"\b{either(ZONES_BEFORE)} ({name})$", 1))
        head = F.split(folded, rf" {either(ZONES_AFTER)}\b", 2)
        ahead = F.length(F.regexp_extract(head[0], rf"\b({name})$", 1))
        return F.when(behind > 0, F.right(part, behind)).when((F.size(head) > 1) & (ahead > 0), F.substring(part, F.length(head[0]) - ahead + 1, ahead))

    return let(fold(part), cut)


def district_of(raw: Column) -> Column:
    """The named area that stands first, else a numbered district, else an industrial zone, else null."""
    known = F.create_map(*[F.lit(x) for kv in AREAS.items() for x in kv])
    titled = lambda x: F.array_join(F.transform(F.split(F.trim(x), " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1000))), " ")

    def named(text: Column) -> Column:
        number = F.nullif(F.regexp_extract(text, rf"\b{either(DISTRICT_WORDS)}\s*(\d{{1,2}})\b", 1), F.lit("")).cast("int")
        return F.coalesce(F.try_element_at(known, F.regexp_extract(text, rf"\b{either(list(AREAS))}\b", 0)), let(number, lambda n: F.when(n.isin(NUMBERED), F.concat(F.lit("Quận "), n.cast("string")))))

    zones = F.filter(F.transform(F.split(normalize_whitespace(raw), "[,.;]"), lambda x: zone_name(F.trim(x))), lambda x: x.isNotNull())
    return F.coalesce(let(plain(raw), named), let(F.try_element_at(zones, F.lit(1)), lambda x: F.concat(F.lit("KCN "), titled(x))))


def first_district(raws: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(raws, lambda x: district_of(x)), lambda x: x.isNotNull()), F.lit(1))


def is_narrow(raws: Column) -> Column:
    """Whether some place lies outside the areas that were merged into the city; false for no places."""
    inside = lambda x: match_key(x).rlike("|".join(MERGED))
    return (F.size(raws) > 0) & ~F.forall(raws, inside)


def is_remote(c: Column) -> Column:
    return remote_in(plain(c))


def remote_in(text: Column) -> Column:
    """`is_remote` of a text that is folded already."""
    return text.rlike(r"\b(remote|tu xa|lam viec tai nha|work from home|wfh|telecommute)\b")


def location_slugs(slugs: Column, work_mode: Column) -> Column:
    known = F.array_distinct(F.array_compact(slugs))
    return F.when((F.size(known) == 0) & (work_mode == "REMOTE"), F.array(F.lit("remote"))).otherwise(known)


# Rules on Saturdays, the first that fits holds.
_DAY = r"(?:\bth[uw]\s*|\bt\s*\.?\s*)"
_MON, _FRI, _SAT = rf"(?:{_DAY}2|\bthu hai\b)", rf"(?:{_DAY}6|\bthu sau\b)", rf"(?:{_DAY}7|\bthu bay\b)"
_TO = r"\s*(?:-|–|—|>|den|toi|to|~)\s*"
SATURDAY = {
    "ALTERNATE": rf"(?:{_SAT}[^.;]{{0,40}}(?:luan phien|cach tuan|xen ke|\d\s*(?:lan|buoi)?\s*/\s*thang))|(?:(?:luan phien|cach tuan|xen ke)[^.;]{{0,40}}{_SAT})",
    "HALF_DAY": rf"(?:sang\s*{_SAT})|(?:{_SAT}[^.;]{{0,30}}(?:nua ngay|buoi sang|den\s*1[12]\s*h|-\s*1[12]\s*h|8h\s*-\s*12))",
    "NONE": rf"(?:{_MON}{_TO}{_FRI})|(?:(?:nghi|off|duoc nghi)[^.;]{{0,25}}{_SAT})",
    "FULL": rf"(?:{_MON}{_TO}{_SAT})|(?:lam\s*(?:ca|luon)\s*{_SAT})",
}
SATURDAY_NEEDS = ["7", "6", "thu bay", "thu sau", "saturday"]
#: A day as any rule or mention has it: none of them fits without it.
SOME_DAY = r"\bt(?:h[uw])?\s*\.?\s*[67]|\bthu (?:bay|sau)\b|saturday"
# What working time is called, in folded text, and how many letters before and after a mention are kept.
TIME_WORDS = ["thoi gian lam viec", "gio lam viec", "ngay lam viec", *(f"working {x}" for x in ("time", "hour", "hours", "day", "days")), "thu 7", "thu7"]
LETTERS_BEFORE, LETTERS_AFTER = 60, 110


def schedule_excerpt(c: Column, longest: int = 200) -> Column:
    """The words around a mention of working time, cut; null without one.

    It begins LETTERS_BEFORE letters before the first mention. It ends LETTERS_AFTER letters behind that one or, if that stands
    so near the text's start that there are fewer letters before it, behind the last that does.
    """
    mention = rf"(?:{either(TIME_WORDS)}|t7\b)"

    def found(text: Column) -> Column:
        folded = fold(text)
        return F.struct(text.alias("text"), F.regexp_extract(folded, rf"^.{{0,{LETTERS_BEFORE}}}{mention}", 0).alias("near"), F.split(folded, mention, 2).alias("parts"))

    def around(x: Column) -> Column:
        begin = F.when(x.near != "", F.lit(0)).otherwise(F.length(x.parts[0]) - LETTERS_BEFORE)
        end = F.when(x.near != "", F.length(x.near)).otherwise(F.length(x.text) - F.length(x.parts[1]))
        return F.when(F.size(x.parts) > 1, F.trim(F.substring(x.text, begin + 1, end - begin + LETTERS_AFTER)))

    words = let(let(normalize_whitespace(c), found), around)
    return let(words, lambda x: F.when(F.length(x) > longest, F.concat(F.left(x, F.lit(longest - 1)), F.lit("…"))).otherwise(x))


def parse_schedule(c: Column, longest: int = 200, folded: Column | None = None) -> Column:
    """struct(saturday, raw): the first rule that fits, and the words around; a mention that fits none keeps the words. `folded` is what `plain` makes of the text, where that is there already."""

    def read(text: Column) -> Column:
        # No rule and no mention goes without one of these, so that most texts are not searched by patterns.
        some = reduce(or_, [text.contains(w) for w in SATURDAY_NEEDS]) & text.rlike(SOME_DAY)
        return let(F.when(some, text), rules)

    def rules(text: Column) -> Column:
        kind = F.coalesce(*[F.when(text.rlike(r), F.lit(k)) for k, r in SATURDAY.items()])
        return F.struct(kind.alias("kind"), F.coalesce(text.rlike(r"\bthu\s*7\b|\bt7\b|saturday"), F.lit(False)).alias("said"))

    return let(let(plain(c) if folded is None else folded, read), lambda x: F.struct(x.kind.alias("saturday"), F.when(x.kind.isNotNull() | x.said, schedule_excerpt(c, longest)).alias("raw")))


def parse_date(c: Column, end_of_day: bool = False) -> Column:
    """d-m-Y and d/m/Y day first, bare ISO days at +07:00 (start or end of day), other ISO instants; years 2000 to 2100, else null."""
    text, day_first = F.trim(c), r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})"
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).when(text.rlike(day_first), F.regexp_replace(text, rf"(?s){day_first}.*$", "$3-$2-$1"))

    def instant(day: Column) -> Column:
        whole = F.try_to_timestamp(F.concat(day, F.lit(" 23:59:59+07:00" if end_of_day else " 00:00:00+07:00")), F.lit("yyyy-M-d HH:mm:ssXXX"))
        return F.when(day.isNotNull(), whole).when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), text.try_cast("timestamp"))

    return let(let(day, instant), lambda x: F.when(F.year(x).between(2000, 2100), x))


# Kinds of employment as sources write them.
EMPLOYMENT = {"FULL_TIME": "FULL_TIME", "FULLTIME": "FULL_TIME", "PART_TIME": "PART_TIME", "PARTTIME": "PART_TIME", "CONTRACTOR": "CONTRACT", "CONTRACT": "CONTRACT", "TEMPORARY": "TEMPORARY", "INTERN": "INTERNSHIP", "INTERNSHIP": "INTERNSHIP", "OTHER": "OTHER"}


def employment_type(values: Column, one: Column | None = None) -> Column:
    """The first item that is known, after quotes are cut and words joined. Where there is but `one`, it may be given as a text."""
    key = lambda x: F.upper(F.regexp_replace(F.trim(F.regexp_replace(x, "[\"']", "")), r"[\s-]+", "_"))
    known = F.create_map(*[F.lit(x) for kv in EMPLOYMENT.items() for x in kv])
    first = F.try_element_at(F.filter(F.transform(values, lambda x: F.try_element_at(known, key(x))), lambda x: x.isNotNull()), F.lit(1))
    return first if one is None else F.when(one.isNotNull(), F.try_element_at(known, key(one))).otherwise(first)


def terms_hit(key: Column, terms: list[str], tech: bool = False) -> Column:
    """The terms that begin at a word's start in a match key, in order. Terms are folded as Spark folds text."""
    if not terms:
        return F.array().cast("array<string>")
    fold = tech_key if tech else match_key
    return let(F.concat(F.lit(" "), key), lambda k: F.array_compact(F.array(*[F.when(k.contains(F.concat(F.lit(" "), fold(F.lit(t)))), F.lit(t)) for t in terms])))


def match_field(title: Column, description: Column, strong: list[str], gray: list[str] = (), excludes: list[str] = (), tech: bool = False) -> Column:
    """struct(verdict, score, title_hits, desc_hits, gray_hits, rejected_by) of a posting against a dictionary."""
    fold = tech_key if tech else match_key

    def hits(key: Column) -> Column:
        t, d = key.t, key.d
        return F.struct(
            F.try_element_at(terms_hit(t, list(excludes), tech), F.lit(1)).alias("blocked"), terms_hit(t, list(strong), tech).alias("th"), terms_hit(d, list(strong), tech).alias("dh"),
            F.array_distinct(F.concat(terms_hit(t, list(gray), tech), terms_hit(d, list(gray), tech))).alias("gh"),
        )

    def judged(x: Column) -> Column:
        verdict = F.when(x.blocked.isNotNull(), "reject").when(F.size(x.th) > 0, "strong").when(F.size(x.dh) >= 2, "weak").otherwise("reject")
        return F.struct(verdict.alias("verdict"), x.blocked.alias("blocked"), x.th.alias("th"), x.dh.alias("dh"), x.gh.alias("gh"))

    def scored(x: Column) -> Column:
        some = F.least(F.size(x.dh), F.lit(5))
        score = F.when(x.verdict == "strong", F.size(x.th) * 10 + F.size(x.gh) * 2 + some).when(x.verdict == "weak", some).otherwise(0)
        none = F.array().cast("array<string>")
        return F.struct(x.verdict.alias("verdict"), score.cast("int").alias("score"), F.when(x.verdict == "strong", x.th).otherwise(none).alias("title_hits"), F.when(x.blocked.isNull(), x.dh).otherwise(none).alias("desc_hits"), F.when(x.verdict == "strong", x.gh).otherwise(none).alias("gray_hits"), x.blocked.alias("rejected_by"))

    keys = F.struct(fold(title).alias("t"), fold(F.coalesce(description, F.lit(""))).alias("d"))
    return let(let(let(keys, hits), judged), scored)


def match_skills(text: Column, catalogue: dict[str, list[str]]) -> Column:
    """Slugs whose aliases stand as whole words in the text's tech key, in the catalogue's order."""

    def found(key: Column) -> Column:
        hit = lambda aliases: F.greatest(F.lit(False), F.lit(False), *[key.contains(F.concat(F.lit(" "), tech_key(F.lit(a)), F.lit(" "))) for a in aliases])
        return F.array_compact(F.array(*[F.when(hit(aliases), F.lit(slug)) for slug, aliases in catalogue.items()]))

    return let(F.concat(F.lit(" "), tech_key(text), F.lit(" ")), found)


def experience_band(years: Column) -> Column:
    return F.when(years < 1, "0").when(years <= 2, "1-2").when(years <= 5, "3-5").when(years > 5, "5+").otherwise("__none")


def salary_band(value: Column) -> Column:
    return F.when(value < 15_000_000, "0-15").when(value < 25_000_000, "15-25").when(value < 40_000_000, "25-40").when(value.isNotNull(), "40+").otherwise("__none")


EXPERIENCE_BANDS, SALARY_BANDS = ["0", "1-2", "3-5", "5+", "__none"], ["0-15", "15-25", "25-40", "40+", "__none"]


# Skills by the part of a product that they build, and title words.
NET, REACT, OTHER_FRONT = ["dotnet", "aspnet", "csharp"], ["react"], ["angular", "vue"]
OTHER_BACK = ["java", "spring", "php", "laravel", "golang", "python", "django", "ruby", "nodejs", "kotlin", "cpp"]
MOBILE, CLOUD = ["flutter", "reactnative", "ios", "android"], ["docker", "kubernetes"]
CLOUD_TITLES = ["devops", "sre", "platform engineer", "cloud engineer", "site reliability"]


def main_skills(title_skills: Column, declared: Column, text_skills: Column) -> Column:
    """Skills that say what a posting is about: those of its title and those it declares; all that its text names only if there are none."""
    main = F.array_union(F.coalesce(title_skills, F.array().cast("array<string>")), F.coalesce(declared, F.array().cast("array<string>")))
    return let(main, lambda m: F.when(F.size(m) > 0, m).otherwise(F.coalesce(text_skills, m)))


def software_role(title: Column, skills: Column) -> Column:
    """The role that a posting's main skills and title words make: what builds both ends, then .NET, then one end, then the machines."""

    def role(x: Column) -> Column:
        has = lambda *groups: F.arrays_overlap(x.skills, F.array(*[F.lit(s) for g in groups for s in g]))
        titled = lambda *words: x.key.rlike(f" (?:{'|'.join(words)}) ")
        full = titled("full ?stack")
        rules = [
            (has(NET) & (has(REACT) | full), "dotnet-fullstack"), (has(NET), "dotnet-backend"), (has(MOBILE) & ~has(REACT), "mobile"), (full | has(REACT, OTHER_FRONT) & has(OTHER_BACK), "fullstack-khac"), (has(REACT), "react-frontend"),
            (has(OTHER_FRONT), "frontend-khac"), (has(OTHER_BACK) | titled("back ?end"), "backend-khac"), (titled("front ?end"), "frontend-khac"), (titled(*CLOUD_TITLES) | has(CLOUD), "devops"),
        ]
        return F.coalesce(*[F.when(fits, F.lit(slug)) for fits, slug in rules], F.lit("chua-ro"))

    return let(F.struct(F.concat(F.lit(" "), tech_key(title), F.lit(" ")).alias("key"), skills.alias("skills")), role)


def purchase_type(industry: Column, title: Column, description: Column, types: list[tuple[str, list[str], list[str]]], noise: list[str] = (), unknown: str = "chua-ro") -> Column:
    """struct(slug, basis): the first type with an industry key in a declared token, else with a keyword in the text."""
    tokens = F.filter(F.transform(F.split(F.coalesce(industry, F.lit("")), ","), match_key), lambda x: (x != "") & (~x.isin(*noise) if noise else F.lit(True)))
    text = F.concat(F.lit(" "), match_key(F.concat_ws(" ", title, description)))
    any_of = lambda tests: F.greatest(F.lit(False), F.lit(False), *tests)

    def found(x: Column) -> Column:
        declared = lambda keys: F.exists(x.tokens, lambda t: any_of([t.contains(match_key(F.lit(k))) for k in keys]))
        spoken = lambda words: any_of([x.text.contains(F.concat(F.lit(" "), match_key(F.lit(k)))) for k in words])
        return F.struct(F.coalesce(*[F.when(declared(keys), F.lit(slug)) for slug, keys, _ in types]).alias("a"), F.coalesce(*[F.when(spoken(words), F.lit(slug)) for slug, _, words in types]).alias("b"))

    pick = lambda x: F.struct(F.coalesce(x.a, x.b, F.lit(unknown)).alias("slug"), F.when(x.a.isNotNull(), "industry").when(x.b.isNotNull(), "keyword").otherwise("none").alias("basis"))
    return let(let(F.struct(tokens.alias("tokens"), text.alias("text")), found), pick)


def experience_label(low: Column, high: Column) -> Column:
    """Years asked for, as a range; null where nothing is."""
    text = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])
    return F.when(low != high, text(low, "–", high, " năm KN")).when(low.isNotNull(), text(low, "+ năm KN")).when(high.isNotNull(), text("tới ", high, " năm KN"))


def catalogue_of(rows: DataFrame) -> DataFrame:
    """(slug, name, aliases) of a table (slug, name, alias): a skill for each slug, its aliases once each and in order."""
    return rows.groupBy("slug").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("alias")).alias("aliases"))
