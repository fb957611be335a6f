"""Provinces named in addresses, Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.classify import ADMIN_PREFIX
from jobloom.functions.text import let, match_key, normalize_whitespace, remove_diacritics

# Provinces since the merger of 2025 as slug -> (name, whether a city, other names and what was merged into it).
PROVINCES = {
    "ha-noi": ("Hà Nội", True, ["hn", "thu do", "hanoi"]),
    "ho-chi-minh": ("TP. Hồ Chí Minh", True, ["tphcm", "tp hcm", "hcm", "sai gon", "saigon", "ho chi minh city", "sg", "binh duong", "ba ria vung tau", "vung tau", "thu dau mot"]),
    "hai-phong": ("Hải Phòng", True, ["hp", "haiphong", "hai duong"]),
    "da-nang": ("Đà Nẵng", True, ["dn", "danang", "quang nam", "hoi an", "tam ky"]),
    "hue": ("Huế", True, ["thua thien hue"]),
    "can-tho": ("Cần Thơ", True, ["ct", "cantho", "soc trang", "hau giang"]),
    "tuyen-quang": ("Tuyên Quang", False, ["ha giang"]),
    "lao-cai": ("Lào Cai", False, ["yen bai", "sa pa", "sapa"]),
    "thai-nguyen": ("Thái Nguyên", False, ["bac kan", "bac can"]),
    "phu-tho": ("Phú Thọ", False, ["vinh phuc", "hoa binh", "viet tri"]),
    "bac-ninh": ("Bắc Ninh", False, ["bac giang", "tu son"]),
    "hung-yen": ("Hưng Yên", False, ["thai binh", "pho hien"]),
    "ninh-binh": ("Ninh Bình", False, ["ha nam", "nam dinh", "phu ly"]),
    "quang-tri": ("Quảng Trị", False, ["quang binh", "dong hoi"]),
    "quang-ngai": ("Quảng Ngãi", False, ["kon tum"]),
    "gia-lai": ("Gia Lai", False, ["binh dinh", "quy nhon", "pleiku"]),
    "khanh-hoa": ("Khánh Hòa", False, ["ninh thuan", "nha trang", "cam ranh"]),
    "lam-dong": ("Lâm Đồng", False, ["dak nong", "dac nong", "binh thuan", "da lat", "dalat", "phan thiet"]),
    "dak-lak": ("Đắk Lắk", False, ["dac lac", "phu yen", "buon ma thuot", "tuy hoa"]),
    "dong-nai": ("Đồng Nai", False, ["binh phuoc", "bien hoa", "long thanh"]),
    "tay-ninh": ("Tây Ninh", False, ["long an", "tan an"]),
    "vinh-long": ("Vĩnh Long", False, ["ben tre", "tra vinh"]),
    "dong-thap": ("Đồng Tháp", False, ["tien giang", "my tho", "cao lanh"]),
    "ca-mau": ("Cà Mau", False, ["bac lieu"]),
    "an-giang": ("An Giang", False, ["kien giang", "rach gia", "phu quoc", "long xuyen"]),
    "cao-bang": ("Cao Bằng", False, []),
    "lang-son": ("Lạng Sơn", False, []),
    "dien-bien": ("Điện Biên", False, ["dien bien phu"]),
    "lai-chau": ("Lai Châu", False, []),
    "son-la": ("Sơn La", False, ["moc chau"]),
    "thanh-hoa": ("Thanh Hóa", False, ["sam son", "nghi son"]),
    "nghe-an": ("Nghệ An", False, ["vinh", "cua lo"]),
    "ha-tinh": ("Hà Tĩnh", False, ["vung ang"]),
    "quang-ninh": ("Quảng Ninh", False, ["ha long", "cam pha", "mong cai"]),
}
#: Names shorter than this count only as a whole address.
LEAST_INSIDE = 4
# What stands in a part of an address that nobody filled in.
JUNK = ["not available", "n/a", "na", "null", "undefined", "khong xac dinh", "chua cap nhat", "-"]


def aliases() -> list[tuple[str, str]]:
    """(name in ASCII, slug) of every spelling: the slug's words, the name where it differs, then the others."""
    out: dict[str, str] = {}
    for slug, (_, _, others) in PROVINCES.items():
        own = slug.replace("-", " ")
        # The one name that isn't its slug's words.
        for name in ([f"tp {own}"] if slug == "ho-chi-minh" else []) + [own, *others]:
            out[name] = slug
    return list(out.items())


def resolve_province(c: Column) -> Column:
    """The slug of the province that an address names: as a whole, after an administrative prefix, else the longest name inside; null for none."""
    known = F.create_map(*[F.lit(x) for kv in aliases() for x in kv])
    inside = F.array(*[F.lit(name) for name, _ in sorted(aliases(), key=lambda x: -len(x[0])) if len(name) >= LEAST_INSIDE])

    def of(key: Column) -> Column:
        longest = F.try_element_at(F.filter(inside, lambda name: key.contains(name)), F.lit(1))
        return F.coalesce(*[F.try_element_at(known, x) for x in (key, F.trim(F.regexp_replace(key, ADMIN_PREFIX, "")), longest)])

    return let(match_key(c), of)


def _given(part: Column) -> Column:
    """A part of an address, '' where it is missing or junk."""
    return let(F.trim(F.coalesce(part, F.lit(""))), lambda x: F.when((x != "") & F.lower(remove_diacritics(x)).isin(*JUNK), F.lit("")).otherwise(x))


#: The parts of an address that are read.
ADDRESS = {"streetAddress": "street", "addressLocality": "locality", "addressRegion": "region"}


def _tries(x: Column, combined: Column, street_first: bool) -> list[Column]:
    """The texts to look for a province in, in order, of an address (street, locality, region)."""
    return [x.street, combined, x.region, x.locality] if street_first else [x.region, x.locality, combined]


def _combined(x: Column) -> Column:
    return F.concat_ws(", ", *[F.when(x[name] != "", x[name]) for name in ADDRESS.values()])


def _place(item: Column, street_first: bool) -> Column:
    """struct(raw, tries) of one declared place, a JSON text: what names it, and the texts to look for a province in, in order."""

    def of(x: Column) -> Column:
        return let(_combined(x), lambda combined: F.struct(combined.alias("raw"), F.array(*_tries(x, combined, street_first)).alias("tries")))

    parts = lambda address: F.struct(*[_given(F.get_json_object(address, f"$.{k}")).alias(name) for k, name in ADDRESS.items()])
    alone = lambda t: let(F.coalesce(t, F.lit("")), lambda v: F.struct(v.alias("raw"), F.array(v).alias("tries")))
    placed = lambda address: F.when(F.ltrim(address).startswith("{"), let(parts(address), of)).when(F.ltrim(item).startswith("{"), alone(F.get_json_object(item, "$.name"))).otherwise(alone(item))
    return let(F.get_json_object(item, "$.address"), placed)


def json_items(c: Column) -> Column:
    """The elements of a JSON array as texts, those of arrays within it in their place; anything else as the only one."""
    each = lambda x: F.when(F.ltrim(x).startswith("["), F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(x))
    return let(c, lambda x: F.when(F.ltrim(x).startswith("["), F.flatten(F.transform(each(x), each))).otherwise(F.array(x)))


_NOWHERE = "array<struct<raw:string,slug:string>>"


def only_location(address: Column, street_first: bool) -> Column:
    """`extract_locations` of a posting with one place, whose address (a struct of ADDRESS) is taken apart already; null without one."""

    def of(x: Column) -> Column:
        return let(_combined(x), lambda combined: let(normalize_whitespace(combined), lambda raw: named(_tries(x, combined, street_first), raw)))

    def named(tries: list[Column], raw: Column) -> Column:
        return F.when(raw != "", F.array(F.struct(raw.alias("raw"), _first_province(F.array(*tries)).alias("slug")))).otherwise(F.array().cast(_NOWHERE))

    clean = F.transform(F.array(*[address[k] for k in ADDRESS]), lambda x: _given(x))
    parts = let(clean, lambda xs: F.struct(*[F.get(xs, F.lit(i)).alias(name) for i, name in enumerate(ADDRESS.values())]))
    return F.when(address.isNotNull(), let(parts, of))


def _first_province(tries: Column) -> Column:
    """The province that the first text names, else the next: a text is looked at only if those before it name none."""
    return F.aggregate(tries, F.lit(None).cast("string"), lambda found, t: F.coalesce(found, F.when(t != "", resolve_province(t))))


def extract_locations(job_location: Column, street_first: bool = False) -> Column:
    """array<struct(raw, slug)> of a posting's declared places, each text once in order; slug is the province or null."""
    places = F.transform(F.filter(json_items(job_location), lambda x: x.isNotNull()), lambda x: _place(x, street_first))
    spaced = F.transform(places, lambda p: F.struct(normalize_whitespace(p.raw).alias("raw"), p.tries.alias("tries")))

    def once(all_: Column) -> Column:
        named = F.filter(all_, lambda p: p.raw != "")
        return let(named, lambda ps: F.filter(ps, lambda p, i: F.array_position(F.transform(ps, lambda q: q.raw), p.raw) == i + 1))

    return F.coalesce(F.transform(let(spaced, once), lambda p: F.struct(p.raw.alias("raw"), _first_province(p.tries).alias("slug"))), F.array().cast(_NOWHERE))
