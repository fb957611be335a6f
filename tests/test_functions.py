"""Scalar functions on case tables of our own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobloom.functions import classify as C
from jobloom.functions import salary as S
from jobloom.functions import text as T
from jobloom.sources import records as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, key",
    [("Kỹ sư  C#/.NET", "ky su csharp dotnet"), ("C++ & F#", "cpp fsharp"), ("xem example.net", "xem example net"), ("React Native / ReactJS", "reactnative reactjs react"), ("CI / CD", "cicd"), ("", "")],
)
def test_tech_key(spark, text, key):
    assert one(spark, T.tech_key(F.lit(text))) == key


@pytest.mark.parametrize("text, n", [("1.000", 1000), ("1,5", 1.5), ("12.345.678", 12345678), ("1.234,56", 1234.56), ("15", 15), ("x", None), ("", None)])
def test_parse_number(spark, text, n):
    assert one(spark, S.parse_number(F.lit(text))) == n


@pytest.mark.parametrize(
    "text, low, high, public, out",
    [
        ("10 - 20 triệu", 10_000_000, 20_000_000, True, False), ("Từ 15tr", 15_000_000, None, True, False), ("Lên đến 30 triệu", None, 30_000_000, True, False), ("1.000 - 2.000 USD", 25_400_000, 50_800_000, True, False),
        ("Cạnh tranh", None, None, False, False), (None, None, None, False, False), ("500k/giờ", 88_000_000, 88_000_000, True, False), ("240 triệu/năm", 20_000_000, 20_000_000, True, False), ("5", None, None, False, True), ("20 - 10 triệu", 10_000_000, 20_000_000, True, False),
    ],
)
def test_salary(spark, text, low, high, public, out):
    r = one(spark, S.parse_salary(F.lit(text).cast("string")))
    assert (r["min"], r["max"], r.is_public, r.out_of_range) == (low, high, public, out)


def test_bands_cover_all_years(spark):
    rows = spark.range(41).select(F.col("id").alias("y"), C.experience_band(F.col("id")).alias("b")).collect()
    assert {r.b for r in rows} == {"0", "1-2", "3-5", "5+"}
    assert all((r.b == "0") == (r.y < 1) and (r.b == "5+") == (r.y > 5) for r in rows)


@pytest.mark.parametrize(
    "text, day",
    [("05/08/2026", "2026-08-05"), ("2026-08-05", "2026-08-05"), ("31-02-2026", None), ("1999-01-01", None), ("bald", None)],
)
def test_dates(spark, text, day):
    at = one(spark, F.date_format(C.parse_date(F.lit(text)) + F.expr("interval 7 hours"), "yyyy-MM-dd"))
    assert at == day


def test_truncate_bytes_never_cuts_a_letter(spark):
    for n in range(12):
        x = one(spark, T.truncate_bytes(F.lit("aé漢😀b"), n))
        assert "aé漢😀b".startswith(x) and len(x.encode()) <= n and len("aé漢😀b"[: len(x) + 1].encode()) > n or x == "aé漢😀b"


def test_location_slugs(spark):
    assert one(spark, C.location_slugs(F.array(F.lit("a"), F.lit(None), F.lit("a")), F.lit("REMOTE"))) == ["a"]
    assert one(spark, C.location_slugs(F.array().cast("array<string>"), F.lit("REMOTE"))) == ["remote"]


def test_company_key(spark):
    assert one(spark, T.company_key(F.lit("CÔNG TY TNHH MTV An Phú Việt Nam"))) == "an phu"
    assert one(spark, T.company_key(F.lit("Công ty"))) == "cong ty"


def test_id_from_url(spark):
    assert one(spark, T.id_from_url(F.lit("https://x.y/a/b-123.html"), r"-(\d+)\.html")) == "123"
    assert one(spark, T.id_from_url(F.lit("https://x.y/a/b/"), None)) == "b"


@pytest.mark.parametrize(
    "base, low, high, public",
    [
        ('{"currency":"VND","value":{"minValue":20000000,"maxValue":"30.000.000","unitText":"MONTH"}}', 20_000_000, 30_000_000, True),
        ('{"currency":"USD","value":{"value":"30,000,000 - 50,000,000đ"}}', 30_000_000, 50_000_000, True),
        ('{"currency":"usd","value":1000}', 25_400_000, 25_400_000, True),
        ('{"value":{"value":240000000,"unitText":"year"}}', 20_000_000, 20_000_000, True),
        ('{"value":{"value":"Negotiable"}}', None, None, None),
        ('{"value":{"minValue":1,"maxValue":2}}', None, None, False),
        ('"10 - 20 triệu"', 10_000_000, 20_000_000, True),
        ('"Thoả thuận"', None, None, None),
        ("{}", None, None, None),
    ],
)
def test_declared_salary(spark, base, low, high, public):
    r = one(spark, S.parse_salary_json(F.parse_json(F.lit(base))))
    assert (r and r["min"], r and r["max"], r and r.is_public) == (low, high, public)


@pytest.mark.parametrize("raw, low, public", [('{"value":{"minValue":20000000}}', 20_000_000, True), ('{"value":{"minVal', None, None), ("Từ 15tr", 15_000_000, True), ("", None, None), (None, None, None), ("{}", None, False)])
def test_salary_read_again(spark, raw, low, public):
    r = one(spark, S.salary_from_raw(F.lit(raw).cast("string")))
    assert (r and r["min"], r and r.is_public) == (low, public)


def test_nfc(spark):
    """Marks in any order, letters with another form, Hangul; texts that are composed already, empty and null ones."""
    import unicodedata

    texts = ["a\u0323\u0302", "a\u0302\u0323", "Vie\u0323\u0302t Nam", "Việt Nam đã", "\u212b \u2126 \u0344", "\u1112\u1161\u11ab", "plain", "", None, "\u0301x", "漢字 \uf900", "e\u0301" * 1000]
    got = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.nfc(F.col("t")).alias("x")).orderBy("k").collect()]
    assert got == [x and unicodedata.normalize("NFC", x) for x in texts]
    every = "".join(f"a{chr(k)} " for k in range(0x80, 0x3400)) + "".join(f"{chr(k)} " for k in range(0xF900, 0xFB50))
    parts = [every[i : i + 3] for i in range(0, len(every), 3)]
    rows = spark.createDataFrame([(x,) for x in parts], "t string").select("t", T.nfc(F.col("t")).alias("x")).collect()
    assert all(r.x == unicodedata.normalize("NFC", r.t) for r in rows)


def test_normalize_composes(spark):
    from jobloom.operators.normalize import normalize

    rows = [('{"title":"Ke\u0302\u0301 toa\u0301n","hiringOrganization":{"name":"A"}}', None, None, None, None)]
    df = spark.createDataFrame(rows, "posting string, page_url string, salary_text string, skills array<string>, work_mode string")
    as_of = F.lit("2026-01-01").cast("timestamp")
    assert [normalize(df, as_of=as_of, compose=c).first().title for c in (True, False)] == ["Kế toán", "Ke\u0302\u0301 toa\u0301n"]


def test_labels_in_pasted_texts(spark):
    texts = [
        "Tuyển\nCÔNG TY: Alpha\nMức  lương 10tr\nĐịa chỉ: Q7",
        "x y z\nNhà tuyển dụng: Beta\n(lương cao)\nThuNhập: 5\nNơi làm: HN",
        "cty\nGamma Co\nkhông\nworkplace here",
        "Company Delta\nlươngthưởng\nlocations",
        "",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    rows = df.select("i", R.guess_company(t).alias("c"), R.pick_line(t, R.PAY_LABELS).alias("pay"), R.pick_line(t, R.PLACE_LABELS).alias("place")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("Alpha", "Mức  lương 10tr", "Địa chỉ: Q7"),
        ("Beta", "ThuNhập: 5", "Nơi làm: HN"),
        ("Gamma Co", None, "workplace here"),
        (None, None, None),
        (None, None, None),
        (None, None, None),
    ]


def test_zones_and_districts(spark):
    cases = {
        "12 Điện Biên Phủ, Bình Thạnh, Thủ Đức": "Bình Thạnh",
        "Q.7, TP HCM": "Quận 7",
        "Q 10": "Quận 10",
        "Quận 9 cũ": None,
        "Quận 12A": None,
        "lô 5, KCN tân tạo, HCM": "KCN Tân Tạo",
        "Khu công nghiệp  Sóng Thần 2.": "KCN Sóng Thần 2",
        "Amata Industrial Park, Biên Hòa": "KCN Amata",
        "KCN Tân Tạo (mở rộng), HCM": None,
        "KCX một cái tên quá dài để là một khu nào đó": None,
        "": None,
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    assert [r.raw for r in df.select("*", C.district_of(F.col("raw")).alias("got")).where("NOT (got <=> want)").collect()] == []


def test_excerpt_around_working_time(spark):
    far, tail = "a" * 70, "b" * 130
    cases = {
        f"{far}giờ làm việc{tail}": "a" * 60 + "giờ làm việc" + "b" * 110,
        # Both mentions begin within the first letters: the words go on behind the last.
        f"Giờ làm việc 8h, nghỉ thứ 7 {tail}": "Giờ làm việc 8h, nghỉ thứ 7 " + "b" * 109,
        f"{far}Working hours{tail}": "a" * 60 + "Working hours" + "b" * 110,
        "🔥 T7 nghỉ": "🔥 T7 nghỉ",
        "T70 là xe tăng": None,
        "không": None,
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [(r.t, r.got) for r in df.select("*", C.schedule_excerpt(F.col("t")).alias("got")).where("NOT (got <=> want)").collect()] == []
