"""Names, money, addresses and dates as they are written in different places, as column functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

# Forms of address, currencies, first years of eras, marks of calendars.
PREFIXES = ["Mr.", "Mr ", "Ms.", "Ms ", "Mrs.", "Mrs ", "Dr.", "Dr ", "Prof.", "Prof ", "Sir ", "Madam ", "Lady ", "Lord "]
LOCAL_PREFIXES = {"th": ["คุณ"], "vi": ["Ông ", "Bà ", "Anh ", "Chị "]}
LOCAL_SUFFIXES = {"ja": ["様", "氏"], "ko": ["씨"], "zh": ["先生"]}
FAMILY_FIRST = ["ja", "ko", "zh", "vi", "hu"]
SYMBOLS = {"$": "USD", "€": "EUR", "¥": "JPY", "£": "GBP", "₹": "INR", "₩": "KRW", "₫": "VND", "฿": "THB", "₪": "ILS"}
CODES = {"€": "EUR", "USD": "USD", "EUR": "EUR", "JPY": "JPY", "GBP": "GBP"}
ERAS = {"令和": 2019, "平成": 1989, "昭和": 1926, "大正": 1912, "明治": 1868}
CALENDARS = {"japanese_era": ["令和", "平成", "昭和", "大正", "明治", "慶應"], "thai_buddhist": ["พ.ศ"], "chinese_lunar": ["農曆", "农历", "舊曆", "旧历", "阴历", "陰曆"], "hijri": ["AH", "هـ", " Hijri"]}
#: The first day of the lunar year, by year.
LUNAR_NEW_YEAR = {2020: "2020-01-25", 2021: "2021-02-12", 2022: "2022-02-01", 2023: "2023-01-22", 2024: "2024-02-10", 2025: "2025-01-29", 2026: "2026-02-17", 2027: "2027-02-06", 2028: "2028-01-26", 2029: "2029-02-13", 2030: "2030-02-03"}


def _first(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def strip_honorific(name: Column, language: Column) -> Column:
    """``(name, honorific)``: the first form of address that fits is taken off."""
    rules = [(name.startswith(p), F.struct(F.trim(F.substr(name, F.lit(len(p) + 1))).alias("name"), F.lit(p.rstrip()).alias("honorific"))) for p in PREFIXES]
    for tag, words in LOCAL_PREFIXES.items():
        rules += [((language == tag) & name.startswith(w), F.struct(F.trim(F.substr(name, F.lit(len(w) + 1))).alias("name"), F.lit(w.rstrip()).alias("honorific"))) for w in words]
    for tag, words in LOCAL_SUFFIXES.items():
        rules += [((language == tag) & name.endswith(w), F.struct(F.trim(F.substr(name, F.lit(1), F.length(name) - len(w))).alias("name"), F.lit(w).alias("honorific"))) for w in words]
    return _first(rules, F.struct(name.alias("name"), F.lit(None).cast("string").alias("honorific")))


def name_order(name: Column, language: Column) -> Column:
    unspaced = ~name.contains(" ") & name.rlike(r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]")
    return F.when(F.coalesce(language.isin(FAMILY_FIRST), F.lit(False)) | unspaced, "family_first").otherwise("given_first")


def person_name(raw: Column, language: Column) -> Column:
    """``(display, family, given)`` by the order of the language."""
    name = strip_honorific(raw, language)["name"]
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    first, many = name_order(name, language) == "family_first", F.size(words) >= 2
    family = F.when(first & many, F.get(words, F.lit(0))).when(first & (F.length(name) >= 2), F.substring(name, 1, 1)).when(first, name).when(many, F.element_at(words, -1))
    given = F.when(first & many, F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")).when(first & (F.length(name) >= 2), F.substr(name, F.lit(2))).when(first, F.lit(None)).when(many, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(name)
    return F.struct(name.alias("display"), family.alias("family"), given.alias("given"))


def calendar(text: Column) -> Column:
    return _first([(text.rlike("|".join(m.replace(".", r"\.") for m in marks)), F.lit(name)) for name, marks in CALENDARS.items()], F.lit("gregorian"))


def amount(text: Column) -> Column:
    """An amount with a point before decimals and no other separator; K, M, B or T stays."""
    whole = F.trim(text)
    unit = F.upper(F.regexp_extract(whole, "[KMBTkmbt]$", 0))
    digits = F.regexp_replace(whole, "[KMBTkmbt]$", "")
    dot, comma = digits.contains("."), digits.contains(",")
    point_last = F.instr(F.reverse(digits), ".") < F.instr(F.reverse(digits), ",")
    tail = F.length(F.substring_index(digits, ",", -1))
    clean = (
        F.when(dot & comma & point_last, F.replace(digits, F.lit(","), F.lit(""))).when(dot & comma, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & (tail <= 2), F.replace(digits, F.lit(","), F.lit("."))).when(comma, F.replace(digits, F.lit(","), F.lit(""))).otherwise(F.replace(digits, F.lit(" "), F.lit("")))
    )
    return F.concat(clean, unit)


def currency(raw: Column) -> Column:
    """``(code, amount)`` of a sum of money, or null."""
    whole = F.trim(raw)
    rules = [(whole.startswith(s), F.struct(F.lit(c).alias("code"), amount(F.substr(whole, F.lit(2))).alias("amount"))) for s, c in SYMBOLS.items()]
    rules += [(whole.endswith(s), F.struct(F.lit(c).alias("code"), amount(F.substr(whole, F.lit(1), F.length(whole) - len(s))).alias("amount"))) for s, c in CODES.items()]
    return _first(rules, F.lit(None).cast("struct<code:string,amount:string>"))


def address_country(text: Column) -> Column:
    return F.when(text.contains("〒"), "JP").when(text.rlike(r"\b[A-Z]{2}\s+[0-9]{5}\b"), "US").when(text.rlike(r"\b[A-Z]{1,4}[0-9]{1,2}[A-Z]?\s+[0-9][A-Z]{2}\b"), "GB").when(text.rlike(r"\b[0-9]{5}\b") & text.contains("Germany"), "DE")


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))


def japanese_era(text: Column) -> Column:
    """An era date at the start of a text as ISO, or null."""
    pattern = r"^(令和|平成|昭和|大正|明治)\s*([0-9]+)年([0-9]+)月([0-9]+)日"
    part = lambda i: F.regexp_extract(text, pattern, i)
    start = _first([(part(1) == e, F.lit(y)) for e, y in ERAS.items()], F.lit(None).cast("int"))
    return F.when(text.rlike(pattern), _iso(start + F.try_to_number(part(2), F.lit("999999")).cast("int") - 1, part(3), part(4)))


def thai_buddhist(text: Column) -> Column:
    pattern = r"^พ\.ศ\.\s*([0-9]+)(?:[-/]([0-9]{1,2})[-/]([0-9]{1,2}))?"
    part = lambda i: F.regexp_extract(text, pattern, i)
    year = F.when(text.rlike(pattern), F.try_to_number(part(1), F.lit("999999")).cast("int") - 543)
    return F.when(year < 1, F.lit(None)).when(part(2) != "", _iso(year, part(2), part(3))).otherwise(F.lpad(year.cast("string"), 4, "0"))


def chinese_lunar(text: Column) -> Column:
    """A lunar date ``Y年M月D日`` as ISO: the day of the new year, and 29 days for each month; null outside the table."""
    pattern = r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日"
    part = lambda i: F.regexp_extract(text, pattern, i)
    starts = F.from_json(F.lit(json.dumps({str(y): d for y, d in LUNAR_NEW_YEAR.items()})), "map<string,string>")
    days = F.when(text.rlike(pattern), (part(2).try_cast("int") - 1) * 29 + part(3).try_cast("int") - 1)
    return F.date_add(starts[part(1)].cast("date"), days).cast("string")


def hijri(text: Column) -> Column:
    """A date ``M-D-Y AH`` of the tabular calendar as ISO: through the day number of the calendar's 30-year cycle."""
    pattern = r"([0-9]{1,2})[-/ ]([0-9]{1,2})[-/ ]([0-9]{3,4})\s*(?:AH|هـ)"
    month, day, year = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2, 3))
    number = F.floor((11 * year + 3) / 30) + 354 * year + 30 * month - F.floor((month - 1) / 2) + day + 1948440 - 385
    return F.when(text.rlike(pattern), F.date_add(F.lit("1970-01-01").cast("date"), (number - 2440588).cast("int")).cast("string"))


def to_iso(text: Column) -> Column:
    return F.coalesce(japanese_era(text), thai_buddhist(text), F.when(calendar(text) == "chinese_lunar", chinese_lunar(text)), hijri(text))
