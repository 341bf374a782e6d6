"""Typed identifiers in texts: one pattern per family, with checks where the family has one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.relational import spread

# The shapes of identifiers, in order of precedence.


@dataclass(frozen=True)
class Family:
    name: str
    pattern: str
    group: int = 0
    confidence: float = 0.8
    upper: bool = False


FAMILIES = [
    Family("iban", r"(?i)\b([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})\b", 1, 0.95, True),
    Family("isin", r"\b([A-Z]{2}[A-Z0-9]{9}[0-9])\b", 1, 0.9),
    Family("swift_bic", r"\b([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b", 1, 0.7),
    Family("lei", r"\b([A-Z0-9]{20})\b", 1, 0.8),
    Family("ticker", r"\$([A-Z]{1,5}(?:\.[A-Z]{1,2})?)", 1, 0.85),
    Family("icd10", r"\b([A-TV-Z][0-9]{2}(?:\.[0-9]{1,4})?)\b", 1, 0.8),
    Family("ndc", r"\b([0-9]{4,5}-[0-9]{3,4}-[0-9]{1,2})\b", 1, 0.85),
    Family("patent", r"\b((?:US|EP|JP|WO|CN|KR|DE|FR|GB|CA|AU)[0-9]{6,12}[A-Z][0-9]?)\b", 1, 0.85),
    Family("case_number", r"(?i)\b([0-9]{1,2}:[0-9]{2}-[a-z]{2}-[0-9]{4,6}|no\.\s*[0-9]{2}-[0-9]{3,4}|\[[0-9]{4}\]\s*ew[a-z]{3}\s*[a-z]+\s*[0-9]+|w\.p\.\([a-z]\)\s*[0-9]+/[0-9]{4})\b", 1, 0.8),
    Family("sku", r"(?i)\b(?:sku[:\s]*)?([A-Z0-9]{3,6}-[A-Z0-9]{3,6}(?:-[A-Z0-9]{1,6})?)\b", 1, 0.6, True),
    Family("serial", r"(?i)\b(?:s/n|sn|serial(?:\s*no\.?)?)[:\s]*([A-Z0-9]{6,20})\b", 1, 0.8),
    Family("asin", r"\b(B[A-Z0-9]{9})\b", 1, 0.7),
    Family("purchase_order", r"(?i)\b(?:po[-#:]|purchase\s+order\s*(?:no\.?)?)[:\s]*([A-Z0-9-]{4,20})\b", 1, 0.8, True),
    Family("invoice", r"(?i)\b(?:inv[-#:]|invoice\s*(?:no\.?)?)[:\s]*([A-Z0-9-]{4,20})\b", 1, 0.8, True),
    Family("phone", r"(\+[0-9]{1,3}[\s.-]?\(?[0-9]{1,4}\)?[\s.-]?[0-9]{3,4}[\s.-]?[0-9]{3,4})", 0, 0.7),
    Family("ip", r"\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b", 1, 0.9),
    Family("currency", r"([$€¥£₹₩₪₫฿]\s?[0-9][0-9,]*(?:\.[0-9]+)?\s?[KMBTkmbt]?)", 1, 0.8),
    Family("measurement", r"([0-9]+(?:\.[0-9]+)?\s?(?:%|GB|MB|KB|TB|ms|kg|km|°C|°F|MHz|GHz|rpm|ppm|bps|fps|Hz|W|kW|MW|V|A|dB))", 1, 0.7),
]
#: The longer form of an address; the family's name and place are those of the shorter one.
IPV6 = r"\b([0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}|::[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})\b"
BY_NAME = {f.name: f for f in FAMILIES}


def iban_valid(iban: Column) -> Column:
    """The number's remainder by 97 is 1, read with its first four characters last and letters as 10 to 35."""
    turned = F.upper(F.concat(iban.substr(F.lit(5), F.length(iban)), F.substring(iban, 1, 4)))
    digits = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * F.when(d >= 10, 100).otherwise(10) + d) % 97) == 1


def octets_valid(ip: Column) -> Column:
    return F.forall(F.split(ip, r"\."), lambda o: o.cast("int") <= 255)


def found(text: Column, name: str) -> Column:
    """All of one family's identifiers in a text, in order."""
    f = BY_NAME[name]
    out = F.regexp_extract_all(text, F.lit(f.pattern), f.group)
    if f.upper:
        out = F.transform(out, F.upper)
    if name == "iban":
        out = F.filter(out, iban_valid)
    if name == "ip":
        out = F.concat(F.filter(out, octets_valid), F.transform(F.regexp_extract_all(text, F.lit(IPV6), 1), F.lower))
    return F.transform(out, lambda c: F.trim(c)) if name == "currency" else out


def typed_entities(texts: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(id, place, family, content, confidence)``: identifiers of all families; of equal contents the first family's counts."""

    def of(place: int, family: Family) -> Column:
        return F.transform(found(F.col("text"), family.name), lambda c: F.struct(F.lit(place).alias("place"), F.lit(family.name).alias("family"), c.alias("content"), F.lit(family.confidence).alias("confidence")))

    # by content, then family: of equal contents the first one stays, and no text's entities leave its row
    each = F.array_sort(F.transform(F.concat(*map(of, range(len(FAMILIES)), FAMILIES)), lambda e: F.struct(e["content"].alias("content"), e["place"].alias("place"), e["family"].alias("family"), e["confidence"].alias("confidence"))))
    rows = spread(texts.select(id_column, "text")).select(id_column, each.alias("e"))
    first = F.filter("e", lambda x, i: (i == 0) | (F.get("e", i - 1)["content"] != x["content"]))
    return rows.select(id_column, F.explode(first).alias("e")).select(id_column, "e.*")


def ambiguous(text: Column) -> Column:
    """Tokens that look like identifiers of no family: letters and digits, perhaps with dashes."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z0-9][A-Z0-9\-]{3,24}[A-Z0-9])\b"), 1), lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]"))
