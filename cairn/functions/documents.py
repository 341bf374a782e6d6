"""Fetched documents in one form, before they are cut into chunks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: Entities that page text is full of; all others stay as they are.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def fetched(html: Column, url: Column) -> Column:
    """``(mime, title, body, source_url)`` of a page: the body without scripts, styles and tags, white space as one space."""
    body = F.regexp_replace(html, r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    for name, sign in ENTITIES.items():
        body = F.replace(body, F.lit(name), F.lit(sign))
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.struct(F.lit("text/html").alias("mime"), F.nullif(title, F.lit("")).alias("title"), F.trim(F.regexp_replace(body, r"[ \t\n\r\f]+", " ")).alias("body"), url.alias("source_url"))


def pretty_json(text: Column) -> Column:
    """A JSON document with two spaces to a level; other texts stay as they are."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
            except (TypeError, ValueError):
                return t

        return texts.map(one)

    return run(text)
