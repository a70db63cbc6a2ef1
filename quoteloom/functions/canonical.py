"""Byte-exact canonical JSON and tolerant JSON decoding: the two places where built-in JSON functions differ."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteloom.functions.text import as_col


@F.pandas_udf(T.StringType())
def canonical_json_udf(texts: pd.Series) -> pd.Series:
    """Sorted keys, no spaces, numbers as written; null when the text is not JSON."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def leading_json_udf(texts: pd.Series) -> pd.Series:
    """The JSON value a text starts with, whatever follows it."""
    decoder = json.JSONDecoder()

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            end = decoder.raw_decode(t)[1]
        except ValueError:
            return None
        return t[:end]

    return texts.map(one)


def json_candidate(response: Column | str) -> Column:
    """Text from the first ``[`` or ``{`` of the fenced part of a response, or of all of it without a fence."""
    r = as_col(response)
    fenced = r.rlike(r"(?s)```(?:json)?(?U)\s*.*?```")
    body = F.when(fenced, F.regexp_extract(r, r"(?s)```(?:json)?(?U)\s*(.*?)```", 1)).otherwise(r)
    return F.nullif(F.regexp_extract(body, r"(?s)([\[{].*)$", 1), F.lit(""))


def response_json(response: Column | str) -> Column:
    """JSON text of a model response, or null. The built-in parsers pass over text behind the value, so the end of the
    value comes from the Arrow decoder."""
    return leading_json_udf(json_candidate(response))


def response_objects(response: Column | str) -> Column:
    """The response as an array of object texts; one object counts as a list of one, anything else is null."""
    text = response_json(response)
    items = F.when(F.startswith(F.ltrim(text), F.lit("{")), F.array(text)).otherwise(F.from_json(text, "array<string>"))
    fine = F.forall(items, lambda x: F.coalesce(F.startswith(F.ltrim(x), F.lit("{")), F.lit(False)))
    return F.when(fine, items)
