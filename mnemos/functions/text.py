"""Scalar functions on text, times and routes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stamp(text: Column) -> Column:
    """Null for what isn't a time."""
    return F.try_to_timestamp(text)


def local_day(ts: Column) -> Column:
    """By the session's time zone."""
    return F.to_date(ts)


def fold(text: Column) -> Column:
    """Lower case, ss for ß, compatibility decomposition, ASCII only."""

    @F.pandas_udf(T.StringType())
    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())

    return folded(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def points(text: Column) -> Column:
    """C17: a number of points with a decimal comma or point; null if there is none."""
    return F.replace(F.regexp_extract(text, r"\b(\d+(?:[,.]\d+)?)\s*(?:Punkte|Punkt)\b", 1), F.lit(","), F.lit(".")).try_cast("double")


def minutes(text: Column) -> Column:
    """C18."""
    return F.regexp_extract(text, r"(\d+)\s*Minuten", 1).try_cast("int")


def season_label(season: Column) -> Column:
    """2024-sommer as Sommer 2024, 2024-25-winter as Winter 2024/25; anything else as it is."""
    part = lambda i: F.regexp_extract(season, r"^(\d{4})(?:-(\d{2}))?-(sommer|winter)$", i)
    years = F.when(part(2) == "", part(1)).otherwise(F.concat_ws("/", part(1), part(2)))
    return F.when(season.isNull() | (part(1) == ""), season).otherwise(F.concat_ws(" ", F.initcap(part(3)), years))


def route(url: Column, key: str) -> Column:
    """A parameter of the query, null if it is missing."""
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(key))


def route_url(base: Column, **parameters: Column) -> Column:
    """The URL with those parameters that aren't null, in the order given."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in parameters.items()]
    rest = F.concat_ws("&", *parts)
    return F.when(rest == "", base).otherwise(F.concat(base, F.lit("?"), rest))


def holds_on(day: Column, begin: Column, end: Column) -> Column:
    """C20: from ``begin`` until before ``end`` (null: open), dates as ISO text; false for what isn't a date."""
    a, b, at = (x.try_cast("date") for x in (begin, end, day))
    return F.coalesce((a <= at) & (end.isNull() | (at < b)), F.lit(False))


def digest(content: Column) -> Column:
    """Of bytes, or of a text's UTF-8."""
    return F.sha2(content, 256)


def canonical_json(struct: Column) -> Column:
    """C14: JSON with nulls kept; the caller's struct has its fields in sorted order."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def object_digest(struct: Column) -> Column:
    """Of the canonical JSON."""
    return F.sha2(canonical_json(struct), 256)


def owner_key(exam: Column, module: Column) -> Column:
    """C25."""
    return F.concat(exam, F.lit("/"), module)


def initial_states(ids: Column) -> Column:
    """Every question unanswered; an id that comes twice is one entry."""
    return F.map_from_entries(F.transform(F.array_distinct(ids), lambda x: F.struct(x, F.lit("unanswered"))))


def module_of(name: Column) -> Column:
    """the module that a file name tells by its first known part."""
    lower = F.lower(name)
    out = F.lit("Unknown")
    # fixed values
    for part, module in reversed([("arbeitsplanung", "Arbeitsplanung"), ("funktionsanalyse", "Funktionsanalyse"), ("wiso", "WiSo"), ("lösung", "Solutions"), ("losung", "Solutions")]):
        out = F.when(F.contains(lower, F.lit(part)), module).otherwise(out)
    return out


def half_even(x: Column, digits: int = 0) -> Column:
    """C21."""
    return F.bround(x, digits)


