"""Attribute filters: hard ones before anything is ranked, soft ones after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The attributes in the order in which questions prefer them, and the home country.
ATTRIBUTES = ("decade", "country", "genre", "is_animation")
HOME, OTHER = "KR", "other"
DECADE = r"^\d{3}0s$"


def hard_filter(filters: dict[str, str], home: str = HOME) -> Column:
    """All conditions hold. An unknown country passes "other": it isn't the home country."""
    conditions = []
    for name, value in filters.items():
        if name == "decade":
            conditions.append(F.col("decade") == value)
        elif name == "country":
            conditions.append(~F.col("country").eqNullSafe(home) if value == OTHER else F.col("country") == value)
        elif name == "genre":
            conditions.append(F.array_contains("genres", value))
        elif name == "is_animation":
            conditions.append(F.col("is_animation") == (str(value).lower() == "true"))
        else:
            raise ValueError(f"no attribute {name}")
    return reduce(Column.__and__, conditions, F.lit(True))


def soft_match(name: str, value: Column, home: str = HOME) -> Column:
    """Whether the row has the value; false for what isn't known, with country "other" too."""
    if name == "decade":
        hit = F.col("decade") == value
    elif name == "country":
        hit = F.when(value == OTHER, F.col("country").isNotNull() & (F.col("country") != home)).otherwise(F.col("country") == value)
    elif name == "genre":
        hit = F.array_contains("genres", value)
    elif name == "is_animation":
        hit = F.col("is_animation") == (F.lower(value) == "true")
    else:
        raise ValueError(f"no attribute {name}")
    return F.coalesce(hit, F.lit(False))


def any_soft_match(filters: Column, home: str = HOME) -> Column:
    """Whether any entry of a map of filters matches."""
    tests = [F.coalesce(F.map_contains_key(filters, name), F.lit(False)) & soft_match(name, F.try_element_at(filters, F.lit(name)), home) for name in ATTRIBUTES]
    return reduce(Column.__or__, tests)


def valid_soft_filters(filters: Column, genres: list[str]) -> Column:
    """Entries with a possible value: a decade like 1990s, a country flag, a known genre, true or false."""
    fits = lambda k, v: (
        ((k == "decade") & v.rlike(DECADE)) | ((k == "country") & v.isin(HOME, OTHER)) | ((k == "genre") & v.isin(*genres)) | ((k == "is_animation") & F.lower(v).isin("true", "false"))
    )
    return F.map_filter(filters, fits)


def attribute_value(name: str, home: str = HOME) -> Column:
    """What a row answers to a question on the attribute: of genres the first; null if unknown."""
    if name == "decade":
        return F.col("decade")
    if name == "country":
        return F.when(F.col("country").isNull(), None).when(F.col("country") == home, home).otherwise(OTHER)
    if name == "genre":
        return F.get("genres", F.lit(0))
    if name == "is_animation":
        return F.col("is_animation").cast("string")
    raise ValueError(f"no attribute {name}")


def known_genres(movies: DataFrame) -> DataFrame:
    return movies.select(F.explode("genres").alias("genre")).distinct().orderBy("genre")
