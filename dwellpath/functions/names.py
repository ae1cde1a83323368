"""Names of locations, full and short."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def some(c) -> Column:
    """A column with the empty string as null."""
    return F.nullif(c if isinstance(c, Column) else F.col(c), F.lit(""))


def format_full() -> Column:
    """City or else county, state, country; null without a country."""
    return F.when(some("country").isNotNull(), F.concat_ws(", ", F.coalesce(some("city"), some("county")), some("state"), F.col("country")))


def format_short(lat: str = "lat", lon: str = "lon", location: str = "location_id") -> Column:
    """City and state, city and country, state and country, or country; else the coordinates."""
    at = F.format_string("(%.4f, %.4f)", F.col(lat), F.col(lon))
    name = (
        F.when(some("city").isNotNull(), F.concat_ws(", ", "city", F.coalesce(some("state"), F.col("country"))))
        .when(some("state").isNotNull(), F.concat_ws(", ", "state", "country"))
        .otherwise(F.col("country"))
    )
    return F.when(F.col(location).isNull() | F.col("country").isNull(), at).otherwise(name)
