"""Row rules on streams: an extension beyond batch runs.

Row rules are plain columns, so they run on a stream as they are. Unique values need state; a watermark bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.checks.attributes import violation
from terrasift.checks.base import is_null
from terrasift.config import AttributesRule, GeometryRule
from terrasift.functions.geo import geo_state


def violations(stream: DataFrame, attributes: AttributesRule, geometry: GeometryRule | None = None, geom: str = "geometry") -> DataFrame:
    """Rows that break a row rule, with `checks`, the names of the rules broken in order."""
    have = set(stream.columns)
    flags = {f"attributes.not_null[{c}]": is_null(stream, c) for c in attributes.not_null if c in have}
    flags |= {f"attributes.domain[{c}]": violation(stream, c, d)[0] for c, d in attributes.domains.items() if c in have}
    if geometry is not None and geom in have:
        stream = stream.withColumn("__s", geo_state(F.col(geom)))
        flags["geometry.no_missing"] = F.col(geom).isNull()
        flags["geometry.no_empty"] = F.coalesce(F.col("__s.empty"), F.lit(False))
        flags["geometry.valid"] = F.col("__s.reason").isNotNull()
    named = F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in sorted(flags.items())])) if flags else F.array().cast("array<string>")
    return stream.withColumn("checks", named).where(F.size("checks") > 0).drop("__s")


def first_of_each(stream: DataFrame, column: str, event_time: str, delay: str) -> DataFrame:
    """The first row of each value within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([column])
