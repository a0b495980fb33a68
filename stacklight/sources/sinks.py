"""Results as files: JSON lines, CSV, tab-separated text, ISO 2709."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iso2709 import iso2709


def json_lines(df: DataFrame, path: str, **options) -> None:
    """An object a line; null fields are left out unless ignoreNullFields="false"."""
    df.write.mode("overwrite").options(**options).json(path)


def delimited(df: DataFrame, path: str, sep: str = ",", **options) -> None:
    """CSV with a header (sep "," or "\\t"); quotes are doubled. Arrays and structs go as JSON."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    flat.write.mode("overwrite").options(header="true", sep=sep, escape='"', **options).csv(path)


def records(df: DataFrame, path: str, rec: str = "rec") -> None:
    """Records back to back, as ISO 2709 files are; raises where the format can't hold a record."""
    text = F.coalesce(iso2709(F.col(rec)), F.raise_error(F.lit("a record is too long for ISO 2709")).cast("string"))
    df.select(text.alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)
