"""The survey cleaning plan: filters, collapse of structures to crossings, most recent survey, final columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.functions.text import parse_date
from rillmap.operators import clean as C

# Site types without an assessable structure.
NO_STRUCTURE = ("inaccessible", "partially inaccessible", "no crossing", "no upstream channel", "buried stream", "removed crossing")
# Measurements in which -1 means not measured.
MEASURED = ("Outlet_Drop_To_Water_Surface", "Outlet_Drop_To_Stream_Bottom", "Inlet_Openness", "Outlet_Openness", "Inlet_Height",
            "Outlet_Height", "Crossing_Structure_Length", "Slope_Percent", "Road_Fill_Height")


def number(col: str) -> Column:
    """Text to a number; -1 is the survey's code for 'not measured'."""
    return F.nullif(F.col(col).try_cast("double"), F.lit(-1.0))


def survey_steps() -> list[tuple[str, Column]]:
    return [
        ("valid coordinates", F.col("lat").between(40.0, 46.0) & F.col("lon").between(-80.5, -71.0)),
        ("has a numeric score", F.col("passability").isNotNull()),
        ("score between 0 and 1", F.col("passability").between(0.0, 1.0)),
        ("not tidal", C.not_text("Tidal_Site", "yes")),
        ("has a structure", C.not_in_text("Crossing_Type", NO_STRUCTURE)),
        ("approved", C.in_text("Approved", ("1", "1.0"))),
    ]


def prepare(raw: DataFrame) -> DataFrame:
    have = raw.columns
    pick = lambda *cs: F.coalesce(*[number(c) for c in cs if c in have], F.lit(None).cast("double"))
    return raw.withColumns({"lon": pick("_geom_x", "GPS_X_Coordinate"), "lat": pick("_geom_y", "GPS_Y_Coordinate"),
                            "passability": F.col("Aqua_Pass_Score").try_cast("double"), "date_observed": parse_date(F.col("Date_Observed"))})


def collapse(df: DataFrame, code: str, day: str, score: str, tie: list[str]) -> DataFrame:
    """Limiting structure per (code, day), then the most recent day per code; both take non-NULL values column by column."""
    per_day = C.collapse_first(df, [code, day], [score, *tie])
    return C.collapse_first(per_day.where(F.col(code).isNotNull()), [code], [day], last=True)


def clean_surveys(raw: DataFrame, keep: list[str]) -> DataFrame:
    """Raw survey export (all text) to one row per crossing."""
    ready = C.apply_steps(prepare(raw), survey_steps())
    ready = ready.withColumn("_row", F.xxhash64(*[F.col(c) for c in raw.columns]))
    one = collapse(ready, "Crossing_Code", "date_observed", "passability", ["Survey_Id", "_row"])
    out = C.assemble(one, ["Crossing_Code", "lat", "lon", "passability", "date_observed", *keep], {"NHD_HUC8_Watershed": "huc8_name"},
                     {"crossing_id": F.col("Crossing_Code"), "year": F.year("date_observed")})
    return out.withColumns({c: number(c) for c in MEASURED if c in out.columns})


def cleaning_counts(raw: DataFrame) -> DataFrame:
    return C.cleaning_report(prepare(raw), survey_steps())
