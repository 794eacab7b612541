"""Text, tag and date expressions. Each takes and returns columns; none is a Python UDF."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not identify a stream or a road.
STOP_WORDS = ("creek", "brook", "river", "rd", "road", "st", "street", "trib", "to", "of", "the", "unnamed", "stream", "branch",
              "run", "ave", "route", "rt", "ny", "us", "co", "cr", "county", "hwy", "ln", "dr")


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def dms_to_degrees(text: Column, degree_digits: int) -> Column:
    """Digits 'D..MMSSss' with two implied decimals to degrees; NULL if minutes or seconds reach 60 or a part is no number."""
    s = F.lpad(F.trim(text.cast("string")), degree_digits + 6, "0")
    full = F.when(F.length(F.trim(text.cast("string"))) > degree_digits + 6, F.trim(text.cast("string"))).otherwise(s)
    d = try_double(F.substring(full, 1, degree_digits))
    m = try_double(F.substring(full, degree_digits + 1, 2))
    sec = try_double(full.substr(F.lit(degree_digits + 3), F.length(full))) / 100.0
    return F.when((m < 60) & (sec < 60), d + m / 60.0 + sec / 3600.0)


def strip_quotes(text: Column) -> Column:
    return F.trim(F.btrim(F.trim(text), F.lit("'")))


def normalise_name(text: Column, suffix: str | None = None) -> Column:
    """Trimmed, without the suffix word, in title case."""
    s = F.trim(text)
    return F.initcap(F.trim(F.replace(s, F.lit(suffix), F.lit("")) if suffix else s))


def column_key(name: str) -> str:
    """How a column name is compared: lower case, blanks as underscores."""
    return name.strip().lower().replace(" ", "_")


def code_prefix(code: Column, digits: int) -> Column:
    return F.substring(code, 1, digits)


def extract_number(text: Column) -> Column:
    """First unsigned number in a text."""
    return F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def parse_hstore(text: Column) -> Column:
    """'"k"=>"v", ...' to a map; a repeated key keeps its last value, escapes inside values stay as written."""
    pair = r'"([^"]+)"=>"((?:[^"\\]|\\.)*)"'
    keys = F.regexp_extract_all(text, F.lit(pair), 1)
    values = F.regexp_extract_all(text, F.lit(pair), 2)
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    rest = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), lambda later: later == e["k"]))
    return F.when(text.isNotNull(), F.map_from_entries(F.transform(rest, lambda e: F.struct(e["k"], e["v"]))))


def has_key(tags: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, key), F.lit(False))


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


# Way tags by class.
PAVED = ("paved", "asphalt", "concrete", "concrete:plates", "concrete:lanes", "paving_stones", "sett", "cobblestone", "metal", "chipseal")
UNPAVED = ("unpaved", "gravel", "dirt", "ground", "grass", "sand", "compacted", "earth", "fine_gravel", "pebblestone", "mud",
           "woodchips", "ice", "snow")
TRAILS = ("path", "footway", "bridleway", "cycleway", "steps")


def classify_road(highway: Column, railway: Column, surface: Column, service: Column, lanes: Column) -> Column:
    """Road class of a way from its tags, first rule that fits; a road without a surface tag counts as paved."""
    hw, su, se = (F.lower(F.coalesce(c, F.lit(""))) for c in (highway, surface, service))
    n = F.floor(try_double(lanes))
    return (
        F.when(railway.isNotNull(), "railroad")
        .when((hw == "service") & (se == "driveway"), "driveway")
        .when(hw.isin(*TRAILS), "trail")
        .when((n > 2) | (hw.isin("motorway", "trunk") & n.isNull()), "multilane road (>2 lanes)")
        .when(hw == "track", F.when(su.isin(*PAVED), "paved").otherwise("unpaved"))
        .when(su.isin(*UNPAVED), "unpaved")
        .when(su.isin(*PAVED) | (hw != ""), "paved")
        .otherwise("unknown")
    )


def structure_kind(highway: Column, bridge: Column) -> Column:
    """road_bridge, road_culvert or stream_culvert; a road with bridge=no is in the culvert branch."""
    return (F.when(highway.isNotNull() & (F.coalesce(bridge, F.lit("no")) != "no"), "road_bridge")
            .when(highway.isNotNull(), "road_culvert").otherwise("stream_culvert"))


def culvert_like(bridge: Column, structure: Column) -> Column:
    return (F.coalesce(bridge == "culvert", F.lit(False)) | F.coalesce(structure.isin("culvert", "box_culvert"), F.lit(False))).cast("double")


# Ranks of road classes for bridges (1 is the largest) and for roads near a point (9 is the largest).
BRIDGE_ROAD_RANK = {"motorway": 1, "motorway_link": 1, "trunk": 2, "trunk_link": 2, "primary": 3, "primary_link": 3,
                    "secondary": 4, "secondary_link": 4, "tertiary": 5, "tertiary_link": 5, "unclassified": 6,
                    "residential": 7, "service": 8, "track": 9, "path": 10, "footway": 10, "cycleway": 10}
ROAD_RANK = {"motorway": 9, "trunk": 8, "primary": 7, "secondary": 6, "tertiary": 5, "unclassified": 4, "residential": 3,
             "service": 2, "track": 1, "motorway_link": 9, "trunk_link": 8, "primary_link": 7, "secondary_link": 6,
             "tertiary_link": 5, "living_street": 3}
WATER_KIND = {"stream": 1, "river": 2, "ditch": 3, "drain": 4, "canal": 5}


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small fixed dictionary, ``default`` (NULL) for other keys, NULL for a NULL key."""
    flat = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*flat), key)
    return F.when(key.isNotNull(), found if default is None else F.coalesce(found, F.lit(default)))


def strip_code_label(text: Column) -> Column:
    """'NN - Description' to its description; other texts only trimmed."""
    return F.trim(F.when(F.instr(text, " - ") > 0, text.substr(F.instr(text, " - ") + 3, F.length(text))).otherwise(text))


def parse_measure(text: Column) -> Column:
    """Inches as 'n', 'a-b' or '>a' to a struct (point, low, high) in feet; an open range has no high end."""
    s = F.trim(text)
    number = try_double(s)
    rng = r"^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*$"
    over = r"^\s*>\s*(\d+(?:\.\d+)?)\s*$"
    a, b = try_double(F.nullif(F.regexp_extract(s, rng, 1), F.lit(""))), try_double(F.nullif(F.regexp_extract(s, rng, 2), F.lit("")))
    o = try_double(F.nullif(F.regexp_extract(s, over, 1), F.lit("")))
    return F.struct(F.coalesce(number / 12, (a + b) / 24, o / 12).alias("point"), F.coalesce(number / 12, a / 12, o / 12).alias("low"),
                    F.coalesce(number / 12, b / 12).alias("high"))


def is_range(text: Column) -> Column:
    """Any '-' or '>' in the text, so a negative number counts too."""
    return F.coalesce(text.rlike("[->]"), F.lit(False))


def is_whole(text: Column) -> Column:
    n = try_double(F.trim(text))
    return is_range(text) | n.isNull() | (n == F.floor(n))


def straddles(ranged: Column, low: Column, high: Column, limit: float) -> Column:
    """A range whose ends lie on both sides of a limit."""
    return ranged & F.coalesce(low < limit, F.lit(False)) & F.coalesce(high > limit, F.lit(False))


def tokens(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct lower-case words of two or more characters that are not stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop)))


def shared_token(a: Column, b: Column) -> Column:
    """Do two token arrays share one; NULL if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b))


def parse_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")])


def epoch_ms_year(ms: Column) -> Column:
    return F.year(F.timestamp_millis(ms.cast("bigint")))


def years_since(year: Column, now: int, limit: int = 40) -> Column:
    """Whole years up to ``now``, not below 0; ``limit`` or more is a placeholder date and becomes NULL."""
    n = F.when(year.isNotNull(), F.greatest(F.lit(now) - year, F.lit(0)))
    return F.when(n < limit, n)


def same_day(a: Column, b: Column) -> Column:
    return F.date_trunc("day", a) == F.date_trunc("day", b)
