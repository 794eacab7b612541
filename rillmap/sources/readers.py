"""Scans: landed files to tables. Every scan lists its columns, so pruning and pushdown reach the files."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmap.functions.text import parse_hstore, structure_kind, tag
from rillmap.operators.ranking import keep_best, with_rank

POINTS = T.ArrayType(T.ArrayType(T.DoubleType()))


def csv_strings(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All-text CSV with trimmed header names; with ``columns`` the header is not read first."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"')
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


# What Windows-1252 puts in place of the control characters of ISO-8859-1.
_C1 = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
_CP1252 = "".join(bytes([ord(c)]).decode("cp1252") for c in _C1)


def csv_windows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Windows-1252 CSV: read as ISO-8859-1, then the 27 characters in which the two differ are replaced."""
    df = csv_strings(spark, path, encoding="ISO-8859-1")
    return df.select(*[F.translate(F.col(f"`{c}`"), _C1, _CP1252).alias(c) for c in df.columns])


def csv_with_fallback(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 CSV; each file whose bytes are not valid UTF-8 is read as Windows-1252 instead. Only names of files come to the driver."""
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.bool_and(F.is_valid_utf8("value")).alias("sound")).collect()
    broken, sound = ([r["f"] for r in files if r["sound"] == ok] for ok in (False, True))
    if not broken:
        return csv_strings(spark, path)
    old = csv_windows(spark, broken)
    return csv_strings(spark, sound).unionByName(old) if sound else old


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by suffix."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else csv_with_fallback(spark, path)


def parquet_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def parquet_in(spark: SparkSession, path: str, columns: Sequence[str], key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is in a table of ids, as a semi-join (Spark turns a small id table into a scan filter)."""
    return parquet_columns(spark, path, columns).join(ids.select(key).distinct(), key, "left_semi")


def state_files(spark: SparkSession, folder: str, states: Sequence[str], year: int, keep: dict[str, str]) -> DataFrame:
    """One delimited text file per state (``NY25.txt``), only the mapped columns, the state from the file name.

    Files are grouped by their header line, so files whose columns stand in another order are read by their own.
    """
    alike: dict[tuple[str, ...], list[str]] = {}
    for s in states:
        one = f"{folder.rstrip('/')}/{s}{year % 100:02d}.txt"
        alike.setdefault(tuple(csv_strings(spark, one).columns), []).append(one)
    parts = [csv_strings(spark, paths).select(*[F.col(c).alias(n) for c, n in keep.items()], F.col("_metadata.file_name").alias("_f")) for paths in alike.values()]
    named = reduce(DataFrame.unionByName, parts)
    return named.withColumn("src_state", F.regexp_extract("_f", r"^([A-Za-z]{2})\d{2}\.txt$", 1)).drop("_f")


def jsonl_records(spark: SparkSession, path: str, key: str, fields: Sequence[str], prefix: str = "sc_", rename: dict[str, str] | None = None) -> DataFrame:
    """One record per line; marker rows with ``_empty`` go; numbers are cast, renamed and prefixed."""
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("_empty", T.StringType()), *[T.StructField(f, T.StringType()) for f in fields]])
    df = spark.read.schema(schema).json(path).where("_empty IS NULL")
    rename = rename or {}
    return df.select(key, *[F.col(f).try_cast("double").alias(prefix + rename.get(f, f)) for f in fields])


LINES = T.StructType([T.StructField("tile", T.ArrayType(T.LongType())), T.StructField("lines", T.ArrayType(T.StructType([
    T.StructField("comid", T.LongType()), T.StructField("order", T.IntegerType()), T.StructField("ftype", T.IntegerType()),
    T.StructField("hydroseq", T.LongType()), T.StructField("paths", T.ArrayType(POINTS))])))])


def nested_lines(spark: SparkSession, path: str) -> DataFrame:
    """(comid, path_no, order, ftype, points): a line listed by several tiles is taken from the smallest tile; paths need two points."""
    rows = spark.read.schema(LINES).json(path)
    each = rows.select("tile", F.inline("lines")).where(F.size("paths") > 0)
    one = keep_best(each, ["comid"], ["tile"])
    return one.select("comid", "order", "ftype", F.posexplode("paths").alias("path_no", "points")).where(F.size("points") >= 2)


def points_to_segments(df: DataFrame, keys: Sequence[str], points: str = "points") -> DataFrame:
    """Point arrays to a segment table, without a shuffle."""
    at = lambda i, c: F.element_at(F.element_at(points, i), c)
    i = F.col("seg")
    s = df.withColumn("seg", F.explode(F.sequence(F.lit(1), F.size(points) - 1)))
    return s.select(*keys, "seg", at(i, 1).alias("x1"), at(i, 2).alias("y1"), at(i + 1, 1).alias("x2"), at(i + 1, 2).alias("y2"))


ELEMENTS = T.StructType([T.StructField("elements", T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])))])))])


def tagged_elements(spark: SparkSession, path: str) -> DataFrame:
    """Way documents to one row per way id with kind, tags and geometry; ways need two points; overlapping files count once, by the longest geometry."""
    each = spark.read.schema(ELEMENTS).json(path).select(F.inline("elements")).where(F.size("geometry") >= 2)
    fullest = F.struct(-F.size("geometry"), "geometry", F.array_sort(F.map_entries("tags")))
    each = each.groupBy("id").agg(F.min_by(F.struct("tags", "geometry"), fullest).alias("_e")).select("id", "_e.tags", "_e.geometry")
    t = lambda k: tag(F.col("tags"), k)
    return each.select(
        "id", structure_kind(t("highway"), t("bridge")).alias("osm_kind"), t("highway").alias("osm_highway"), t("bridge").alias("osm_bridge"),
        t("bridge:structure").alias("osm_bridge_structure"), t("layer").alias("osm_layer"), t("lanes").alias("osm_lanes"), t("surface").alias("osm_surface"),
        t("maxspeed").alias("osm_maxspeed"), t("oneway").alias("osm_oneway"), F.map_contains_key("tags", "name").cast("double").alias("osm_has_name"), "geometry")


def feature_pages(spark: SparkSession, path: str, attributes: T.StructType) -> DataFrame:
    """Landed service pages to one table: attributes plus the point geometry."""
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("attributes", attributes),
        T.StructField("geometry", T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))])))])
    return spark.read.schema(schema).json(path).select(F.explode("features").alias("f")).select(
        "f.attributes.*", F.col("f.geometry.x").alias("_geom_x"), F.col("f.geometry.y").alias("_geom_y"))


def geojson_polygons(spark: SparkSession, path: str, gid: str) -> DataFrame:
    """Polygon features to (gid, rings) with rings of (x, y); MultiPolygons keep all their rings."""
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.StructType([T.StructField(gid, T.StringType())])),
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])))])
    g = spark.read.schema(schema).json(path).select(F.explode("features").alias("f")).select(F.col(f"f.properties.{gid}").alias(gid), "f.geometry.type", "f.geometry.coordinates")
    one = F.from_json("coordinates", T.ArrayType(POINTS))
    many = F.flatten(F.from_json("coordinates", T.ArrayType(T.ArrayType(POINTS))))
    rings = F.when(F.col("type") == "Polygon", one).otherwise(many)
    as_points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return g.select(gid, as_points.alias("rings"))


def column_list(spark: SparkSession, path: str) -> list[str]:
    """Predictor names from a text file, one per line; a list of column names, not data."""
    lines = spark.read.text(path).select(F.trim("value").alias("c"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return [r[0] for r in lines.where("c <> ''").orderBy("b", "i").collect()]


def ascii_grid(spark: SparkSession, path: str) -> tuple[dict[str, float], DataFrame]:
    """Grid text to its header and (row_i, col_i, val) cells; rows are numbered by their place in the file, files by name."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    lines = lines.where("line <> ''").withColumn("head", F.col("line").rlike("^[A-Za-z]"))
    header = {r[0].lower(): r[1] for r in lines.where("head").select(
        F.split("line", r"\s+")[0], F.split("line", r"\s+")[1].cast("double")).collect()}    # six lines
    rows = with_rank(lines.where(~F.col("head")).select("line", "block", "i"), ["block", "i"], name="_rn")
    cells = rows.select((F.col("_rn") - 1).cast("int").alias("row_i"), F.posexplode(F.split("line", r"\s+")).alias("col_i", "_v"))
    return header, cells.select("row_i", "col_i", F.col("_v").cast("double").alias("val"))


def structure_ways(ways: DataFrame) -> DataFrame:
    """Ways that are bridges or culverts, from the extract's text tags, with parsed tags and kind."""
    other = F.coalesce("other_tags", F.lit(""))
    road, water = F.col("highway").isNotNull(), F.col("waterway").isNotNull()
    keep = (road & other.contains('"bridge"=>')) | ((road | water) & other.contains('"tunnel"=>"culvert"'))
    out = ways.where(keep).withColumn("tags", parse_hstore(other))
    return out.withColumn("osm_kind", structure_kind(F.col("highway"), tag(F.col("tags"), "bridge")))


def roads_and_water(ways: DataFrame) -> DataFrame:
    """All roads and waterways with their tags."""
    return ways.where("highway IS NOT NULL OR waterway IS NOT NULL").withColumn("tags", parse_hstore(F.coalesce("other_tags", F.lit(""))))


def best_results(spark: SparkSession, path: str, schema: T.StructType, objective: str, score: str, params: str) -> DataFrame:
    """Best logged setting per objective from an append-only log."""
    log = spark.read.schema(schema).json(path)
    return log.groupBy(objective).agg(F.max(score).alias(score), F.max_by(params, F.struct(score, params)).alias(params), F.count("*").alias("n"))


def resume_todo(wanted: DataFrame, done: DataFrame, key: str, result: str) -> DataFrame:
    """Rows not in the done table; a result of -1 is a failure and is done again."""
    return wanted.join(done.where(F.col(result) != -1).select(key), key, "left_anti")


def missing_sources(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    return expected.select(key).join(observed.select(key).distinct(), key, "left_anti")


def require_sources(expected: DataFrame, observed: DataFrame, key: str) -> None:
    """Refuse to go on while an expected partition is missing."""
    missing = missing_sources(expected, observed, key)
    n = missing.count()
    if n:
        shown = [r[0] for r in missing.orderBy(key).limit(20).collect()]
        raise ValueError(f"{n} missing sources, the first of them {shown}; missing_sources() lists all")
