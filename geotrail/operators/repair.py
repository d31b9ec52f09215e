"""Repair and normalization of nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import parse_whole


def nullable_text(c: Column) -> Column:
    """Trimmed text; empty text and written nulls are null."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin("", "null", "(null)"), t)


def normalize_geo(a: Column, b: Column, box: tuple[float, float, float, float] = (73, 136, 3, 54)) -> Column:
    """struct(usable, source_order, lng, lat, in_bounds, flags) of two numbers as a source gives them.

    The source's own order is latitude, longitude, so that holds wherever it is possible; the other order is flagged. in_bounds tells
    whether the point lies in the box (west, east, south, north). Equal numbers are a placeholder.
    """
    west, east, south, north = box
    latitude, longitude = (lambda x: F.abs(x) <= 90), (lambda x: F.abs(x) <= 180)
    missing, equal = a.isNull() | b.isNull(), (a == b) & ~F.isnan(a)
    order = F.when(missing | equal, None).when(latitude(a) & longitude(b), "lat_lng").when(longitude(a) & latitude(b), "lng_lat")
    lng, lat = F.when(order == "lng_lat", a).when(order == "lat_lng", b), F.when(order == "lng_lat", b).when(order == "lat_lng", a)
    # fixed values: names of the flags
    flag = (
        F.when(missing, "missing_or_unrecognized_geo")
        .when(equal, "equal_coordinate_placeholder")
        .when(order.isNull(), "coordinate_out_of_global_range")
        .when(order == "lng_lat", "unexpected_source_coordinate_order")
    )
    inside = lng.between(west, east) & lat.between(south, north)
    return F.struct(order.isNotNull().alias("usable"), order.alias("source_order"), lng.alias("lng"), lat.alias("lat"), inside.alias("in_bounds"), F.array_compact(F.array(flag)).alias("flags"))


def find_coordinates(raw: Column, fields: tuple[str, ...] = ("coordinates", "location", "lnglat", "center")) -> Column:
    """array<double> of two numbers found in JSON text: the text itself, or one of the named fields, as an array or as "x,y"."""
    pair = r"^\[?\s*\"?\s*(-?\d+(?:\.\d+)?)\s*[,，]\s*(-?\d+(?:\.\d+)?)\s*\"?\s*\]?$"

    def of(text: Column) -> Column:
        x, y = F.regexp_extract(text, pair, 1), F.regexp_extract(text, pair, 2)
        return F.when(x != "", F.array(x.cast("double"), y.cast("double")))

    return F.coalesce(of(F.trim(raw)), *[of(F.get_json_object(raw, f"$.{f}")) for f in fields], *[of(F.get_json_object(raw, f"$.geo.{f}")) for f in fields])


def required_fields(text: Column, fields: list[str]) -> Column:
    """Whether a JSON object has every field; an explicit null counts."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, fields)), F.json_object_keys(text))) == 0, F.lit(False))


def recover_json(text: Column) -> Column:
    """JSON text made valid by the least of these: nothing, no code fence, no trailing commas, a bad closing quote mended; else null."""
    valid = lambda t: parse_whole(t).isNotNull()
    fence = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    commas = F.regexp_replace(fence, r",(\s*[}\]])", "$1")
    quotes = F.regexp_replace(F.regexp_replace(commas, "[“”]", '"'), r"'(\s*[,}\]])", '"$1')
    return F.when(valid(text), text).when(valid(fence), fence).when(valid(commas), commas).when(valid(quotes), quotes)


def recover_objects(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Adds recovered: the repaired text where it is one complete object with all fields, else null."""
    fixed = recover_json(F.col(column))
    is_object = F.schema_of_variant(parse_whole(fixed)).startswith("OBJECT")
    return df.withColumn("recovered", F.when(is_object & required_fields(fixed, fields), fixed))


def map_enum(df: DataFrame, column: str, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(the table with mapped values, how often each value was changed)."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    new = F.coalesce(F.element_at(table, F.col(column)), F.col(column))
    changed = df.where(new != F.col(column)).groupBy(F.col(column).alias("from_value"), new.alias("to_value")).agg(F.count("*").alias("n"))
    return df.withColumn(column, new), changed


def infer_source(items: Column, text: Column) -> Column:
    """Items (name, confidence, source) whose missing source becomes text where the name stands in the text."""
    return F.transform(items, lambda i: i.withField("source", F.when(i["source"].isNull() & F.contains(text, i["name"]), "text").otherwise(i["source"])))


def quality_flags(checks: dict[str, Column]) -> Column:
    """array<struct<flag, n>> of the checks that count something."""
    return F.array_compact(F.array(*[F.when(n > 0, F.struct(F.lit(name).alias("flag"), n.cast("long").alias("n"))) for name, n in checks.items()]))


def useful_text(items: Column, stopwords: list[str], least: int = 3) -> Column:
    """The texts of an array that are long enough, no handle, no address, and hold no stop word."""
    bad = "|".join([r"^@", r"https?://|www\.", *[rf"\Q{w}\E" for w in stopwords]])
    return F.filter(F.transform(items, lambda t: F.trim(t)), lambda t: (F.length(t) >= least) & ~t.rlike(f"(?i){bad}"))


def patch_merge(base: DataFrame, patch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Base rows with the patch's values where it has some; old_<column> keeps what was replaced, patched says whether."""
    p = patch.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = base.join(p, keys, "left")
    for c in columns:
        out = out.withColumn(f"old_{c}", F.when(F.col(f"_{c}").isNotNull(), F.col(c))).withColumn(c, F.coalesce(f"_{c}", c))
    return out.withColumn("patched", F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_{c}" for c in columns])


def repair_metrics(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows read, written and changed, and whether read equals written."""
    b = before.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(1).alias("_b"))
    a = after.select(key, *columns, F.lit(1).alias("_a"))
    changed = ~F.struct(*[f"_{c}" for c in columns]).eqNullSafe(F.struct(*columns))
    both = b.join(a, key, "full")
    return both.agg(F.count("_b").alias("n_read"), F.count("_a").alias("n_written"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & changed).alias("n_changed")).withColumn("reconciled", F.col("n_read") == F.col("n_written"))


def clean_prefix(c: Column, prefix: str) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), rf"^\Q{prefix}\E", ""))


def map_vocab(labels: DataFrame, vocab: DataFrame, column: str, version: str) -> DataFrame:
    """Labels with vocab_id by exact alias; vocab is (alias, vocab_id). Unmapped labels keep null and method unmapped."""
    out = labels.withColumn("alias", F.lower(F.trim(column))).join(vocab, "alias", "left")
    method = F.when(F.col("vocab_id").isNotNull(), "exact_alias").otherwise("unmapped")
    return out.withColumn("mapping_method", method).withColumn("vocab_version", F.lit(version)).drop("alias")
