"""Windows, sequences and sessions. Times are microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.geo import haversine
from ..functions.text import stable_id
from ..sources.io import written

HOUR, DAY = 3_600_000_000, 86_400_000_000


def gap_merge(visits: DataFrame, hours: float = 12, key: str = "location_key", start: str = "t", end: str = "t") -> DataFrame:
    """Merged visits: neighbours at one location whose gap is at most hours and whose eligibility is equal.

    (key, session, start, end, visit_ids, confidence, eligibility, merged)
    """
    w = W.partitionBy(key).orderBy(start, "visit_id")
    new = F.lag("eligibility").over(w).isNull() | (F.lag("eligibility").over(w) != F.col("eligibility")) | (F.col(start) - F.lag(end).over(w) > hours * HOUR)
    flagged = visits.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return flagged.groupBy(key, "session").agg(
        F.min(start).alias("start"),
        F.max(end).alias("end"),
        F.array_sort(F.collect_list("visit_id")).alias("visit_ids"),
        F.max("confidence").alias("confidence"),
        F.first("eligibility").alias("eligibility"),
        (F.count("*") > 1).alias("merged"),
    )


def boundary_split(visits: DataFrame, cluster: str, home: Column | None = None, km: float = 300.0, gap_days: float = 5, span_days: float = 14) -> DataFrame:
    """Adds segment (0, 1, ...) to each cluster's visits in time order; home tells of a visit whether it is at home.

    A segment ends where home changes to away or back over more than km, after a gap of more than gap_days, or where more
    than span_days have passed since the segment's first visit. The first two rules look at neighbours and cut a cluster
    into runs. Within a run longer than span_days every visit points to the first one that would be too late after it;
    the segments begin at the visits that these pointers reach from the run's first, followed in doubled steps.
    """
    w = W.partitionBy(cluster).orderBy("t", "visit_id")
    at_home = F.coalesce(home, F.lit(False)) if home is not None else F.lit(False)
    base = visits.withColumn("_home", at_home)
    far = haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")) > km
    cut = ((F.lag("_home").over(w) != F.col("_home")) & far) | (F.col("t") - F.lag("t").over(w) > gap_days * DAY)
    runs = base.withColumn("_n", F.row_number().over(w)).withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    runs = written(runs.withColumn("_run", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_home", "_cut"))
    starts = _late_starts(runs, [cluster, "_run"], int(span_days * DAY)).select(cluster, "_n", F.lit(1).alias("_late"))
    out = runs.join(starts, [cluster, "_n"], "left")
    number = F.col("_run") + F.coalesce(F.sum("_late").over(W.partitionBy(cluster).orderBy("_n").rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return out.withColumn("segment", number.cast("int")).select(*visits.columns, "segment")


def _late_starts(rows: DataFrame, run: list[str], span: int) -> DataFrame:
    """(run, _n) of rows (run, _n, t) at which a new segment begins as more than span has passed since the last one's first; a run's first is none."""
    ends = rows.groupBy(*run).agg(F.min("_n").alias("_first"), (F.max("t") - F.min("t") > span).alias("_long")).where("_long")
    inside = rows.select(*run, "_n", "t").join(ends.select(*run), run)
    # every visit also as a mark of when its segment would be full, behind the visits of that time
    marked = inside.withColumn("_mark", F.explode(F.array(F.lit(False), F.lit(True))))
    w = W.partitionBy(*run).orderBy(F.when(F.col("_mark"), F.col("t") + span).otherwise(F.col("t")), "_mark").rowsBetween(W.unboundedPreceding, 0)
    last = marked.select(*run, "_n", "_mark", F.max(F.when(~F.col("_mark"), F.col("_n"))).over(w).alias("_to")).where("_mark")
    jump = written(last.select(*run, "_n", (F.col("_to") + 1).alias("_to")).join(inside.select(*run, F.col("_n").alias("_to")), [*run, "_to"], "left_semi"))
    reached = written(ends.select(*run, F.col("_first").alias("_n")))
    while True:
        new = reached.join(jump, [*run, "_n"]).select(*run, F.col("_to").alias("_n"))
        if not new.limit(1).collect():
            return reached.join(ends.select(*run, F.col("_first").alias("_n")), [*run, "_n"], "left_anti")
        reached = written(reached.unionByName(new).distinct())
        after = jump.select(*run, F.col("_n").alias("_to"), F.col("_to").alias("_next"))
        jump = written(jump.join(after, [*run, "_to"]).select(*run, "_n", F.col("_next").alias("_to")))


def at_home(lon: Column, lat: Column, names: list[Column], home: str, centre: tuple[float, float], km: float = 120.0) -> Column:
    """Whether a visit is at home: one of its names (province, city) holds the home's, or it lies within km of the centre."""
    named = F.lit(False)
    for name in names:
        named = named | F.coalesce(F.contains(name, F.lit(home)), F.lit(False))
    return named | F.coalesce(haversine(lon, lat, F.lit(centre[0]), F.lit(centre[1])) <= km, F.lit(False))


def drop_singletons(rows: DataFrame, segment: list[str], least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows of segments with enough members, the rest)."""
    sized = rows.withColumn("_n", F.count("*").over(W.partitionBy(*segment)))
    return sized.where(F.col("_n") >= least).drop("_n"), sized.where(F.col("_n") < least).drop("_n")


def trip_kind(rows: DataFrame, segment: list[str], home: Column, km: float = 300.0, names: tuple[str, ...] = ("city", "district", "province")) -> DataFrame:
    """(segment, kind): travel_route with a long leg; local_sequence all at home; destination_stay in one city and one province at most; else travel_route.

    The city is the first of names that the rows have and that is not empty; a visit without any counts as in no city.
    """
    w = W.partitionBy(*segment).orderBy("t", "visit_id")
    leg = haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    city = F.coalesce(*[filled(c) for c in names if c in rows.columns])
    out = rows.withColumn("_km", leg).groupBy(*segment).agg(
        F.coalesce(F.bool_or(F.col("_km") > km), F.lit(False)).alias("_long"), F.bool_and(F.coalesce(home, F.lit(False))).alias("_home"), F.count_distinct(city).alias("_c"), F.count_distinct(filled("province")).alias("_p")
    )
    kind = F.when(F.col("_long"), "travel_route").when(F.col("_home"), "local_sequence").when((F.col("_c") <= 1) & (F.col("_p") <= 1), "destination_stay").otherwise("travel_route")
    return out.select(*segment, kind.alias("kind"))


def route_sequence(rows: DataFrame, segment: list[str]) -> DataFrame:
    """Adds sequence, the 0-based position in time order."""
    return rows.withColumn("sequence", F.row_number().over(W.partitionBy(*segment).orderBy("t", "visit_id")) - 1)


def build_trips(rows: DataFrame, segment: list[str], home: Column, themes: str | None = None, top: int = 8) -> DataFrame:
    """Trips from segmented visits: id, bounds, ordered members and route, regions, kind, mean confidence, top themes."""
    kept, _ = drop_singletons(rows, segment)
    routed = route_sequence(kept, segment)
    step = F.struct("sequence", "visit_id", "lon", "lat", "t")
    trips = routed.groupBy(*segment).agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.array_sort(F.collect_list(step)).alias("route"), F.array_sort(F.collect_set("province")).alias("provinces"),
        F.array_sort(F.collect_set("city")).alias("cities"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )
    ids = F.transform("route", lambda r: r["visit_id"])
    trips = trips.withColumn("visit_ids", ids).withColumn("trip_id", stable_id("trip", F.concat_ws("\0", ids.cast("array<string>"))))
    trips = trips.join(trip_kind(kept, segment, home), segment)
    if themes:
        counts = kept.groupBy(*segment, themes).agg(F.count("*").alias("_n"))
        ranked = counts.withColumn("_r", F.row_number().over(W.partitionBy(*segment).orderBy(F.desc("_n"), themes))).where(F.col("_r") <= top)
        lists = ranked.groupBy(*segment).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", themes))), lambda x: x[themes]).alias("themes"))
        trips = trips.join(lists, segment, "left")
    return trips


def islands(df: DataFrame, group: list[str], value: str, step: int = 2) -> DataFrame:
    """(group, first, last, n): runs of distinct values whose steps are at most step."""
    d = df.select(*group, value).distinct()
    w = W.partitionBy(*group).orderBy(value)
    new = F.coalesce(F.col(value) - F.lag(value).over(w) > step, F.lit(True)).cast("int")
    runs = d.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*group, "_run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("_run")


def unique_titles(df: DataFrame, title: str, key: str, time: str) -> DataFrame:
    """Adds final_title: duplicated titles get (year-month); of those still equal all but the first get an id suffix."""
    count = F.count("*").over(W.partitionBy(title))
    dated = F.when(count > 1, F.concat(F.col(title), F.lit(" ("), F.date_format(F.timestamp_micros(time), "yyyy-MM"), F.lit(")"))).otherwise(F.col(title))
    out = df.withColumn("_t", dated)
    nth = F.row_number().over(W.partitionBy("_t").orderBy(time, key))
    return out.withColumn("final_title", F.when(nth > 1, F.concat(F.col("_t"), F.lit(" #"), F.col(key).cast("string"))).otherwise(F.col("_t"))).drop("_t")


def resolve_overlaps(spans: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, start, end, type, term, priority, confidence, sources, kept): which spans stay, greedily by length, priority, confidence, start.

    Spans of equal bounds, type and term are one, with all their sources and the best confidence; end is exclusive, so
    touching spans do not overlap, and an empty span overlaps those around it. Ties go by type and term. A record's spans, by their starts, fall into
    islands, each beginning where all spans before have ended: spans of different islands cannot clash. So the greedy choice
    is a fold over each island; a span that is its own island stays.
    """
    name = ["start", "end", "type", "term"]
    merged = spans.groupBy(key, *name).agg(F.min("priority").alias("priority"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    w = W.partitionBy(key).orderBy("start", "end", "type", "term")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    begins = merged.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    islands = begins.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    best = F.struct((F.col("start") - F.col("end")).alias("o1"), F.col("priority").alias("o2"), (-F.col("confidence")).alias("o3"), *name, "priority", "confidence", "sources")
    lists = islands.groupBy(key, "_island").agg(F.array_sort(F.collect_list(best)).alias("_s"))
    taken = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n", T.IntegerType())]))

    def step(acc: Column, x: Column) -> Column:
        s, n = x["s"], x["n"]
        clash = F.exists(acc, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"]))
        one = F.array(F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), n.alias("n")))
        return F.when(clash, acc).otherwise(F.concat(acc, one))

    counted = F.transform("_s", lambda s, n: F.struct(s.alias("s"), n.alias("n")))
    folded = F.transform(F.aggregate(counted, F.array().cast(taken), step), lambda k: k["n"])
    chosen = lists.select(key, "_s", F.when(F.size("_s") == 1, F.array(F.lit(0))).otherwise(folded).alias("_kept"))
    return chosen.select(key, "_kept", F.posexplode("_s").alias("_n", "_x")).select(key, *[f"_x.{c}" for c in (*name, "priority", "confidence", "sources")], F.array_contains("_kept", F.col("_n")).alias("kept"))


def overlap_counts(resolved: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, n_kept, n_rejected) of the spans that resolve_overlaps() judged."""
    return resolved.groupBy(key).agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_rejected"))


def highlight_segments(posts: DataFrame, marks: DataFrame, key: str = "post_id", text: str = "content") -> DataFrame:
    """(key, start, marked, segment): the text cut into plain and marked pieces, in order; marks (start, end) do not overlap."""
    w = W.partitionBy(key).orderBy("start")
    m = marks.select(key, "start", "end", F.coalesce(F.lag("end").over(w), F.lit(0)).alias("_from"), F.lead("start").over(w).isNull().alias("_last"))
    joined = m.join(posts.select(key, F.col(text).alias("_x")), key)
    piece = lambda a, b, on: F.struct(a.cast("long").alias("start"), F.lit(on).alias("marked"), F.substring(F.col("_x"), (a + 1).cast("int"), (b - a).cast("int")).alias("segment"))
    pieces = F.array(piece(F.col("_from"), F.col("start"), False), piece(F.col("start"), F.col("end"), True), F.when(F.col("_last"), piece(F.col("end"), F.length("_x"), False)))
    cut = joined.select(key, F.explode(F.array_compact(pieces)).alias("p")).select(key, "p.*")
    whole = posts.join(marks.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast("long").alias("start"), F.lit(False).alias("marked"), F.col(text).alias("segment"))
    return cut.unionByName(whole).where("segment <> ''")


def first_n(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def best_labels(labels: DataFrame, n: int = 10) -> DataFrame:
    """(post_id, type, name, confidence): each label's best confidence, the best labels of each post and type."""
    best = labels.groupBy("post_id", "type", "name").agg(F.max("confidence").alias("confidence"))
    return best.withColumn("_n", F.row_number().over(W.partitionBy("post_id", "type").orderBy(F.desc("confidence"), "name"))).where(F.col("_n") <= n).drop("_n")


def overlaps(mentions: DataFrame, key: str = "post_id") -> DataFrame:
    """Mentions that start before the one before them ends."""
    w = W.partitionBy(key).orderBy("start", "end")
    return mentions.withColumn("previous_end", F.lag("end").over(w)).where(F.col("start") < F.col("previous_end"))
