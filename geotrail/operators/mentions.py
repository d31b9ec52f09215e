"""Mentions of terms in texts. Offsets are code points, 0-based, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dice, norm_nfkc, stable_id
from ..sources.io import written
from .sequences import overlap_counts, resolve_overlaps

#: Which type wins an overlap of equal spans.
PRIORITY = {"restaurant": 0, "dish": 1, "cuisine": 2, "region": 3}


#: Sources that count where a review exists, and what tells a restaurant's point.
TRUSTED = ("text_llm_exact_candidate", "selected_amap_poi_name", "amap_region_exact_in_text", "explicit_region_extraction")
RESTAURANT_CODE, RESTAURANT_TYPE = "^05", "(?i)餐饮|餐厅|饭店|小吃|咖啡|酒吧|restaurant"


def find_terms(text: str, terms: list[str]) -> list[list[int]]:
    """0-based starts of each term's occurrences that don't overlap one another, left to right. One pass over the text for all terms; an empty term has none."""
    import ahocorasick

    words = ahocorasick.Automaton()
    for term in terms:
        if term:
            words.add_word(term, term)
    found: dict[str, list[int]] = {}
    if len(words):
        words.make_automaton()
        for last, term in words.iter(text):
            starts, start = found.setdefault(term, []), last + 1 - len(term)
            if not starts or start >= starts[-1] + len(term):
                starts.append(start)
    return [found.get(term, []) for term in terms]


def occurrences(text: Column, terms: Column) -> Column:
    """array of find_terms() for an array of terms; null texts and terms have none. Texts go to Python few at a time, as one may be very long."""

    @F.udf("array<array<int>>", useArrow=False)
    def starts(text: str | None, terms: list[str | None]) -> list[list[int]]:
        return find_terms(text or "", ["" if t is None else t for t in terms])

    return starts(text, terms)


def locate_terms(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms with (start, end) of every occurrence in their post. A post's terms meet its text together, so the text is read once and not repeated for each."""
    rest = [c for c in terms.columns if c != "post_id"]
    lists = terms.groupBy("post_id").agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    joined = lists.join(posts.select("post_id", "content"), "post_id")
    found = joined.select("post_id", F.arrays_zip("_rows", occurrences(F.col("content"), F.transform("_rows", lambda r: r["term"])).alias("_starts")).alias("_r"))
    out = found.select("post_id", F.explode("_r").alias("_r")).where(F.size("_r._starts") > 0).select("post_id", "_r._rows.*", F.explode("_r._starts").alias("start"))
    return out.withColumn("end", F.col("start") + F.length("term"))


def located_sources(posts: DataFrame, sources: DataFrame, generic: list[str], least: int = 2) -> DataFrame:
    """(post_id, type, term, sources, confidence, start, end): the usable terms, merged over their sources, where they stand in the post's text.

    sources is (post_id, type, term, source, confidence); other types than those of PRIORITY are left out. Terms are trimmed; those of
    restaurants that are generic in their normalized form don't count.
    """
    usable = sources.withColumn("term", F.trim("term")).where((F.length("term") >= least) & F.col("type").isin(*PRIORITY))
    merged = usable.groupBy("post_id", "type", "term").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max("confidence").alias("confidence"))
    found = locate_terms(posts, merged)
    return found.where((F.col("type") != "restaurant") | ~norm_nfkc(F.col("term")).isin(*generic))


def collect_terms(posts: DataFrame, sources: DataFrame, generic: list[str], least: int = 2) -> DataFrame:
    """(post_id, type, term, sources, confidence): the terms of located_sources(), once each."""
    return located_sources(posts, sources, generic, least).groupBy("post_id", "type", "term").agg(F.first("sources").alias("sources"), F.first("confidence").alias("confidence"))


def authoritative_terms(terms: DataFrame, reviews: DataFrame, trusted: tuple[str, ...] = TRUSTED) -> DataFrame:
    """Where a valid review (post_id, valid, discarded terms) exists: without what it discards, in normalized form, and from trusted sources only."""
    valid = reviews.where("valid").select("post_id", F.explode_outer("discarded").alias("_d")).groupBy("post_id").agg(F.collect_set(norm_nfkc(F.col("_d"))).alias("discarded"))
    joined = terms.join(valid, "post_id", "left").withColumn("_norm", norm_nfkc(F.col("term")))
    ok = F.col("discarded").isNull() | (~F.array_contains("discarded", F.col("_norm")) & F.arrays_overlap("sources", F.array(*map(F.lit, trusted))))
    return joined.where(ok).drop("discarded", "_norm")


def similar_name(c: Column) -> Column:
    """A name as it is compared: normalized, without a short bracket at its end, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(norm_nfkc(c), r"[（(][^（）()]{0,20}(店|馆|分店)?[）)]$", ""), r"[^\p{L}\p{N}]", "")


def restaurant_points(points: DataFrame) -> DataFrame:
    """Points with an id whose type code, type text or extraction kind is that of a restaurant (columns typecode, type, extraction_kind)."""
    true = lambda c: F.coalesce(c, F.lit(False))
    known = F.col("poi_id").isNotNull() & (F.col("poi_id").cast("string") != "")
    return points.where(known & (true(F.col("typecode").rlike(RESTAURANT_CODE)) | true(F.col("type").rlike(RESTAURANT_TYPE)) | true(F.col("extraction_kind") == "restaurant")))


def link_places(mentions: DataFrame, points: DataFrame, least: float = 0.45) -> DataFrame:
    """(post_id, term, matches, status): the restaurant points (post_id, poi_id, name, typecode, type, extraction_kind) of the post whose names are alike."""
    terms = mentions.select("post_id", "term").distinct()
    named = terms.withColumn("_a", similar_name(F.col("term")))
    places = restaurant_points(points).select("post_id", "poi_id", similar_name(F.col("name")).alias("_b"))
    hits = named.join(places, "post_id").where(dice(F.col("_a"), F.col("_b")) >= least).groupBy("post_id", "term").agg(F.array_sort(F.collect_set("poi_id")).alias("matches"))
    out = terms.join(hits, ["post_id", "term"], "left").withColumn("matches", F.coalesce("matches", F.array()))
    n = F.size("matches")
    return out.withColumn("status", F.when(n == 1, "unique_high").when(n > 1, "multiple").otherwise("unmatched"))


def resolved_mentions(located: DataFrame) -> DataFrame:
    """Every occurrence that located_sources() gives, with kept: see resolve_overlaps()."""
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return resolve_overlaps(located.withColumn("priority", F.coalesce(F.element_at(table, F.col("type")), F.lit(9))))


def build_mentions(posts: DataFrame, sources: DataFrame, points: DataFrame, generic: list[str], linked: str = "restaurant") -> DataFrame:
    """(post_id, start, end, type, term, sources, confidence, entity_id, mention_id, status, place_ids): located, without overlaps.

    Mentions of the linked type are linked with the restaurant points of their post; the status of all others is entity.
    """
    kept = resolved_mentions(located_sources(posts, sources, generic)).where("kept")
    links = link_places(kept.where(F.col("type") == linked), points).select("post_id", "term", F.lit(linked).alias("type"), "status", "matches")
    out = kept.join(links, ["post_id", "term", "type"], "left")
    entity = F.concat(F.lit("ent_"), F.col("type"), F.lit("_"), F.substring(F.sha2(F.concat_ws("\0", "type", norm_nfkc(F.col("term"))), 256), 1, 16))
    out = out.withColumn("entity_id", entity).withColumn("mention_id", stable_id("mention", F.col("post_id"), F.col("start"), F.col("end"), F.col("entity_id"), digits=16))
    place_ids = F.coalesce("matches", F.array().cast(f"array<{dict(points.dtypes)['poi_id']}>"))
    return out.select("post_id", "start", "end", "type", "term", "sources", "confidence", "entity_id", "mention_id", F.coalesce("status", F.lit("entity")).alias("status"), place_ids.alias("place_ids"))


def extraction_records(posts: DataFrame, sources: DataFrame, generic: list[str]) -> DataFrame:
    """(post_id, candidate_count, mention_count, overlap_rejected_count) of every post."""
    located = written(located_sources(posts, sources, generic))
    terms = located.groupBy("post_id").agg(F.count_distinct("type", "term").alias("candidate_count"))
    out = posts.select("post_id").join(terms, "post_id", "left").join(overlap_counts(resolved_mentions(located)), "post_id", "left")
    return out.select("post_id", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.coalesce("n_kept", F.lit(0)).alias("mention_count"), F.coalesce("n_rejected", F.lit(0)).alias("overlap_rejected_count"))


def mention_index(mentions: DataFrame, types: list[str]) -> DataFrame:
    """Per post: mentions, distinct terms in order, count of each type."""
    return mentions.groupBy("post_id").agg(F.count("*").alias("mentions"), F.array_sort(F.collect_set("term")).alias("terms"), *[F.count_if(F.col("type") == x).alias(f"n_{x}") for x in types])
