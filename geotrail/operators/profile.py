"""Profiling and data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _state(present: Column, kind: Column, value: Column) -> Column:
    shape = F.schema_of_variant(value)
    right = F.when(kind == "NUMBER", shape.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)")).otherwise(F.startswith(shape, kind))
    empty = F.when(shape == "STRING", F.trim(F.try_variant_get(value, "$", "string")) == "").otherwise(shape.isin("ARRAY<VOID>", "OBJECT<>"))
    return F.when(~present, "missing").when(shape == "VOID", "null").when(~right, "wrong_type").when(empty, "empty").otherwise("nonempty")


STATES = ("missing", "null", "empty", "nonempty", "wrong_type")


def _states(fields: dict[str, str]) -> dict[str, Column]:
    """The state of every field of the variant _doc."""
    out = {}
    for name, kind in fields.items():
        value = F.try_variant_get("_doc", f"$.{name}", "variant")
        out[name] = _state(value.isNotNull(), F.lit(kind), value)
    return out


def field_states(rows: DataFrame, fields: dict[str, str], line: str = "line") -> DataFrame:
    """The rows once per field, with field and state of a JSON object's text: missing, null, empty, nonempty or wrong_type.

    fields maps a name to STRING, NUMBER, BOOLEAN, OBJECT or ARRAY. Each line is parsed once.
    """
    parsed = rows.withColumn("_doc", F.try_parse_json(line))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), s.alias("state")) for f, s in _states(fields).items()]))
    return parsed.select(*rows.columns, pairs.alias("_f")).select(*rows.columns, "_f.field", "_f.state")


def field_coverage(raw: DataFrame, fields: dict[str, str], line: str = "line") -> DataFrame:
    """Per field the rows in total and in each state; present is all that is not missing. One pass, one parse, one row to unpivot."""
    parsed = raw.select(F.try_parse_json(line).alias("_doc")).select(F.array(*_states(fields).values()).alias("_s"))
    each = [F.struct(*[F.count_if(F.get("_s", F.lit(k)) == n).alias(f"n_{n}") for n in STATES]).alias(f"_{k}") for k in range(len(fields))]
    counts = parsed.agg(F.count("*").alias("total"), *each)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{k}").alias("c")) for k, f in enumerate(fields)])
    out = counts.select("total", F.explode(rows).alias("r")).select("r.field", "total", "r.c.*")
    return out.select("field", "total", (F.col("total") - F.col("n_missing")).alias("present"), *[f"n_{n}" for n in STATES])


def duplicates(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Every row after the first of its key, with the line of the first."""
    w = W.partitionBy(*keys).orderBy(line)
    marked = df.select(*keys, F.col(line), F.row_number().over(w).alias("n"), F.first(line).over(w).alias("first_line"))
    return marked.where("n > 1").drop("n")


def histogram(df: DataFrame, columns: list[str], missing: str = "<missing>") -> DataFrame:
    """(column, value, n) for each of the columns; nulls are the bucket missing."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def counters(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """One row: how often each predicate holds, all in one pass."""
    return df.agg(*[F.count_if(p).alias(name) for name, p in predicates.items()])


def len_mismatch(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two arrays differ in length; null has length 0."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return df.withColumns({"len_a": F.greatest(size(a), F.lit(0)), "len_b": F.greatest(size(b), F.lit(0))}).where("len_a <> len_b")


def candidate_issues(items: DataFrame, sources: list[str], text: str = "content") -> DataFrame:
    """Label items (name, confidence, source, text) with the array of what is wrong with each."""
    c = F.col("confidence")
    issues = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "empty_name"),
            F.when(c.isNull(), "missing_confidence").when((c < 0) | (c > 1), "invalid_confidence"),
            F.when(F.col("source").isNull(), "missing_source").when(~F.col("source").isin(sources), "invalid_source"),
            F.when((F.col("source") == "text") & ~F.coalesce(F.contains(F.col(text), F.col("name")), F.lit(False)), "not_in_text"),
        )
    )
    return items.withColumn("issues", issues)


def enum_violations(df: DataFrame, column: str, domain: list) -> DataFrame:
    """Values outside a closed domain with their counts; nulls are no values."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(domain)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def issue_sample(issues: DataFrame, order: list[str], n: int = 500) -> DataFrame:
    """The first n issues in scan order."""
    return issues.orderBy(*order).limit(n)


def first_class(flags: dict[str, Column], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = None
    for name, p in flags.items():
        out = F.when(p, name) if out is None else out.when(p, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def classify_posts(posts: DataFrame, media: DataFrame, key: str, evidence: dict[str, Column], classes: dict[str, Column], otherwise: str = "Q", last: str | None = None) -> DataFrame:
    """Each post with its class: evidence flags of its media are combined by OR, then the first class that holds is taken.

    With last, a column that orders the media, only each post's last medium counts.
    """
    named = media.select(key, *[last] if last else [], *[F.coalesce(p, F.lit(False)).alias(n) for n, p in evidence.items()])
    flags = named.groupBy(key).agg(*[F.max_by(n, last) if last else F.bool_or(n) for n in evidence]).toDF(key, *evidence)
    joined = posts.join(flags, key, "left").fillna(False, list(evidence))
    return joined.withColumn("record_class", first_class(classes, otherwise))


def multi_distinct(df: DataFrame, key: list[str], column: str, most: int = 20) -> DataFrame:
    """Groups with more than one distinct value: how many, and the first ones in order; no list grows beyond most."""
    values = df.select(*key, column).where(F.col(column).isNotNull()).distinct()
    ranked = values.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(column)))
    first = F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.col(column))))
    return ranked.groupBy(*key).agg(F.count("*").alias("n_names"), first.alias("names")).where("n_names > 1")


def gates(metrics: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(gate, passed) from a one-row table of metrics."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), p.alias("passed")) for n, p in conditions.items()]))
    return metrics.select(pairs.alias("g")).select("g.*")


def coverage_by_grain(media: DataFrame, key: str, predicates: dict[str, Column]) -> DataFrame:
    """(grain, total, one count per predicate): over media, and over posts that have such a medium."""
    fine = media.select(key, *[F.coalesce(p, F.lit(False)).alias(n) for n, p in predicates.items()])
    coarse = fine.groupBy(key).agg(*[F.bool_or(n).alias(n) for n in predicates])
    counted = [d.agg(F.lit(g).alias("grain"), F.count("*").alias("total"), *[F.count_if(F.col(n)).alias(n) for n in predicates]) for g, d in (("media", fine), ("post", coarse))]
    return reduce(DataFrame.unionByName, counted)
