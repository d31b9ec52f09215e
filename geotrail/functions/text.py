"""String and scalar functions on columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unicode_form(c: Column, form: str) -> Column:
    """A Unicode normalization form, which has no built-in function. ASCII texts stay as they are and don't go to Python, others go there few at a time, as one may be very long."""

    @F.udf("string", useArrow=False)
    def normalize(text: str | None) -> str | None:
        return None if text is None else unicodedata.normalize(form, text)

    plain = F.length(c) == F.octet_length(c)
    return F.coalesce(F.when(plain, c), normalize(F.when(~plain, c)))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def norm_nfkd(c: Column) -> Column:
    """Compatibility form without marks, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(unicode_form(c, "NFKD"), r"\p{M}+", "")), r"[^\p{L}\p{N}]+", "")


def norm_nfkc(c: Column, punctuation: bool = False) -> Column:
    """Compatibility form, lower case, without white space; without punctuation too if asked."""
    return F.regexp_replace(F.lower(unicode_form(c, "NFKC")), r"[\s\p{P}]+" if punctuation else r"\s+", "")


#: Words that make a bracket at the end of a name one of a branch, branch suffixes, and what a normalized name may end with.
BRANCH_WORDS = ("总店", "分店", "旗舰店", "店", "馆", "商场", "中心", "广场")
BRANCH_SUFFIX = r"(总店|旗舰店|直营店|第\d+分店|分店)$"
STORE_SUFFIX, KIND_SUFFIX = "(旗舰|总|分|新|老)?店$", "(餐厅|饭店|酒家|酒楼|菜馆|食府|小馆|面馆|火锅|烧烤)$"


def base_name(c: Column) -> Column:
    """A name without a bracket at its end that holds a word for a branch, then without a branch suffix. Other brackets and suffixes stay."""
    bracket = rf"[（(][^()（）]*({'|'.join(BRANCH_WORDS)})[^()（）]*[)）]\s*$"
    return F.regexp_replace(F.regexp_replace(c, bracket, ""), BRANCH_SUFFIX, "")


def base_of_normalized(c: Column) -> Column:
    """A normalized name without the word for a store at its end, then without the kind of house."""
    return F.regexp_replace(F.regexp_replace(c, STORE_SUFFIX, ""), KIND_SUFFIX, "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 where one is empty, 1 where they are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))


def contains_either(a: Column, b: Column) -> Column:
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))


def contain_similarity(a: Column, b: Column) -> Column:
    """Equal 1; one inside the other 0.75 + 0.2 x length ratio; else the edit similarity."""
    return F.when((a == b) & (F.length(a) > 0), 1.0).when(contains_either(a, b), 0.75 + 0.2 * length_ratio(a, b)).otherwise(edit_similarity(a, b))


def bigrams(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Multiset overlap of bigrams, 0 for a single letter; where one text holds the other, their length ratio, at least 0.65, or 0.5 for two letters."""
    count = lambda xs, g: F.size(F.filter(xs, lambda v: v == g))

    def overlap(r: Column) -> Column:
        shared = F.aggregate(F.array_distinct(r["x"]), F.lit(0), lambda s, g: s + F.least(count(r["x"], g), count(r["y"], g)))
        return 2 * shared / (F.size(r["x"]) + F.size(r["y"]))

    plain = once(F.struct(bigrams(a).alias("x"), bigrams(b).alias("y")), overlap)
    shorter = F.least(F.length(a), F.length(b))
    held = F.greatest(length_ratio(a, b), F.when(shorter >= 3, 0.65).when(shorter == 2, 0.5).otherwise(0.0))
    return F.when(shorter == 0, 0.0).when(a == b, 1.0).when(contains_either(a, b), held).when(shorter == 1, 0.0).otherwise(plain)


def name_relation(a: Column, b: Column, norm_a: Column, norm_b: Column, least: float = 0.7) -> Column:
    """struct(relation, score) of two raw names and their normalized forms."""
    ba, bb = F.lower(base_name(a)), F.lower(base_name(b))
    score = edit_similarity(norm_a, norm_b)
    kind = F.when(norm_a == norm_b, "normalized_equal").when((ba == bb) & (ba != ""), "base_equal").when(contains_either(norm_a, norm_b), "contains").when(score >= least, "edit_similar").otherwise("different")
    return F.struct(kind.alias("relation"), score.alias("score"))


def best_name(keyword: Column, names: Column, norm: Callable[[Column], Column] = lambda c: F.lower(F.trim(c))) -> Column:
    """struct(score, kind, name) of the best of an array of names; the first wins a tie. Null and blank names don't count.

    Names and their bases are compared in the form that norm gives. Without a similar name the score is 0, the kind none.
    """
    key = F.struct(norm(keyword).alias("k"), norm(base_name(keyword)).alias("kb"))

    def forms(name: Column) -> Column:
        return F.struct(name.alias("name"), norm(name).alias("n"), norm(base_name(name)).alias("nb"))

    def compared(key: Column) -> Callable[[Column], Column]:
        return lambda x: F.struct(
            x["name"].alias("name"),
            edit_similarity(key["k"], x["n"]).alias("edit"),
            edit_similarity(key["kb"], x["nb"]).alias("base"),
            (contains_either(key["kb"], x["nb"]) & (F.least(F.length(key["kb"]), F.length(x["nb"])) >= 2)).alias("inside"),
            ((key["k"] == x["n"]) & (key["k"] != "")).alias("exact"),
            ((key["kb"] == x["nb"]) & (key["kb"] != "")).alias("same"),
            length_ratio(key["kb"], x["nb"]).alias("ratio"),
        )

    def scored(x: Column, i: Column) -> Column:
        best = F.greatest(x["edit"], x["base"])
        score = F.when(x["exact"], 1.0).when(x["same"], F.greatest(F.lit(0.96), best)).when(x["inside"], F.greatest(best, 0.72 + 0.18 * x["ratio"])).otherwise(best)
        kind = F.when(x["exact"], "exact").when(x["same"], "same_base").when(x["inside"], "contains").when(x["base"] > x["edit"], "base_edit").otherwise("edit")
        return F.struct(score.alias("score"), (-i).alias("order"), kind.alias("kind"), x["name"].alias("name"))

    def chosen(top: Column) -> Column:
        found = top["score"] > 0
        return F.struct(F.coalesce(top["score"], F.lit(0.0)).alias("score"), F.when(found, top["kind"]).otherwise("none").alias("kind"), F.when(found, top["name"]).otherwise("").alias("name"))

    named = F.transform(F.filter(names, lambda x: F.trim(x) != ""), forms)
    return once(once(key, lambda key: F.array_max(F.transform(F.transform(named, compared(key)), scored))), chosen)


def clue_match(clues: Column, fields: Column) -> Column:
    """The clues that hold, or are held in, any of the fields."""
    return F.filter(clues, lambda c: F.exists(fields, lambda f: contains_either(c, f)))


def type_compat(kind: Column, code: Column, type_text: Column, rules: dict[str, tuple[str, str]]) -> Column:
    """Whether a type fits a kind, by a prefix of the type's code or a pattern of its text for each kind; any type fits a kind without a rule."""
    out = F.lit(True)
    for name, (prefix, pattern) in rules.items():
        fits = F.coalesce(F.startswith(code, F.lit(prefix)), F.lit(False)) | F.coalesce(type_text.rlike(pattern), F.lit(False))
        out = F.when(kind == name, fits).otherwise(out)
    return out


def is_generic(c: Column, patterns: list[str], stop: list[str]) -> Column:
    """Names that describe instead of naming: shorter than two characters, on the stop list, or of a pattern."""
    return (F.length(F.trim(c)) < 2) | F.lower(F.trim(c)).isin(stop) | c.rlike("(?i)" + "|".join(patterns))


def stable_id(prefix: str, *parts: Column, digits: int = 20) -> Column:
    """prefix_ and the first digits of the SHA-256 of the parts, joined by NUL."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, digits))


def flatten_text(df: DataFrame) -> Column:
    """One text of all strings of all columns, nested ones too, in column order."""
    from pyspark.sql import types as T

    def texts(c: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.array(c)
        if isinstance(kind, T.StructType):
            inner = [x for f in kind.fields if (x := texts(c[f.name], f.dataType)) is not None]
            return F.flatten(F.array(*inner)) if inner else None
        if isinstance(kind, T.ArrayType):
            probe = texts(F.lit(None).cast(kind.elementType), kind.elementType)
            return None if probe is None else F.flatten(F.transform(c, lambda x: texts(x, kind.elementType)))
        return None

    found = [x for f in df.schema.fields if (x := texts(F.col(f.name), f.dataType)) is not None]
    return F.concat_ws(" ", F.flatten(F.array(*[F.coalesce(x, F.array()) for x in found]))) if found else F.lit("")


def confidence_bin(c: Column, high: float = 0.85, medium: float = 0.65) -> Column:
    return F.when(c >= high, "high").when(c >= medium, "medium").otherwise("low")


def parse_lnglat(c: Column) -> Column:
    """struct(lng, lat, location) of "lng,lat" text in range, else null; location has six decimals."""
    parts = F.split(c, ",")
    x, y = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    ok = (F.size(parts) == 2) & F.abs(x).between(0, 180) & F.abs(y).between(0, 90)
    return F.when(ok, F.struct(x.alias("lng"), y.alias("lat"), F.format_string("%.6f,%.6f", x, y).alias("location")))


def looks_like_region(c: Column, suffixes: str = "省|市|区|县|州|镇|乡|村|盟|旗|岛") -> Column:
    return F.length(c).between(2, 20) & c.rlike(f"({suffixes})$")


def destination(c: Column, words: list[str], default: str) -> Column:
    """A title without its journey words; default where nothing is left."""
    left = F.trim(F.regexp_replace(F.regexp_replace(c, "(?i)" + "|".join(words), " "), r"\s+", " "))
    return F.coalesce(F.nullif(left, F.lit("")), F.lit(default))


def admin_from_text(c: Column, keywords: dict[str, str]) -> Column:
    """The area of the first keyword of a list that stands in a text."""
    out = F.lit(None).cast("string")
    for word, area in reversed(keywords.items()):
        out = F.when(F.contains(c, F.lit(word)), area).otherwise(out)
    return out


def date_parts(start: Column, end: Column) -> Column:
    """struct(year, label, range_label, hours, days) of two timestamps; one date where both are the same day."""
    day = lambda t: F.date_format(t, "yyyy-MM-dd")
    gap = F.unix_micros(end) - F.unix_micros(start)
    label = F.when(day(start) == day(end), day(start)).otherwise(F.concat(day(start), F.lit(" - "), day(end)))
    return F.struct(F.year(start).alias("year"), day(start).alias("label"), label.alias("range_label"), (gap / 3.6e9).alias("hours"), (gap / 8.64e10).alias("days"))
