"""Reading records that may be broken, and writing tables once."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names. Where it is unset, local mode gets a temporary one; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a written table in the shared folder of the cluster, partitioned by a column if asked."""
    spark = df.sparkSession
    path = shared_folder(spark)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parse_whole(text: Column) -> Column:
    """The text as a variant if all of it is one JSON value, else null; the built-in parser stops after the first value."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of JSON lines; blank lines are no records."""
    return spark.read.schema(schema).json(path)


def scan_with_quarantine(lines: DataFrame, line: str = "line", number: str = "line_no", excerpt: int = 240) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of text lines. Only objects are good; bad keeps (number, error, raw_excerpt). Blank lines are neither."""
    shape = F.schema_of_variant(parse_whole(F.col(line)))
    error = F.when(F.startswith(shape, F.lit("OBJECT")), F.lit(None)).when(shape.isNotNull(), "not_object").otherwise("malformed")
    # one row makes one row, and the filters below do not parse again
    marked = lines.where(F.trim(line) != "").select("*", F.explode(F.array(error)).alias("error"))
    bad = marked.where(F.col("error").isNotNull()).select(number, "error", F.substring(line, 1, excerpt).alias("raw_excerpt"))
    return marked.where(F.col("error").isNull()).drop("error"), bad


def read_json_dir(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Every JSON document of a folder, with its file; order by file for the order of names."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table, or an empty one where the path is missing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


FEATURES = (
    "type string, features array<struct<type:string, properties:struct<name:string, level:string, code:string, rank:double>, "
    "geometry:struct<type:string, coordinates:string>>>"
)


def read_features(spark: SparkSession, paths: list[str], level: str, schema: str = FEATURES) -> DataFrame:
    """One row per feature of several feature collections. Coordinates stay JSON text until a geometry is needed."""
    one = [spark.read.schema(schema).json(p, multiLine=True).select(F.explode("features").alias("f")) for p in paths]
    return reduce(DataFrame.unionByName, one).select("f.properties.*", "f.geometry").withColumn("level", F.lit(level))


def record_key(*ids: str, number: str) -> Column:
    """The first id that is present, else line:N."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ids], F.concat(F.lit("line:"), F.col(number)))


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write a table where none exists, and read it; the job's commit publishes it."""
    df.write.mode("errorifexists").format(fmt).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def write_keyed(df: DataFrame, key: str, path: str, buckets: int = 16) -> DataFrame:
    """One row per key, dealt over folders by the key's hash so that a reader of one key opens one folder.

    Every task writes its part of each folder, so the work is not bound to the number of folders.
    """
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*").select(*df.columns)
    hashed = first.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    hashed.write.mode("errorifexists").partitionBy("bucket").parquet(path)
    return df.sparkSession.read.parquet(path).select(*df.columns)


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): independent of the order of rows; repeated rows count. Sums are decimals, which no number of rows overflows."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]), 256)
    part = [F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"p{k}") for k in range(4)]
    return df.agg(F.count("*").alias("rows"), *part).select("rows", F.concat_ws("-", *[F.coalesce(F.col(f"p{k}").cast("string"), F.lit("0")) for k in range(4)]).alias("digest"))


def pick_keys(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the keys asked for, keys not found)."""
    return df.join(keys, key, "left_semi"), keys.join(df, key, "left_anti")


def pending(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return inputs.join(results, key, "left_anti")


def collect_outcomes(inputs: DataFrame, results: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """The inputs with outcome result, error or pending; a result wins over an error."""
    done = results.select(key).distinct().withColumn("_r", F.lit(True))
    failed = errors.select(key).distinct().withColumn("_e", F.lit(True))
    outcome = F.when(F.col("_r"), "result").when(F.col("_e"), "error").otherwise("pending")
    return inputs.join(done, key, "left").join(failed, key, "left").withColumn("outcome", outcome).drop("_r", "_e")


def publish(df: DataFrame, key: str, whitelist: list[str]) -> DataFrame:
    """(key, document): one JSON document per key with the listed columns only, nulls left out."""
    return df.select(F.col(key), F.to_json(F.struct(*whitelist)).alias("document"))
