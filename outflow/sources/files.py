"""File sources and sinks: CSV drop zone, nested JSON statistics, samples, exports, stamped caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PENDING = "PENDING_REAL_DATA"


def read_dropzone_csv(spark: SparkSession, path: str, required: dict[str, str]) -> DataFrame:
    """Union by column name of the CSV files of a folder; one status row while files or required columns are missing.

    Files are read in groups of equal header lines, as a reader takes one header for all its files. A column that only
    some files have is null in the others; a value that does not fit its type becomes null.
    """
    pending = lambda note: spark.range(1).select(F.lit(PENDING).alias("status"), F.lit(note).alias("note"))
    try:
        lines = spark.read.format("text").load(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    except AnalysisException:
        return pending("no files")
    # One row per distinct header, with its files.
    firsts = lines.where("start = 0").groupBy("file").agg(F.first("value", ignorenulls=True).alias("header"))
    headers = firsts.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    if not headers:
        return pending("no files")
    parts = [spark.read.option("header", True).csv(row["files"]) for row in headers]
    missing = sorted(set(required) - {c for part in parts for c in part.columns})
    if missing:
        return pending("missing columns: " + ", ".join(missing))
    out = None
    for part in parts:
        typed = part.select([
            (F.col(f"`{name}`").try_cast(kind) if name in part.columns else F.lit(None).cast(kind)).alias(name) for name, kind in required.items()
        ])
        out = typed if out is None else out.unionByName(typed)
    return out


def _parsed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc, shape): every file as one VARIANT value; shape is null where it is no JSON, else map, list or other."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))
    kind = F.schema_of_variant("doc")
    shape = F.when(kind.startswith("OBJECT"), "map").when(kind.startswith("ARRAY"), "list").when(kind.isNotNull(), "other")
    return text.withColumn("shape", shape)


def read_category_counts_json(spark: SparkSession, path: str) -> DataFrame:
    """Files of nested {state: {category: n}} or of a list of rows to category totals and shares.

    List rows name their fields Category and Count, category and count, or category and n. Names are trimmed; list rows without one, states that hold no
    map and files that are neither shape are left aside (``rejected_category_files``).
    """
    docs = _parsed_files(spark, path)
    part = lambda c, at, kind: F.try_variant_get(c, at, kind)
    states = docs.where("shape = 'map'").select(F.explode(part(F.col("doc"), "$", "map<string,variant>")).alias("state", "held"))
    from_map = states.select(F.explode(part(F.col("held"), "$", "map<string,variant>")).alias("category", "held")).select(
        "category", part(F.col("held"), "$", "bigint").alias("n")
    )
    rows = docs.where("shape = 'list'").select(F.explode(part(F.col("doc"), "$", "array<variant>")).alias("row"))
    field = lambda name, kind: F.coalesce(part(F.col("row"), f"$.{name.title()}", kind), part(F.col("row"), f"$.{name}", kind))
    from_list = rows.select(F.coalesce(field("category", "string"), F.lit("")).alias("category"), F.coalesce(field("count", "bigint"), part(F.col("row"), "$.n", "bigint"), F.lit(0)).alias("n"))
    named = from_map.unionByName(from_list).withColumn("category", F.regexp_replace("category", r"^\s+|\s+$", ""))
    return category_shares(named.where("category <> ''"))


def rejected_category_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of the files that hold no counts."""
    reason = F.when(F.col("shape").isNull(), "not JSON").otherwise("neither a map nor a list")
    return _parsed_files(spark, path).where("shape IS NULL OR shape = 'other'").select("file", reason.alias("reason"))


def category_shares(counts: DataFrame) -> DataFrame:
    """(category, n) rows to totals per category and percent of the grand total."""
    totals = counts.groupBy("category").agg(F.sum("n").alias("n"))
    grand = totals.agg(F.sum("n").alias("g")).scalar()
    return totals.select("category", "n", F.round(100.0 * F.col("n") / F.greatest(grand, F.lit(1)), 4).alias("pct"))


def write_sample(df: DataFrame, path: str, order: list[str], n: int) -> None:
    """The n newest rows as CSV."""
    df.orderBy([F.col(c).desc() for c in order]).limit(n).write.mode("overwrite").option("header", True).csv(path)


def export_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{path}/{name}")


def _finite(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        infinite = F.abs(column) == F.lit(float("inf"))
        column = F.when(~(F.isnan(column) | infinite), column)
    return column.alias(field.name)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to null, so that written JSON stays valid."""
    return df.select([_finite(field) for field in df.schema.fields])


def cached_matrix(
    spark: SparkSession, stamp: str, builder: Callable[[], DataFrame], path: str, labels: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Reuse the matrix written under this stamp, else build and write it.

    A folder without its success mark is the rest of a broken write and is built anew. ``labels`` is applied to what was
    read, so that labels that have changed since are recomputed.
    """
    target = f"{path}/stamp={stamp}"
    try:
        spark.read.format("binaryFile").load(f"{target}/_SUCCESS").select("path").first()
    except AnalysisException:
        builder().write.mode("overwrite").parquet(target)
    matrix = spark.read.parquet(target)
    return labels(matrix) if labels else matrix


def check_contract(df: DataFrame, required: list[str], enums: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and rejected ones; rejected rows carry the reasons."""
    missing = sorted((set(required) | set(enums)) - set(df.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in required]
    checks += [
        F.when(F.col(c).isNotNull() & ~F.col(c).isin(values), F.lit(f"{c} not in list")) for c, values in enums.items()
    ]
    marked = df.withColumn("problems", F.array_compact(F.array(*checks)))
    good = marked.where(F.size("problems") == 0).drop("problems")
    return good, marked.where(F.size("problems") > 0)
