"""Table catalogs as DataFrames: columns, unique keys, fingerprints, and which key addresses a table's rows.

columns: table (schema and name), ordinal, name, native, nullable, generated. keys: table, key, is_primary, columns (array).
tables: table, engine, charset, collation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..model import TABLE_REF

COLUMNS = f"table {TABLE_REF}, ordinal int, name string, native string, nullable boolean, generated boolean"
KEYS = f"table {TABLE_REF}, key string, is_primary boolean, columns array<string>"
TABLES = f"table {TABLE_REF}, engine string, charset string, collation string"
ENGINE = "InnoDB"


@dataclass(frozen=True)
class Catalog:
    tables: DataFrame
    columns: DataFrame
    keys: DataFrame

    def fingerprints(self) -> DataFrame:
        return fingerprints(self.tables, self.columns, self.keys)


def of_information_schema(tables: DataFrame, columns: DataFrame, statistics: DataFrame) -> Catalog:
    """The catalog from the three views of an information schema, read over JDBC or from an export. Only unique indexes are
    keys; computed columns are marked as such."""
    ref = F.struct(F.col("TABLE_SCHEMA").alias("schema"), F.col("TABLE_NAME").alias("name")).cast(TABLE_REF).alias("table")
    collation = F.coalesce("TABLE_COLLATION", F.lit(""))
    listed = tables.select(ref, F.col("ENGINE").alias("engine"), F.substring_index(collation, "_", 1).alias("charset"), collation.alias("collation"))
    computed = F.upper(F.coalesce("EXTRA", F.lit(""))).rlike("VIRTUAL GENERATED|STORED GENERATED")
    cols = columns.select(ref, F.col("ORDINAL_POSITION").cast("int").alias("ordinal"), F.col("COLUMN_NAME").alias("name"), F.col("COLUMN_TYPE").alias("native"), (F.upper("IS_NULLABLE") == "YES").alias("nullable"), computed.alias("generated"))
    parts = statistics.where(F.col("NON_UNIQUE").cast("int") == 0).groupBy(ref, F.col("INDEX_NAME").alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col("SEQ_IN_INDEX").cast("int").alias("n"), F.col("COLUMN_NAME").alias("c")))).alias("_c"))
    keys = parts.select("table", "key", (F.col("key") == "PRIMARY").alias("is_primary"), F.transform("_c", lambda x: x["c"]).alias("columns"))
    return Catalog(listed, cols, keys)


def read(spark: SparkSession, path: str) -> Catalog:
    """A catalog from a folder: tables, columns and keys, or tables, columns and statistics of an information schema; each
    is Parquet, or JSON lines with the suffix .json."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = {s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)}

    def table(name: str, schema: str | None) -> DataFrame:
        if f"{name}.json" in names:
            return (spark.read.schema(schema) if schema else spark.read).option("mode", "FAILFAST").json(f"{path}/{name}.json")
        return spark.read.parquet(f"{path}/{name}")

    if {"statistics", "statistics.json"} & names:
        return of_information_schema(*(table(n, None) for n in ("tables", "columns", "statistics")))
    return Catalog(table("tables", TABLES), table("columns", COLUMNS), table("keys", KEYS))


def fingerprints(tables: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """table and fingerprint: a digest of a fixed listing of engine, character set, columns by position and keys (primary
    first, then by name)."""
    text = F.concat(F.col("name"), F.lit("|"), F.col("native"), F.lit("|"), F.when(F.col("nullable"), "null").otherwise("not null"), F.lit("|"), F.when(F.col("generated"), "generated").otherwise("stored"))
    listed = columns.groupBy("table").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", text.alias("text")))), lambda c: F.concat(F.lit("col["), c["ordinal"].cast("string"), F.lit("]="), c["text"])), "\n").alias("_columns"))
    unique = keys.groupBy("table").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((~F.col("is_primary")).alias("rest"), "key", F.array_join("columns", ",").alias("text")))), lambda k: F.concat(F.lit("key="), k["key"], F.lit("("), k["text"], F.lit(")"))), "\n").alias("_keys"))
    whole = F.concat_ws("\n", F.concat(F.lit("table="), F.col("table.schema"), F.lit("."), F.col("table.name")), F.concat(F.lit("engine="), "engine"), F.concat(F.lit("charset="), "charset"), F.concat(F.lit("collation="), "collation"), "_columns", "_keys")
    return tables.join(listed, "table", "left").join(unique, "table", "left").select("table", F.concat(F.lit("sha256:"), F.sha2(whole, 256)).alias("fingerprint"))


def refused_engines(tables: DataFrame) -> DataFrame:
    """Tables whose rows take no part in transactions."""
    return tables.where(~F.col("engine").eqNullSafe(ENGINE)).select("table", "engine")


def chosen_keys(keys: DataFrame, present: DataFrame) -> DataFrame:
    """table, key, columns: of the unique keys whose columns all are present and not null the primary one, else the first
    by name. present: table and not_null (names of columns that hold values in the row at hand)."""
    fit = keys.join(present, "table").where(F.size(F.array_except("columns", "not_null")) == 0)
    best = Window.partitionBy("table").orderBy(F.col("is_primary").desc(), "key")
    return fit.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("table", "key", "columns")


def always_usable_keys(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """chosen_keys() for any row: only columns that cannot be null count."""
    return chosen_keys(keys, columns.where(~F.col("nullable")).groupBy("table").agg(F.collect_set("name").alias("not_null")))


def generated(columns: DataFrame) -> DataFrame:
    """table and generated: the names of its computed columns."""
    return columns.groupBy("table").agg(F.collect_set(F.when(F.col("generated"), F.col("name"))).alias("generated"))
