"""Tables to be profiled, and where results go: discovery, filters, full-replace and append writes, evolution, resumption."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REF = ["database", "schema", "table_name"]

#: Type labels by Spark's type name: fixed values.
LABELS = {"boolean": "boolean", "byte": "integer", "short": "integer", "integer": "integer", "long": "bigint", "double": "double", "float": "real", "decimal": "decimal", "string": "varchar", "char": "varchar", "varchar": "varchar", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}


def type_label(kind: T.DataType) -> str:
    return LABELS.get(kind.typeName().split("(")[0], kind.typeName())


def read_tables(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}.parquet") for n in names}


def unprefixed(df: DataFrame) -> DataFrame:
    """Columns without their table's prefix, so that names of the same thing agree across tables: o_custkey -> custkey."""
    return df.toDF(*(c.split("_", 1)[-1] for c in df.columns))


def discover_columns(spark: SparkSession, tables: dict[str, DataFrame], database: str = "lake", schema: str = "star") -> DataFrame:
    """One row a column, from the tables' schemas alone: no data is read."""
    rows = [(database, schema, t, f.name, i, type_label(f.dataType), isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "database string, schema string, table_name string, column_name string, ordinal_position int, column_type string, is_nested boolean")


def select_tables(columns: DataFrame, only: DataFrame | None = None, skip: DataFrame | None = None) -> DataFrame:
    """Rows of the tables in `only`, or, where that is not given, of those not in `skip`."""
    if only is not None:
        return columns.join(only.select(REF).distinct(), REF, "left_semi")
    return columns.join(skip.select(REF).distinct(), REF, "left_anti") if skip is not None else columns


def read_labelled_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A labelled profile set with a header row; a row that doesn't fit the schema is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_staging(df: DataFrame, path: str) -> None:
    """Replace everything at path."""
    df.write.mode("overwrite").parquet(path)


def append_results(df: DataFrame, path: str, run_date: str = "run_date") -> None:
    """Keep history: add to what is there, a folder for each run date."""
    df.write.mode("append").partitionBy(run_date).parquet(path)


def materialise(df: DataFrame, path: str, declared: Iterable[str]) -> DataFrame:
    """Write df as a new table, replacing any, and read it back; its columns must be the declared ones."""
    verify_columns(df, declared)
    write_staging(df, path)
    return df.sparkSession.read.parquet(path)


def verify_columns(df: DataFrame, declared: Iterable[str]) -> None:
    have, want = set(df.columns), set(declared)
    if have != want:
        raise ValueError(f"columns differ: missing {sorted(want - have)}, unexpected {sorted(have - want)}")


def evolve_schema(old: DataFrame, schema: T.StructType, sentinel: str | None = None) -> DataFrame:
    """The old rows under a schema with more columns (null there); no rows where the old table lacks the sentinel column, which
    means that it is of another kind and has to be made anew."""
    empty = old.sparkSession.createDataFrame([], schema)
    if sentinel and sentinel not in old.columns:
        return empty
    return empty.unionByName(old, allowMissingColumns=True).select(schema.fieldNames())


def resumable_build(spark: SparkSession, units: dict[str, Callable[[], DataFrame]], path: str) -> DataFrame:
    """Build one part for each unit, skipping those that an earlier, interrupted run has finished. A part is finished once its
    write is committed."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = lambda u: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/unit={u}/_SUCCESS"))
    for unit, make in units.items():
        if not done(unit):
            make().write.mode("overwrite").parquet(f"{path}/unit={unit}")
    return spark.read.option("basePath", path).parquet(*(f"{path}/unit={u}" for u in units))


class VersionedTable:
    """A table that is rewritten by whole versions: readers see the newest version that is complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self.root = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        if not self.fs.exists(self.root):
            return []
        found = [s.getPath() for s in self.fs.listStatus(self.root)]
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p.toString() for p in found if self.fs.exists(mark(p, "_SUCCESS")))

    def read(self) -> DataFrame | None:
        got = self.versions()
        return self.spark.read.parquet(got[-1]) if got else None

    def replace(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/v{len(self.versions()):08d}-{uuid.uuid4().hex[:8]}")
        return self.read()


def manifest_insert(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest with rows added; a table that is there already is replaced."""
    return manifest_delete(manifest, rows).unionByName(rows)


def manifest_delete(manifest: DataFrame, names: DataFrame) -> DataFrame:
    return manifest.join(names.select("table_name").distinct(), "table_name", "left_anti")


def manifest_read(manifest: DataFrame, only_review: bool = False) -> DataFrame:
    return manifest.where(F.col("needs_review")) if only_review else manifest
