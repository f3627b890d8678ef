"""Reading and writing tables: CSV dialects, many files with lineage, per-run outputs, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".csv"):
        return read_csv(spark, path)
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path, sep: str = ",", schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give a schema where it is known: inference costs a further scan."""
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_csv_floats(spark: SparkSession, path, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """CSV whose columns are all doubles; names come from the header line unless given."""
    if columns is None:
        columns = spark.read.option("header", True).option("sep", sep).csv(path).columns
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    return spark.read.option("header", True).option("sep", sep).option("enforceSchema", False).schema(schema).csv(path)


def read_many_csv(spark: SparkSession, pattern, sep: str = ";", schema=None, file_col: str = "file") -> DataFrame:
    """All files of a pattern as one scan, each row with the name of the file it came from."""
    df = read_csv(spark, pattern, sep, schema)
    return df.select("*", F.col("_metadata.file_name").alias(file_col))


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_runs(df: DataFrame, path: str, run_col: str = "run", sep: str = ";", mode: str = "errorifexists") -> None:
    """One folder of files per run, so a later read can prune to the runs it wants."""
    df.write.mode(mode).option("header", True).option("sep", sep).partitionBy(run_col).csv(path)


def save_model(model: MLWritable, path: str) -> None:
    PipelineModel([model]).write().overwrite().save(path)


def load_model(path: str):
    return PipelineModel.load(path).stages[0]
