"""Delimited files, baskets, rule lists and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, header: bool = True, has_index: bool = False, na: str = "?", schema=None) -> DataFrame:
    """A delimited table: ``na`` is null, leading blanks go, a leading index column is dropped."""
    reader = spark.read.option("header", header).option("nullValue", na).option("ignoreLeadingWhiteSpace", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.drop(df.columns[0]) if has_index else df


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """(items, class) of lines of blank-separated whole numbers, the last of which is the class."""
    parts = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("int"))
    lines = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    return lines.select(F.slice("p", F.lit(1), F.size("p") - 1).alias("items"), F.element_at("p", -1).alias("class"))


def expanded(transactions: DataFrame, n_items: int) -> DataFrame:
    """With one 0/1 column for each item."""
    return transactions.select("*", *[F.array_contains("items", i).cast("int").alias(f"i{i}") for i in range(1, n_items + 1)])


def rule_lines(rules: DataFrame) -> DataFrame:
    """``i j ... class;support,confidence,ln p`` with 4, 3 and 3 decimals."""
    items = F.array_join(F.transform("items", lambda x: x.cast("string")), " ")
    return rules.select(F.concat(items, F.lit(" "), F.col("class").cast("string"), F.lit(";"), F.format_string("%.4f,%.3f,%.3f", "support", "confidence", "log_p")).alias("value"))


def write_rules(rules: DataFrame, path: str) -> None:
    rule_lines(rules).write.text(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(items, class, support, confidence, log_p) of rule lines."""
    halves = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", ";").alias("h"))
    ids = F.transform(F.split(F.trim(F.col("h")[0]), r"\s+"), lambda x: x.cast("int"))
    numbers = F.transform(F.split(F.col("h")[1], ","), lambda x: x.cast("double"))
    named = halves.select(ids.alias("i"), numbers.alias("n"))
    return named.select(F.slice("i", F.lit(1), F.size("i") - 1).alias("items"), F.element_at("i", -1).alias("class"), *[F.col("n")[k].alias(c) for k, c in enumerate(("support", "confidence", "log_p"))])


def write_results(results: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "method"), form: str = "parquet", **settings) -> None:
    """Results with their settings as columns, one folder for each value of ``by``."""
    results.withColumns({k: F.lit(v) for k, v in settings.items()}).write.partitionBy(*by).format(form).save(path)
