"""Evaluation of answers, and generated traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prices of a million input and output tokens.
PRICE_IN, PRICE_OUT = 0.27, 1.10


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * PRICE_IN + tokens_out / 1e6 * PRICE_OUT


def composite(metrics: Column) -> Column:
    """Mean of a map's values that are not null."""
    values = F.filter(F.map_values(metrics), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def report(items: DataFrame, least_score: float = 0.75, least_citations: float = 2.5) -> DataFrame:
    """One row from items (score, answerable, citations): mean, unscored, citations of answerable ones, gate."""
    row = items.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.count_if(F.col("score").isNull()).alias("unscored"), F.avg(F.when(F.col("answerable"), F.col("citations"))).alias("citations"))
    enough = F.lit(True) if least_citations <= 0 else F.coalesce(F.col("citations") >= least_citations, F.lit(False))
    return row.withColumn("passed", F.coalesce(F.col("mean") >= least_score, F.lit(False)) & enough)


def sample(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows, the same for a seed: those whose id hashes lowest (a sampling operator, hence the limit)."""
    return rows.orderBy(F.md5(F.concat_ws("/", F.col(id_col).cast("string"), F.lit(str(seed)))), id_col).limit(n)


def markdown(spark: SparkSession, row: DataFrame) -> str:
    """A report row as a Markdown table."""
    got = row.first().asDict()
    return "\n".join(["| measure | value |", "|-|-|", *(f"| {k} | {'n/a' if v is None else v} |" for k, v in got.items())])


def in_fraction(rows: DataFrame, by: str, order: list[str], start: float, stop: float) -> DataFrame:
    """Rows of each group whose place in order lies in [start, stop) of the group's size."""
    i = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return rows.withColumn("i", i).withColumn("n_rows", n).where((F.col("i") >= F.floor(F.col("n_rows") * start)) & (F.col("i") < F.floor(F.col("n_rows") * stop)))


def traffic(questions: DataFrame, id_col: str, adversarial: list[str], percent: int) -> DataFrame:
    """Each question, or one of the adversarial ones for about `percent` of the ids, chosen by hash."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 6), 16, 10).cast("bigint")
    swap = h % 100 < percent
    odd = F.get(F.array(*map(F.lit, adversarial)), (F.floor(h / 100) % len(adversarial)).cast("int"))
    return questions.select(id_col, F.when(swap, odd).otherwise(F.col("text")).alias("query"), swap.alias("adversarial"))
