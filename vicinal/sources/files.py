"""Sources and sinks: declared schemas, strict JSON, captured places, day partitions, deliveries, counters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a provider's search returns, in its order.
PLACE = "search_id long, position int, place_id string, name string, address string, latitude double, longitude double, rating double, rating_count int, types array<string>, photo_name string, phone string"
#: An intent as another parser returns it.
INTENT = "struct<scope:string,query_language:string,normalized_query:string,store_name:string,location_text:string,categories:array<string>,product_terms:array<string>,style_terms:array<string>,price_intent:string,attributes:array<string>,sort_preference:string,semantic_terms:array<string>>"


def table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A Parquet table with a declared schema: nothing is inferred, and a scan reads only the columns that are used."""
    return spark.read.schema(schema).parquet(path)


def database_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 16, **options: str) -> DataFrame:
    """A database table, read in ranges of its key by that many tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.options(**options).load()


def captured_places(spark: SparkSession, path: str, most: int = 20) -> DataFrame:
    """Places that a provider has answered, as JSON lines; no more than it may return for a search."""
    return spark.read.schema(PLACE).option("mode", "FAILFAST").json(path).where(F.col("position") < most)


def strict_json(text: Column, schema: str) -> Column:
    """A document of exactly this form; anything else fails the job."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def read_intents(requests: DataFrame, parser: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(search_id, intent): what a parser outside makes of the queries, batch by batch, as JSON texts.

    The parser gets a list of queries and returns a JSON text or None for each; None and broken texts give no row.
    """

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"search_id": batch["search_id"], "answer": pd.Series(parser(batch["query"].tolist()), dtype=object)})

    answers = requests.select("search_id", "query").mapInPandas(run, "search_id long, answer string")
    return answers.select("search_id", F.from_json("answer", INTENT).alias("intent")).where("intent is not null and intent.scope is not null")


def write_days(rollup: DataFrame, path: str, first: str | None = None) -> None:
    """Writes a rollup by ``metric_date``; only days from ``first`` on are replaced, and no other day is touched."""
    rows = rollup if first is None else rollup.where(F.col("metric_date") >= F.lit(first).cast("date"))
    rows.repartition("metric_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric_date").parquet(path)


def deliver(path: str, send: Callable[[pd.DataFrame], list[str]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: sends due jobs in the tasks and writes each job's outcome under the batch's number.

    A batch that is run again replaces its own outcomes; what is sent twice then is told apart by the job's id.
    """

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "outcome": send(batch)})

    def write(batch: DataFrame, number: int) -> None:
        batch.mapInPandas(run, "id long, outcome string").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def as_json(df: DataFrame, into: str = "value") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(into))


def counted(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """``df`` with metrics that Spark reports to its listeners while the rows go by."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items()))
