"""What failed on larger tables: plans that fill the driver, pairs that meet in a few tasks, texts that end in line breaks."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from vicinal import oracle, queries
from vicinal.operators import nearest, staging
from vicinal.operators import tables as ops
from vicinal.plans import search
from vicinal.sources.canonical import RAW, Tables

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, folder):
    db = duckdb.connect()
    for table in RAW:
        db.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    assert Counter(map(tuple, queries.QUERIES[name](spark, folder).collect())) == Counter(db.execute(oracle.ORACLE_SQL[name]).fetchall())


def nodes(df):
    return df._jdf.queryExecution().analyzed().toString().count("\n")


@pytest.mark.parametrize("which", [0, 1])
def test_no_step_of_a_search_is_a_large_plan(spark, monkeypatch, which):
    """The driver holds a step's plan, its copies and all its exchanges at once, whatever the tables' size."""
    sizes, staged = [], search.staged
    for module in (search, nearest):
        monkeypatch.setattr(module, "staged", lambda df: sizes.append(nodes(df)) or staged(df), raising=False)
    t = Tables(spark, SF)
    requests = queries._requests(t)
    sizes.append(nodes(search.search_batch(t, requests, queries._places_for(t, requests))[which]))
    assert max(sizes) <= 250, sizes


def test_pairs_of_frequent_keys_are_dealt_over_tasks(spark):
    left = spark.createDataFrame([(i, 1 if i < 2000 else i % 7) for i in range(2100)] + [(9000, None)], "a int, k int")
    right = spark.createDataFrame([(i, 1 if i < 1000 else i % 5) for i in range(1050)] + [(9000, None)], "b int, k int")
    got = ops.paired(left, right, ["k"], 50_000)
    assert Counter(map(tuple, got.select("a", "b").collect())) == Counter(map(tuple, left.join(right, "k").select("a", "b").collect()))
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) > 2_000_000 and max(parts) < 200_000
    assert ops.paired(left.limit(0), right, ["k"]).count() == 0


def test_near_stores_equal_their_sql(spark):
    same_as_sql(spark, "x_radius_join", SF)
    plan = queries.near_stores(Tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "ATAN2" not in plan  # distances are those of places, told before requests meet them


def test_comments_that_are_cut_at_white_space_equal_their_sql(spark, tmp_path):
    for table in RAW:
        os.symlink(f"{SF}/{table}.parquet", tmp_path / f"{table}.parquet")
    os.unlink(tmp_path / "conversations.parquet")
    ends = ["\n", "\t", " ", " ", "　", " ", "\r\n", "x"]
    rows = [(i, k, "user", "y" * (100 - len(e)) + e + "more" if i % 2 else e + "short" + e if i % 3 else e) for i in range(10) for k, e in enumerate(ends)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    assert queries.Tables(spark, str(tmp_path)).comment_requests.count() >= 40
    same_as_sql(spark, "f8_comments", str(tmp_path))


def test_a_replayed_table_is_computed_once_and_comes_by_spans(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(staging, "ROWS_A_BATCH", 1000, raising=False)
    monkeypatch.setattr(staging, "ROWS_A_FILE", 300, raising=False)
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    for k, rows in enumerate(([(i, i // 2) for i in range(6000)], [(i, 0 if i else 10**6) for i in range(6000)], [])):
        calls.value = 0
        df = spark.createDataFrame(rows, "id long, at long").mapInPandas(counted, "id long, at long")
        seen = []
        write = lambda batch, number, seen=seen: seen.append([r.at for r in batch.select("at").collect()])
        staging.replayed(df, "at").writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / str(k))).trigger(availableNow=True).start().awaitTermination()
        assert calls.value == len(rows) and sorted(a for b in seen for a in b) == sorted(r[1] for r in rows)
        full = [b for b in seen if b]
        assert all(max(a) < min(b) for a, b in zip(full, full[1:], strict=False))
        assert k or len(full) == 6
