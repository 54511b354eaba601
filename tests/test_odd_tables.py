"""Queries against their SQL on small tables with values that the given ones lack."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalogue


def compared(spark, folder, name):
    """Rows of a query and of its SQL over the tables of a folder."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    reply = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in reply.description]
    found = catalogue.QUERIES[name](spark, str(folder)).select(*names)
    return sorted(map(repr, map(tuple, found.collect()))), sorted(map(repr, reply.fetchall()))


@pytest.mark.parametrize("name", ["ingest_run", "ingest_resume"])
def test_events_without_a_value_above_zero_are_quoted(spark, tmp_path, name):
    begin, kinds = datetime.datetime(2024, 1, 2), ["click", "purchase", "view"]
    rows = [(begin + datetime.timedelta(hours=h, minutes=5), kinds[h % 3], {10: 0.0, 11: 0.0, 12: 0.0, 40: -3.0, 200: 0.0}.get(h, 5.0 + h % 7)) for h in range(400)]
    at, kind, value = zip(*rows, strict=True)
    n = len(rows)
    pq.write_table(pa.table({"event_id": pa.array(range(n), pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array([1] * n, pa.int64()), "event_type": kind, "value": value}), tmp_path / "events.parquet")
    found, wanted = compared(spark, tmp_path, name)
    assert found == wanted


def test_first_touch_keeps_no_rows_sorted(spark):
    """Bars that are met fold into one long a decision, in a hash map."""
    from tidemark.operators import outcomes

    bars = spark.createDataFrame([("S", datetime.datetime(2024, 1, 1, h), 10.0 + h, 5.0 - h, 8.0) for h in range(6)], "symbol string, event_time timestamp, high double, low double, close double")
    kinds = "symbol string, event_time timestamp, side int, entry double, stop double, target double"
    at = datetime.datetime(2024, 1, 1)
    decisions = spark.createDataFrame([("S", at, 1, 8.0, 3.0, 99.0), ("S", at, 1, 8.0, -99.0, 12.0), ("S", at, -1, 8.0, 12.0, 3.0), ("S", at, 1, 8.0, -99.0, 99.0), ("S", at, 1, 8.0, None, 99.0), ("S", at, 1, 8.0, None, 12.0)], kinds)
    touched = outcomes.first_touch(bars, decisions, 4)
    found = {(r["side"], r["stop"], r["target"]): (r["r"], r["ambiguous"], r["bars_to_touch"]) for r in touched.collect()}
    assert found == {(1, 3.0, 99.0): (-1.0, False, 2), (1, -99.0, 12.0): (4.0 / 107.0, False, 2), (-1, 12.0, 3.0): (None, True, 2), (1, -99.0, 99.0): (None, None, None), (1, None, 99.0): (None, None, None), (1, None, 12.0): (None, None, 2)}
    assert "SortAggregate" not in touched._jdf.queryExecution().executedPlan().toString()


def test_replayed_pieces_are_batches_of_several_files(spark):
    from tidemark.plans.streams import replayed
    from tidemark.sources.shared import fresh_folder
    from tidemark.streaming import record

    begin = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k, begin + datetime.timedelta(minutes=m)) for k, m in enumerate([*range(40), 100, *range(200, 240)])], "k long, event_time timestamp")
    batches = {}
    record.run(replayed(spark, rows, "few-rows", 3, file_rows=9), lambda batch, n: batches.update({n: (sorted(r["k"] for r in batch.collect()), batch.select(F.input_file_name()).distinct().collect())}), fresh_folder(spark, "few-rows-state"))
    assert {n: ks for n, (ks, _) in batches.items()} == {0: list(range(40)), 1: [40], 2: list(range(41, 81))}
    assert all(len(files) > 1 for n, (_, files) in batches.items() if n != 1)
