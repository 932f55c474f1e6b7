"""What the physical plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from logweave import plans
from logweave.operators import fleet, logs
from logweave.operators.ordered import with_previous

SF = "/root/testdata/sf0.01"
JOBS, _ = plans.load()


def physical(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in JOBS if not n.startswith("live_") and n not in ("file_lines", "message_log")))
def test_no_python_and_no_cross_join(spark, name):
    text = physical(JOBS[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text and "ArrowEval" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name,columns", [
    ("nginx_status", {"event_id", "user_id", "event_type", "value"}),
    ("restarts", {"event_id", "user_id", "event_type", "ts"}),
    ("text_search", {"doc_id", "text", "source", "lang"}),
    ("delivery_counters", {"o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"}),
])
def test_scans_read_only_needed_columns(spark, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", physical(JOBS[name](spark, SF)))
    read = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert schemas and read - {"conv_id", "turn", "role"} <= columns


def test_each_line_is_parsed_once(spark):
    text = physical(JOBS["nginx_fields"](spark, SF).filter("failed = 0 and status = '200'"))
    assert sum("regexp_replace" in line for line in text.splitlines()) == 1


def test_previous_row_reuses_its_shuffle(spark):
    text = physical(JOBS["counter_deltas"](spark, SF), run=True)
    assert "ReusedExchange" in text


def test_history_is_cut_before_the_shuffle(spark):
    text = physical(JOBS["restart_history"](spark, SF))
    assert re.search(r"WindowGroupLimit .*10, Partial", text)


def test_recent_bound_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").withColumnRenamed("event_id", "seq")
    scans = [line for line in physical(logs.newest(df, 500)).splitlines() if "FileScan" in line]
    assert any("ubquery" in line.split("DataFilters")[1] for line in scans)


def test_latest_state_needs_one_scan_and_one_shuffle(spark):
    text = physical(JOBS["inventory"](spark, SF))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_only_measured_sides_are_broadcast_by_hint(spark):
    import inspect

    import logweave.operators as package
    from importlib import import_module
    from pkgutil import iter_modules
    hits = []
    for m in iter_modules(package.__path__):
        source = inspect.getsource(import_module(f"logweave.operators.{m.name}"))
        hits += [(m.name, line.strip()) for line in source.splitlines() if "F.broadcast(" in line]
    # The index of a table has a name per file, as the listing of the table itself.
    assert [m for m, _ in hits] == ["joins", "log_index"], hits


@pytest.mark.parametrize("name", ["orphans", "dangling", "config_audit"])
def test_ids_out_of_documents_are_not_broadcast(spark, name):
    """By statistics they are as small as the packed files they come from."""
    assert "Broadcast" not in physical(JOBS[name](spark, SF))
