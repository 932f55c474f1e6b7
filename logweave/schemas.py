"""Declared shapes of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

LOG_RECORD = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("severity_text", T.StringType()),
    T.StructField("severity_number", T.IntegerType()),
    T.StructField("body", T.StringType()),
    T.StructField("attributes", STRING_MAP),
    T.StructField("resource", STRING_MAP),
    T.StructField("receiver", T.StringType()),
])

SAMPLE = T.StructType([
    T.StructField("scrape_id", T.StringType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("family", T.StringType()),
    T.StructField("labels", STRING_MAP),
    T.StructField("value", T.DoubleType()),
])

ROUTE = T.StructType([
    T.StructField("agent_id", T.StringType()),
    T.StructField("pipeline", T.StringType()),
    T.StructField("receivers", T.ArrayType(T.StringType())),
    T.StructField("exporters", T.ArrayType(T.StringType())),
])

COUNTER = T.StructType([
    T.StructField("agent_id", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("value", T.LongType()),
])

_STATUS = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])

AGENT_MESSAGE = T.StructType([
    T.StructField("agent_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("description", T.StructType([
        T.StructField("hostname", T.StringType()),
        T.StructField("service_version", T.StringType()),
        T.StructField("local_ui_addr", T.StringType()),
    ])),
    T.StructField("health", T.StructType([
        T.StructField("healthy", T.BooleanType()),
        T.StructField("last_error", T.StringType()),
    ])),
    T.StructField("snapshot_json", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("effective_config", T.StringType()),
    T.StructField("config_status", _STATUS),
    T.StructField("package_status", _STATUS),
])

SNAPSHOT = T.StructType([
    T.StructField("started_at", T.StringType()),
    T.StructField("uptime_seconds", T.LongType()),
    T.StructField("process", T.StructType([
        T.StructField("cpu_seconds", T.DoubleType()),
        T.StructField("memory_rss_bytes", T.LongType()),
        T.StructField("heap_alloc_bytes", T.LongType()),
    ])),
    T.StructField("receivers", T.MapType(T.StringType(), T.StructType([
        T.StructField("events_in", T.LongType()),
    ]))),
    T.StructField("pipelines", T.MapType(T.StringType(), T.StructType([
        T.StructField("events_in", T.LongType()),
        T.StructField("events_out", T.LongType()),
        T.StructField("events_dropped", T.LongType()),
        T.StructField("events_dead_lettered", T.LongType()),
        T.StructField("parse_errors", T.LongType()),
    ]))),
    T.StructField("exporters", T.MapType(T.StringType(), T.StructType([
        T.StructField("events_in", T.LongType()),
        T.StructField("batches_sent", T.LongType()),
        T.StructField("batches_failed", T.LongType()),
        T.StructField("retries", T.LongType()),
        T.StructField("last_error", T.StructType([
            T.StructField("message", T.StringType()),
            T.StructField("at", T.StringType()),
        ])),
    ]))),
    T.StructField("topology", T.StructType([
        T.StructField("nodes", T.ArrayType(T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("type", T.StringType()),
        ]))),
        T.StructField("edges", T.ArrayType(T.StructType([
            T.StructField("from", T.StringType()),
            T.StructField("to", T.StringType()),
        ]))),
    ])),
])


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: The state of an agent as it was after batch ``batch`` of a stream; one that is gone was deleted.
AGENT_STATE = T.StructType([
    T.StructField("agent_id", T.StringType()),
    *[f for f in AGENT_MESSAGE.fields if f.name in ("description", "health")],
    T.StructField("snapshot_json", T.StringType()),
    T.StructField("effective_config_hash", T.StringType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("last_started_at", T.StringType()),
    T.StructField("restart_history", T.ArrayType(T.StringType())),
    T.StructField("config_pending", _texts("content", "hash")),
    T.StructField("config_good", _texts("content", "hash")),
    T.StructField("config_error", T.StringType()),
    T.StructField("package_pending", _texts("name", "version", "hash")),
    T.StructField("package_good", _texts("name", "version", "hash")),
    T.StructField("package_error", T.StringType()),
    T.StructField("gone", T.BooleanType()),
    T.StructField("batch", T.LongType()),
])
