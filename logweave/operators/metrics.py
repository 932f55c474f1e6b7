"""Volume accounting: samples -> per-component counters -> attribution.

Counter tables are in long form ``(agent keys…, section, component, field,
value)``. ``by`` names the columns that identify one agent or scrape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import look_up
from .ordered import with_previous
from .topology import topology_documents

# Metric families of the collectors' own telemetry.
ACCEPTED = "otelcol_receiver_accepted_log_records"
SENT = "otelcol_exporter_sent_log_records"
FAILED = "otelcol_exporter_send_failed_log_records"
CPU_SECONDS = "otelcol_process_cpu_seconds"
RSS_BYTES = "otelcol_process_memory_rss"
HEAP_BYTES = "otelcol_process_runtime_heap_alloc_bytes"

RECEIVER_FIELDS = ("events_in",)
PIPELINE_FIELDS = ("events_in", "events_out", "events_dropped", "events_dead_lettered", "parse_errors")
EXPORTER_FIELDS = ("events_in", "batches_sent", "batches_failed", "retries")


def _whole(value: Column) -> Column:
    """Truncate a sample to an integer, as counters are kept."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def sum_by_label(samples: DataFrame, family: str, label: str, by: Sequence[str] = ("scrape_id",)) -> DataFrame:
    """``(by…, id, n)``: each value truncated, then summed per label value."""
    key = F.col("labels")[label]
    return (samples.filter((F.col("family") == family) & (F.coalesce(key, F.lit("")) != ""))
            .groupBy(*by, key.alias("id")).agg(F.sum(_whole(F.col("value"))).alias("n")))


def left_counters(ids: DataFrame, sums: DataFrame, by: Sequence[str] = ("scrape_id",)) -> DataFrame:
    """Every configured id with its counter, 0 if missing; other ids go."""
    return ids.join(sums, [*by, "id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def receiver_counters(samples: DataFrame, ids: DataFrame, by: Sequence[str] = ("scrape_id",)) -> DataFrame:
    return left_counters(ids, sum_by_label(samples, ACCEPTED, "receiver", by), by).withColumnRenamed("n", "events_in")


def exporter_counters(samples: DataFrame, ids: DataFrame, by: Sequence[str] = ("scrape_id",)) -> DataFrame:
    """Sent and failed per configured exporter in one pass over the samples."""
    key = F.col("labels")["exporter"]
    n = _whole(F.col("value"))
    sums = (samples.filter(F.col("family").isin(SENT, FAILED) & (F.coalesce(key, F.lit("")) != ""))
            .groupBy(*by, key.alias("id")).agg(
                F.sum(F.when(F.col("family") == SENT, n)).alias("batches_sent"),
                F.sum(F.when(F.col("family") == FAILED, n)).alias("batches_failed")))
    zero = F.lit(0).cast("bigint")
    out = ids.join(sums, [*by, "id"], "left").withColumns({
        c: F.coalesce(c, zero) for c in ("batches_sent", "batches_failed")})
    return out.withColumn("events_in", F.col("batches_sent") + F.col("batches_failed"))


def first_value_of(samples: DataFrame, family: str, by: Sequence[str] = ("scrape_id",)) -> DataFrame:
    """First value of a family per scrape in line order, 0 if it is absent."""
    here = F.when(F.col("family") == family, F.col("line_no"))
    return samples.groupBy(*by).agg(F.coalesce(F.min_by("value", here), F.lit(0.0)).alias("value"))


def process_usage(samples: DataFrame, by: Sequence[str] = ("scrape_id",)) -> DataFrame:
    def first(family: str) -> Column:
        here = F.when(F.col("family") == family, F.col("line_no"))
        return F.coalesce(F.min_by("value", here), F.lit(0.0))

    return samples.groupBy(*by).agg(
        first(CPU_SECONDS).alias("cpu_seconds"),
        _whole(first(RSS_BYTES)).alias("memory_rss_bytes"),
        _whole(first(HEAP_BYTES)).alias("heap_alloc_bytes"))


def attribute_pipelines(routes: DataFrame, accepted: DataFrame, sent: DataFrame, failed: DataFrame,
                        by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Split each exporter's totals over the pipelines that use it.

    ``routes`` is ``(by…, pipeline, receivers, exporters)``; see ``attribute_members``.
    """
    member = lambda column: routes.select(*by, "pipeline", F.explode_outer(column).alias("id"))
    return attribute_members(member("receivers"), member("exporters"), accepted, sent, failed, by)


def attribute_members(receivers: DataFrame, exporters: DataFrame, accepted: DataFrame, sent: DataFrame, failed: DataFrame,
                      by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Split each exporter's totals over the pipelines that use it.

    ``receivers`` and ``exporters`` are the members of pipelines, ``(by…, pipeline, id)``,
    the others are ``(by…, id, n)``. A pipeline's share of an exporter is its part of the
    events that all pipelines of that exporter took in, or an even part if they
    took in none. Shares are summed and rounded once. A receiver or exporter
    listed twice counts twice; a pipeline without any has one row with a NULL id.
    """
    by = list(by)
    zero = F.lit(0).cast("bigint")
    # A receiver or exporter that all pipelines share is one key: it is looked up per salt.
    volume = look_up(receivers.select(*by, "pipeline", "id"), accepted.select(*by, "id", "n"), [*by, "id"])
    volume = volume.groupBy(*by, "pipeline").agg(F.coalesce(F.sum("n"), zero).alias("events_in"))
    # A pipeline has as many rows here as it lists exporters.
    uses = exporters.select(*by, "pipeline", "id").join(volume, [*by, "pipeline"], "left").withColumn("events_in", F.coalesce("events_in", zero))
    totals = uses.groupBy(*by, "id").agg(F.sum("events_in").alias("total_in"), F.count("*").alias("users"))
    totals = (totals.join(sent.withColumnRenamed("n", "sent"), [*by, "id"], "left")
              .join(failed.withColumnRenamed("n", "failed"), [*by, "id"], "left"))
    share = F.when(F.col("total_in") > 0, F.col("events_in") / F.col("total_in")).otherwise(F.lit(1.0) / F.col("users"))
    part = lambda c: F.round(F.sum(share * F.coalesce(c, zero))).cast("bigint")
    return look_up(uses, totals, [*by, "id"]).groupBy(*by, "pipeline").agg(
        F.any_value("events_in").alias("events_in"),
        F.coalesce(part("sent"), zero).alias("events_out"),
        F.coalesce(part("failed"), zero).alias("events_dropped"))


def long_counters(section: str, wide: DataFrame, component: str, fields: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Wide counters of one section in the long form."""
    return wide.select(*by, F.lit(section).alias("section"), F.col(component).alias("component"),
                       F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("bigint"))])).alias("field", "value"))


def snapshot(samples: DataFrame, routes: DataFrame, receivers: DataFrame, exporters: DataFrame,
             by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """All counters of each agent's scrape in the long form.

    ``receivers`` and ``exporters`` are the configured ids ``(by…, id)``.
    """
    accepted = sum_by_label(samples, ACCEPTED, "receiver", by)
    sent = sum_by_label(samples, SENT, "exporter", by)
    failed = sum_by_label(samples, FAILED, "exporter", by)
    flows = attribute_pipelines(routes, accepted, sent, failed, by)
    return (long_counters("receivers", receiver_counters(samples, receivers, by), "id", ("events_in",), by)
            .unionByName(long_counters("pipelines", flows, "pipeline", ("events_in", "events_out", "events_dropped"), by))
            .unionByName(long_counters("exporters", exporter_counters(samples, exporters, by), "id",
                                       ("events_in", "batches_sent", "batches_failed"), by)))


def status_documents(agents: DataFrame, samples: DataFrame, routes: DataFrame, receivers: DataFrame, exporters: DataFrame,
                     by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """What each agent reports, as ``(by…, snapshot_json)`` in the shape of
    ``schemas.SNAPSHOT``: counters, process and the graph of its components.
    What a scrape cannot tell is 0.

    ``agents`` is ``(by…, started_at, scraped_at)``, one row per document.
    """
    by = list(by)
    parts = {
        "receivers": (receiver_counters(samples, receivers, by), "id", RECEIVER_FIELDS),
        "pipelines": (attribute_pipelines(routes, sum_by_label(samples, ACCEPTED, "receiver", by), sum_by_label(samples, SENT, "exporter", by),
                                          sum_by_label(samples, FAILED, "exporter", by), by), "pipeline", PIPELINE_FIELDS),
        "exporters": (exporter_counters(samples, exporters, by), "id", EXPORTER_FIELDS),
    }
    zero = F.lit(0).cast("bigint")
    out = agents.join(process_usage(samples, by), by, "left")
    for name, (wide, component, fields) in parts.items():
        value = F.struct(*[(F.col(x).cast("bigint") if x in wide.columns else zero).alias(x) for x in fields])
        entries = wide.select(*by, F.struct(F.col(component).alias("key"), value.alias("value")).alias("_e"))
        out = out.join(entries.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_set("_e"))).alias(name)), by, "left")
    out = out.join(topology_documents(routes, receivers, exporters, by), by, "left")
    graph = F.struct(*[F.coalesce(F.col(f"topology.{n}"), F.array().cast(out.schema["topology"].dataType[n].dataType)).alias(n) for n in ("nodes", "edges")])
    started = F.to_timestamp("started_at")
    process = F.struct(F.coalesce("cpu_seconds", F.lit(0.0)).alias("cpu_seconds"), *[F.coalesce(c, zero).alias(c) for c in ("memory_rss_bytes", "heap_alloc_bytes")])
    document = F.struct("started_at", uptime_seconds(started, F.col("scraped_at")).alias("uptime_seconds"), process.alias("process"),
                        *[F.coalesce(F.col(n), F.create_map().cast(out.schema[n].dataType)).alias(n) for n in parts], graph.alias("topology"))
    return out.select(*by, F.to_json(document).alias("snapshot_json"))


def uptime_seconds(started_at: Column, now: Column) -> Column:
    return F.unix_seconds(now) - F.unix_seconds(started_at)


def delivery_counters(deliveries: DataFrame, by: Sequence[str] = ("exporter",)) -> DataFrame:
    """From ``(exporter, seq, kind, batch_len, message, at)``; kind is success,
    failure or retry. Retries carry no events."""
    done = F.col("kind").isin("success", "failure")
    failure = F.col("kind") == "failure"
    seq = F.when(failure, F.col("seq"))
    return deliveries.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(done, F.col("batch_len"))), F.lit(0).cast("bigint")).alias("events_in"),
        F.count_if(F.col("kind") == "success").alias("batches_sent"),
        F.count_if(failure).alias("batches_failed"),
        F.count_if(F.col("kind") == "retry").alias("retries"),
        F.max_by("message", seq).alias("last_error"),
        F.max_by("at", seq).alias("last_error_at"))


def outcome_counters(outcomes: DataFrame, by: Sequence[str] = ("pipeline",)) -> DataFrame:
    """From one row per record with ``outcome`` out, dropped or dead_lettered
    and a ``parse_error`` flag."""
    is_ = lambda name: F.col("outcome") == name
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("events_in"),
        F.count_if(is_("out")).alias("events_out"),
        F.count_if(is_("dropped")).alias("events_dropped"),
        F.count_if(is_("dead_lettered")).alias("events_dead_lettered"),
        F.count_if(F.col("parse_error")).alias("parse_errors"))


def with_registry(counters: DataFrame, names: DataFrame, on: Sequence[str]) -> DataFrame:
    """Counters of registered names only; names without events get zeros."""
    numeric = [c for c, t in counters.dtypes if t in ("bigint", "int") and c not in on]
    out = names.select(*on).distinct().join(counters, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in numeric})


def relative_volume(counters: DataFrame, by: Sequence[str] = ("agent_id", "section")) -> DataFrame:
    """``events_in`` as a rounded percent of the busiest row of its table."""
    rows = counters.filter(F.col("field") == "events_in")
    top = rows.groupBy(*by).agg(F.max("value").alias("_max"))
    percent = F.when(F.col("_max") > 0, F.round(F.col("value") / F.col("_max") * 100)).otherwise(F.lit(0.0))
    return rows.join(top, list(by)).select(*by, "component", "value", percent.cast("int").alias("percent"))


def problem_rows(counters: DataFrame, by: Sequence[str] = ("agent_id",), errors: DataFrame | None = None) -> DataFrame:
    """Components in trouble: dropped events or parse errors in a pipeline,
    failed batches in an exporter. ``errors`` (``by…, component, last_error``)
    adds the text of an exporter's last error, NULL if it has none."""
    bad = (((F.col("section") == "pipelines") & F.col("field").isin("events_dropped", "parse_errors"))
           | ((F.col("section") == "exporters") & (F.col("field") == "batches_failed")))
    rows = counters.filter(bad & (F.col("value") > 0)).groupBy(*by, "section", "component").agg(
        F.array_join(F.array_sort(F.collect_set("field")), ",").alias("problems"), F.sum("value").alias("affected"))
    if errors is None:
        return rows
    texts = errors.select(*by, F.lit("exporters").alias("section"), "component", "last_error")
    return rows.join(texts, [*by, "section", "component"], "left")


def overview(counters: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Number of components per section."""
    return counters.select(*by, "section", "component").distinct().groupBy(*by, "section").agg(F.count("*").alias("components"))


def counter_deltas(counters: DataFrame, by: Sequence[str], order: str, span: int) -> DataFrame:
    """Growth since the scrape before; a counter that fell was reset, and its
    growth is the new value."""
    rows = with_previous(counters, by, order, ["value"], span)
    before = F.col("_prev.value")
    return rows.withColumns({
        "reset": F.coalesce(F.col("value") < before, F.lit(False)),
        "delta": F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before),
    }).drop("_prev")
