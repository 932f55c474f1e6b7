"""Receiver -> pipeline -> exporter graphs, one per agent, with the flow through them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chain import computed_once
from .configs import objects, strings, with_variant

def topology_nodes(components: DataFrame, routes: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """``(by…, id, type)``: every receiver and exporter, used or not, and every pipeline."""
    parts = components.filter(F.col("category").isin("receiver", "exporter")).select(*by, "id", F.col("category").alias("type"))
    return parts.unionByName(routes.select(*by, F.col("pipeline").alias("id"), F.lit("pipeline").alias("type")))


def topology_edges(routes: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """``(by…, from, to, kind)``; an id listed twice gives two edges."""
    inbound = routes.select(*by, F.explode("receivers").alias("from"), F.col("pipeline").alias("to"), F.lit("in").alias("kind"))
    outbound = routes.select(*by, F.col("pipeline").alias("from"), F.explode("exporters").alias("to"), F.lit("out").alias("kind"))
    return inbound.unionByName(outbound)


def topology_documents(routes: DataFrame, receivers: DataFrame, exporters: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """The graph of each agent as one value: ``(by…, topology)`` in the shape of
    ``schemas.SNAPSHOT``.

    Receivers come first, then exporters and pipelines, each by id; edges go by
    pipeline, in the order of its lists. A graph comes out of one config document.
    """
    edges = "array<struct<from:string,to:string>>"

    def part(rows: DataFrame, column: str, kind: str, out: Column) -> DataFrame:
        rank = F.lit(("receiver", "exporter", "pipeline").index(kind))
        return rows.select(*by, F.struct(rank.alias("rank"), F.col(column).alias("id"), F.lit(kind).alias("type"), out.cast(edges).alias("edges")).alias("_n"))

    def ends(column: str, edge: Callable[[Column], tuple[Column, Column]]) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda id_: F.struct(edge(id_)[0].alias("from"), edge(id_)[1].alias("to")))

    name = F.col("pipeline")
    own = F.concat(ends("receivers", lambda id_: (id_, name)), ends("exporters", lambda id_: (name, id_)))
    each = (part(receivers, "id", "receiver", F.array()).unionByName(part(exporters, "id", "exporter", F.array()))
            .unionByName(part(routes, "pipeline", "pipeline", own)))
    found = each.groupBy(*by).agg(F.array_sort(F.collect_set("_n")).alias("_n"))
    nodes = F.transform("_n", lambda n: F.struct(n["id"].alias("id"), n["type"].alias("type")))
    return found.select(*by, F.struct(nodes.alias("nodes"), F.flatten(F.transform("_n", lambda n: n["edges"])).alias("edges")).alias("topology"))


def agent_graphs(configs: DataFrame, counters: DataFrame, by: Sequence[str] = ("agent_id",), pipeline_volume: bool = False, locale_order: bool = True) -> DataFrame:
    """The flow graph of each agent, as one row ``(by…, nodes, links)``.

    ``configs`` has one document ``doc`` for each of ``by``, ``counters`` is ``(by…, section,
    component, field, value)``. Counters are added up per component and then meet
    the document of their agent; everything else happens inside its row.

    A node's flow is its own events_in, 0 if there is none. Never events_out:
    fan-out inflates it. With ``pipeline_volume`` that of a pipeline is what its receivers took
    in, one listed twice counted twice. A link has the flow of its source: a receiver's
    on the way in, a pipeline's on the way out; links without one of their ends are left
    out. Percents are of all that the receivers took in; 0 without any. The rank in a
    column is by flow, falling, then by id, in locale order as a browser would, or else by
    code point. Links go by pipeline, in the order of its lists. An
    agent without a document has no row. See ``graph_nodes`` and ``graph_links``.
    """
    by = list(by)
    zero = F.lit(0).cast("bigint")
    volume = counters.where(F.col("field") == "events_in").groupBy(*by, "section", "component").agg(F.sum("value").cast("bigint").alias("value"))
    entry = F.struct(F.concat_ws(" ", "section", "component").alias("key"), "value").alias("_volume")
    one = configs.select(*by, "doc").unionByName(volume.select(*by, entry), allowMissingColumns=True).groupBy(*by).agg(
        F.any_value("doc", True).alias("doc"), F.collect_list("_volume").alias("_volumes"))
    one = with_variant(one.where("doc is not null")).where("doc is not null")

    # Step by step: each column is used more than once.
    for name, value in (
        ("_flows", F.map_from_entries("_volumes")), ("_pipelines", objects(F.col("doc"), "$.service.pipelines")),
        ("_receivers", F.map_keys(objects(F.col("doc"), "$.receivers"))), ("_exporters", F.map_keys(objects(F.col("doc"), "$.exporters"))),
    ):
        one = computed_once(one, name, value)
    one = one.drop("_volumes", "doc")
    ids = lambda name: F.coalesce(F.col(name), F.array().cast("array<string>"))
    flow_of = lambda section, id_: F.coalesce(F.try_element_at("_flows", F.concat(F.lit(f"{section} "), id_)), zero)

    def route(name: Column) -> Column:
        definition = F.try_element_at("_pipelines", name)
        receivers = strings(definition, "$.receivers")
        taken = F.aggregate(receivers, zero, lambda sum_, id_: sum_ + flow_of("receivers", id_)) if pipeline_volume else flow_of("pipelines", name)
        return F.struct(name.alias("id"), receivers.alias("receivers"), strings(definition, "$.exporters").alias("exporters"), taken.alias("flow"))

    one = computed_once(one, "_routes", F.transform(F.array_sort(F.coalesce(F.map_keys("_pipelines"), F.array().cast("array<string>"))), route))
    total = F.aggregate(ids("_receivers"), zero, lambda sum_, id_: sum_ + flow_of("receivers", id_))
    one = computed_once(one, "_total", total)
    percent = lambda flow: F.when(F.col("_total") > 0, F.round(flow / F.col("_total") * 100)).otherwise(F.lit(0.0)).cast("int").alias("percent")

    def column(type_: str, rows: Column) -> Column:
        name = lambda id_: F.collate(id_, "UNICODE") if locale_order else id_
        ranked = F.array_sort(F.transform(rows, lambda n: F.struct((-n["flow"]).alias("order"), name(n["id"]).alias("name"), n["id"].alias("id"))))
        return F.transform(ranked, lambda n, i: F.struct(
            n["id"].alias("id"), F.lit(type_).alias("type"), (-n["order"]).alias("flow"), percent(-n["order"]), (i + 1).cast("bigint").alias("rank")))

    def own(section: str, name: str) -> Column:
        return F.transform(ids(name), lambda id_: F.struct(id_.alias("id"), flow_of(section, id_).alias("flow")))

    def links(r: Column) -> Column:
        end = lambda from_, to, kind, flow, there: F.struct(from_.alias("from"), to.alias("to"), F.lit(kind).alias("kind"), flow.alias("flow"), percent(flow), there.alias("_there"))
        into = F.transform(r["receivers"], lambda id_: end(id_, r["id"], "in", flow_of("receivers", id_), F.array_contains(ids("_receivers"), id_)))
        out = F.transform(r["exporters"], lambda id_: end(r["id"], id_, "out", r["flow"], F.array_contains(ids("_exporters"), id_)))
        return F.concat(into, out)

    nodes = F.concat(column("receiver", own("receivers", "_receivers")), column("pipeline", F.transform("_routes", lambda r: F.struct(r["id"], r["flow"]))),
                     column("exporter", own("exporters", "_exporters")))
    return one.select(*by, nodes.alias("nodes"), F.filter(F.flatten(F.transform("_routes", links)), lambda e: e["_there"]).alias("links"))


def graph_nodes(graphs: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """``(by…, id, type, flow, percent, rank)`` of every node; none where nothing is configured."""
    return graphs.select(*by, F.inline("nodes"))


def graph_links(graphs: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """``(by…, link_no, from, to, kind, flow, percent, offset)``: offset is the flow of
    the links before that end in the same node. The rows of an agent are where its graph
    was, so the window moves nothing."""
    each = graphs.select(*by, F.posexplode("links").alias("link_no", "_l")).select(*by, "link_no", *[f"_l.{c}" for c in ("from", "to", "kind", "flow", "percent")])
    below = Window.partitionBy(*by, "kind", "to").orderBy("link_no").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("offset", F.coalesce(F.sum("flow").over(below), F.lit(0)).cast("bigint"))


def compare_topology(nodes: DataFrame, agents: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Graphs of the chosen agents side by side, never merged."""
    return nodes.join(agents.select(*by).distinct(), list(by), "left_semi")
