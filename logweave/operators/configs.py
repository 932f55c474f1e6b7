"""Jobs over tables of config documents (a fleet's agents and versions).

``configs`` holds the identifying columns ``by`` and ``doc``, as JSON text or
VARIANT. Unknown fields and ``${…}`` references are kept literally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.leaves import leaf_paths, tokens
from .chain import computed_once
from .routing import component_type

# Keys whose values are hidden, and what is shown instead.
SENSITIVE = ("token", "password", "secret", "api_key", "apikey")
REDACTED = "***redacted***"
PLACEHOLDER = "placeholder-value"

CATEGORY = {"receivers": "receiver", "exporters": "exporter", "extensions": "extension"}


#: Levels of a document that are taken apart step by step.
LEVELS = 6
#: Spark's parser of JSON takes 1,000 levels, its stack somewhat fewer: a deeper document would take the executor with it.
MAX_DEPTH = 500


def with_variant(configs: DataFrame) -> DataFrame:
    """Parse ``doc`` if it is text; a document that is not JSON becomes NULL, one of more
    than ``MAX_DEPTH`` levels fails the job rather than lose its leaves."""
    if dict(configs.dtypes)["doc"] == "variant":
        return configs
    # Few documents have as many brackets at all; only those are looked at closely.
    many = F.length("_text") - F.length(F.translate("_text", "{[", "")) > MAX_DEPTH
    error = F.raise_error(F.lit(f"config document nested deeper than {MAX_DEPTH}")).cast("variant")
    parsed = F.when(F.when(many, _depth(F.col("_text"))).otherwise(0) > MAX_DEPTH, error).otherwise(F.try_parse_json("_text"))
    return computed_once(configs.withColumnRenamed("doc", "_text"), "doc", parsed).drop("_text")


def _depth(text: Column) -> Column:
    """The deepest nesting of a JSON text, by one pass over the brackets outside of its texts."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brackets = F.regexp_extract_all(F.regexp_replace(plain, '"[^"]*"', ""), F.lit(r"[{}\[\]]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(brackets, start, step)["most"]


def objects(doc: Column, path: str) -> Column:
    """The fields of an object; NULL where there is none."""
    return F.try_variant_get(doc, path, "map<string,variant>")


def strings(value: Column, path: str) -> Column:
    """String items of a list; anything else in it is dropped."""
    items = F.try_variant_get(value, path, "array<variant>")
    texts = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(texts, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>"))


def config_components(configs: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """``(by…, category, id)`` of every defined receiver, exporter and extension."""
    docs = with_variant(configs)
    lists = F.array(*[F.struct(F.lit(c).alias("category"), F.map_keys(objects(F.col("doc"), f"$.{s}")).alias("ids"))
                      for s, c in CATEGORY.items()])
    one = docs.select(*by, F.inline(lists))
    return one.select(*by, "category", F.explode("ids").alias("id"))


def config_routes(configs: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """``(by…, pipeline, receivers, exporters)`` of every pipeline."""
    docs = with_variant(configs)
    each = docs.select(*by, F.explode(objects(F.col("doc"), "$.service.pipelines")).alias("pipeline", "_def"))
    return each.select(*by, "pipeline", strings(F.col("_def"), "$.receivers").alias("receivers"),
                       strings(F.col("_def"), "$.exporters").alias("exporters"))


def config_active_extensions(configs: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    docs = with_variant(configs)
    return docs.select(*by, F.explode(strings(F.col("doc"), "$.service.extensions")).alias("id"))


def config_host_settings(configs: DataFrame, type_: str = "dataset", by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Host fallback of each data-lake exporter, for ``config_audit``."""
    docs = with_variant(configs)
    each = docs.select(*by, F.explode(objects(F.col("doc"), "$.exporters")).alias("id", "_def"))
    text = lambda field: F.try_variant_get("_def", f"$.server_host.{field}", "string")
    return each.filter(component_type(F.col("id")) == type_).select(
        *by, "id", F.coalesce(text("use_hostname"), F.lit("true")).alias("use_hostname"), text("server_host").alias("server_host"))


def explode_config(configs: DataFrame, by: Sequence[str] = ("agent_id",)) -> tuple[DataFrame, DataFrame]:
    """Components and routes of a fleet's documents."""
    return config_components(configs, by), config_routes(configs, by)


def config_leaves(configs: DataFrame, by: Sequence[str] = ("agent_id",), redact: bool = False) -> DataFrame:
    """One row per leaf: ``(by…, path, value, is_text)``.

    ``path`` is an array of keys and ``[i]`` list positions. The first ``LEVELS`` levels,
    which is as deep as documents are as a rule, are a narrow step each; what is deeper
    comes out of one fold over its tokens. So the plan is the same for all documents,
    in a stream too, and nothing moves. Empty objects and lists are leaves. ``redact``
    replaces the whole subtree under a sensitive key.
    """
    spark = configs.sparkSession
    level = with_variant(configs).select(*by, F.array().cast("array<string>").alias("path"), "doc").filter("doc is not null")
    hidden = F.parse_json(F.lit(f'"{REDACTED}"'))
    for _ in range(LEVELS):
        children = spark.tvf.variant_explode_outer(F.col("doc").outer()).select(
            F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value"))
        value = F.when(F.lower("_key").isin(*SENSITIVE), hidden).otherwise(F.col("_value")) if redact else F.col("_value")
        step = F.coalesce(F.col("_key"), F.concat(F.lit("["), F.col("_pos"), F.lit("]")))
        level = level.lateralJoin(children).select(
            *by,
            F.when(F.col("_pos").isNull(), F.col("path")).otherwise(F.array_append("path", step)).alias("path"),
            F.when(F.col("_pos").isNull(), F.col("doc")).otherwise(value).alias("doc"),
        )
    text = F.to_json("doc")
    is_text = text.startswith('"')
    deeper = text.rlike(r"^[{\[]") & ~text.isin("{}", "[]")
    # The tokens are bound once, and only where there is something deeper.
    inside = F.flatten(F.transform(F.array(tokens(text)), lambda t: leaf_paths(t, SENSITIVE if redact else (), REDACTED)))
    value = F.when(is_text, F.variant_get("doc", "$", "string")).otherwise(text)
    each = level.select(*by, "path", value.alias("value"), is_text.alias("is_text"), F.explode_outer(F.when(deeper, inside)).alias("_leaf"))
    below = F.col("_leaf").isNotNull()
    return each.select(*by, F.when(below, F.concat("path", "_leaf.path")).otherwise(F.col("path")).alias("path"), F.when(below, F.col("_leaf.value")).otherwise(F.col("value")).alias("value"),
                       F.when(below, F.col("_leaf.is_text")).otherwise(F.col("is_text")).alias("is_text"))


def redact(configs: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Leaves with sensitive subtrees replaced, ``${…}`` references included."""
    return config_leaves(configs, by, redact=True)


def _under_sensitive(path: Column) -> Column:
    return F.exists(path, lambda p: F.lower(p).isin(*SENSITIVE))


def plaintext_secrets(leaves: DataFrame) -> DataFrame:
    """Sensitive leaves that hold a literal instead of a ``${…}`` reference."""
    return leaves.filter(_under_sensitive(F.col("path")) & ~F.contains("value", F.lit("${")) & ~F.col("value").isin("", "{}", "[]", "null"))


def placeholder(leaves: DataFrame) -> DataFrame:
    """Text that contains ``${`` replaced by a placeholder, for validation."""
    return leaves.withColumn("value", F.when(F.col("is_text") & F.contains("value", F.lit("${")), PLACEHOLDER).otherwise(F.col("value")))


def config_get(configs: DataFrame, path: str | Sequence[str], name: str = "value") -> DataFrame:
    """Add the text at a dotted path, or at a list of keys (ids hold dots and
    slashes); NULL where it is missing."""
    keys = path.split(".") if isinstance(path, str) else list(path)
    quoted = "$" + "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys)
    return with_variant(configs).withColumn(name, F.try_variant_get("doc", quoted, "string"))


def config_diff(a: DataFrame, b: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Leaves added, removed or changed between two leaf tables."""
    left = a.select(*by, "path", F.col("value").alias("old"))
    right = b.select(*by, "path", F.col("value").alias("new"))
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), [*by, "path"], "full")
    kind = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", kind).filter("change is not null").select(*by, "path", "change", "old", "new")


def component_census(components: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Per component type: how many are defined and by how many agents.

    Counted per agent first, so that the distinct count is a plain count.
    """
    typed = components.select(*by, "category", component_type(F.col("id")).alias("type"))
    per_agent = typed.groupBy(*by, "category", "type").agg(F.count("*").alias("n"))
    return per_agent.groupBy("category", "type").agg(F.sum("n").alias("components"), F.count("*").alias("agents"))
