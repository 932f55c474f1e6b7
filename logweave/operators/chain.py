"""The nine record operators, applied in order to a table of log records.

A chain knows most attribute names when it is planned (regex groups, ``add``
fields), so it carries each as a plain nullable column and builds the
attribute map only at the end. Selecting a few fields with ``Chain.flat`` never
builds the map, and Catalyst prunes the captures nobody asked for. Keys that
are only known from the data (JSON, key=value text) live in a map column
beside the plain columns; a plain column wins over the map.

Every parser takes ``on_error``: ``send``/``send_quiet`` forward the record
unparsed, ``drop``/``drop_quiet`` discard it. Failures are kept per record in
``_errors`` and ``_dropped`` for ``parse_quality``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maps, regex, severity, timefmt

ON_ERROR = ("send", "send_quiet", "drop", "drop_quiet")


# --- operator specs (plain dicts, the vocabulary of collector configs) ---

def regex_parse(pattern: str, parse_from: str = "body", parse_to: str = "attributes", on_error: str = "send") -> dict:
    return {"type": "regex_parser", "regex": pattern, "parse_from": parse_from, "parse_to": parse_to, "on_error": on_error}


def json_parse(parse_from: str = "body", parse_to: str = "attributes", on_error: str = "send") -> dict:
    return {"type": "json_parser", "parse_from": parse_from, "parse_to": parse_to, "on_error": on_error}


def kv_parse(parse_from: str = "body", parse_to: str = "attributes", delimiter: str = "=",
             pair_delimiter: str | None = None, on_error: str = "send", lenient: bool = False) -> dict:
    return {"type": "key_value_parser", "parse_from": parse_from, "parse_to": parse_to, "delimiter": delimiter,
            "pair_delimiter": pair_delimiter, "on_error": on_error, "lenient": lenient}


def severity_parse(parse_from: str = "attributes.severity", preset: str = "default", on_error: str = "send") -> dict:
    return {"type": "severity_parser", "parse_from": parse_from, "preset": preset, "on_error": on_error}


def time_parse(parse_from: str, layout_type: str = "strptime", layout: str = "%Y-%m-%dT%H:%M:%SZ", on_error: str = "send") -> dict:
    return {"type": "time_parser", "parse_from": parse_from, "layout_type": layout_type, "layout": layout, "on_error": on_error}


def add(field: str, value: str) -> dict:
    return {"type": "add", "field": field, "value": value}


def remove(field: str) -> dict:
    return {"type": "remove", "field": field}


def copy(from_: str, to: str) -> dict:
    return {"type": "copy", "from": from_, "to": to}


def move(from_: str, to: str) -> dict:
    return {"type": "move", "from": from_, "to": to}


# --- key=value text, usable on any column ---

_BLANK = r"\t\n\f\r "


def kv_parts(text: Column, delimiter: str = "=", pair_delimiter: str | None = None) -> Column:
    """``{keys, values}`` of the tokens of key=value text; the key is '' where a
    token has no key or no delimiter.

    Tokens are split at blanks unless ``pair_delimiter`` is given. Double-quoted
    stretches are not split and lose their quotes in values.
    """
    if pair_delimiter:
        stop = re.escape(pair_delimiter)
        token = rf'((?:[^"{stop}]++|"[^"]*+"?+)++)' if len(pair_delimiter) == 1 else None
        tokens = F.regexp_extract_all(text, F.lit(token), F.lit(1)) if token else F.split(text, stop, -1)
        tokens = F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t != "")
        at = lambda t: F.instr(t, F.lit(delimiter))
        keys = F.transform(tokens, lambda t: F.when(at(t) > 1, F.trim(F.substring(t, F.lit(1), at(t) - 1))).otherwise(""))
        values = F.transform(tokens, lambda t: F.trim(F.substring(t, at(t) + F.lit(len(delimiter)), F.length(t))))
    else:
        # Each match is one whole token: a pair, or else anything up to a blank.
        # Possessive repeats, so that Java takes a token of any length in a loop.
        d = re.escape(delimiter)
        rest = rf'[^"{_BLANK}]*+(?:"[^"]*+"?+[^"{_BLANK}]*+)*+'
        pair = rf'(?!{d})([^"{_BLANK}]+?){d}({rest})|(?=[^{_BLANK}]){rest}'
        keys = F.regexp_extract_all(text, F.lit(pair), F.lit(1))
        values = F.regexp_extract_all(text, F.lit(pair), F.lit(2))
    bare = F.when(F.contains(text, F.lit('"')), F.transform(values, lambda v: F.replace(v, F.lit('"'), F.lit("")))).otherwise(values)
    return F.struct(keys.alias("keys"), bare.alias("values"))


def kv_ok(parts: Column, lenient: bool = False) -> Column:
    keys = parts["keys"]
    some = F.size(F.array_remove(keys, "")) > 0 if lenient else (F.size(keys) > 0) & ~F.array_contains(keys, "")
    return F.coalesce(some, F.lit(False))


def kv_map(parts: Column, lenient: bool = False) -> Column:
    if not lenient:
        return maps.last_wins(parts["keys"], parts["values"])
    good = F.filter(F.arrays_zip(parts["keys"].alias("k"), parts["values"].alias("v")), lambda p: p["k"] != "")
    return maps.last_wins(F.transform(good, lambda p: p["k"]), F.transform(good, lambda p: p["v"]))


# Spec keys that are not usable as argument names here.
_ARG = {"from": "from_", "regex": "source"}


def computed_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """``withColumn`` that the optimizer may not fold into later expressions.

    Filters on a parsed field are otherwise pushed below the projection, which
    copies the parse into the filter, and again for every stage it rests on. A
    one-element ``explode`` stops that and stays in the same codegen stage.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


class _Fields:
    """One string map of a record: planned columns plus an optional map column.

    The columns are expressions over working columns that are never rewritten,
    so they can be read at any later stage.
    """

    def __init__(self, dynamic: str | None = None):
        self.static: dict[str, Column] = {}
        self.dynamic = dynamic

    def options(self, key: str) -> list[Column]:
        """Where the value may be, the first that is not NULL counts."""
        out = [self.static[key]] if key in self.static else []
        if self.dynamic:
            out.append(F.col(self.dynamic)[key])
            if "." in key:
                head, rest = key.split(".", 1)
                out.append(F.get_json_object(F.col(self.dynamic)[head], f"$.{rest}"))
        return out

    def get(self, key: str) -> Column:
        options = self.options(key)
        if not options:
            return F.lit(None).cast("string")
        return F.coalesce(*options) if len(options) > 1 else options[0]

    def put(self, values: dict[str, Column]) -> None:
        """Set fields where the new value is not NULL."""
        for key, value in values.items():
            options = self.options(key)
            self.static[key] = F.coalesce(value, *options) if options else value

    def as_map(self) -> Column:
        known = maps.present(self.static)
        if not self.dynamic:
            return known
        old = F.coalesce(F.col(self.dynamic), maps.empty())
        return maps.merge(old, known) if self.static else old


# Record columns that operators rewrite in place.
_PLAIN = {"body": "body", "severity": "severity_text", "severity_text": "severity_text",
          "severity_number": "severity_number", "ts": "ts", "timestamp": "ts"}


class Chain:
    """Plans operators over ``df``; nothing runs until the result is used."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.attributes = _Fields("attributes" if "attributes" in df.columns else None)
        self.resource = _Fields("resource" if "resource" in df.columns else None)
        self.errors: list[tuple[str, str, Column]] = []
        self.dropped: list[Column] = []
        self._n = 0
        missing = {"severity_text": "string", "severity_number": "int", "ts": "timestamp"}
        absent = {c: F.lit(None).cast(t) for c, t in missing.items() if c not in df.columns}
        if absent:
            self.df = df.withColumns(absent)
        self.carried = [c for c in df.columns if c not in ("body", "attributes", "resource", "ts", "severity_text", "severity_number")]

    # -- staging --

    def stage(self, **cols: Column) -> list[str]:
        """Add working columns in one projection; returns their names."""
        self._n += 1
        names = {f"_w{self._n}_{k}": c for k, c in cols.items()}
        self.df = self.df.withColumns(names)
        return list(names)

    def once(self, kind: str, expr: Column) -> str:
        """Stage a costly expression so that it runs exactly once per row."""
        self._n += 1
        name = f"_w{self._n}_{kind}"
        self.df = computed_once(self.df, name, expr)
        return name

    def replace(self, **cols: Column) -> None:
        self.df = self.df.withColumns(cols)

    # -- field paths --

    def _fields(self, path: str) -> tuple[_Fields, str] | None:
        for prefix, fields in (("attributes", self.attributes), ("resource", self.resource)):
            if path.startswith(prefix + "."):
                return fields, path[len(prefix) + 1:]
            if path.startswith(prefix + "["):
                return fields, path[len(prefix) + 1:].strip("]").strip("\"'")
        return None

    def get(self, path: str) -> Column:
        found = self._fields(path)
        if found:
            return found[0].get(found[1])
        if path in _PLAIN:
            return F.col(_PLAIN[path]).cast("string")
        if path in ("attributes", "resource"):
            return F.to_json(getattr(self, path).as_map())
        raise ValueError(f"unknown field {path!r}")

    def fixed(self, path: str) -> Column:
        """The field's value as it is now, safe to use after later changes."""
        return self.get(path) if self._fields(path) else F.col(*self.stage(value=self.get(path)))

    def put(self, path: str, value: Column) -> None:
        """Set a field where ``value`` is not NULL."""
        found = self._fields(path)
        if found:
            found[0].put({found[1]: value})
        elif path in ("body", "severity", "severity_text"):
            name = _PLAIN[path]
            self.replace(**{name: F.coalesce(value, F.col(name))})
        else:
            raise ValueError(f"cannot write field {path!r}")

    def unset(self, path: str) -> None:
        found = self._fields(path)
        if found:
            fields, key = found
            fields.static.pop(key, None)
            if fields.dynamic:
                (fields.dynamic,) = self.stage(map=F.map_filter(F.col(fields.dynamic), lambda k, _: k != key))
        elif path in ("body", "severity", "severity_text"):
            self.replace(**{_PLAIN[path]: F.lit(None).cast("string")})
        else:
            raise ValueError(f"cannot remove field {path!r}")

    # -- errors --

    def live(self, cond: Column) -> Column:
        """``cond`` on records no earlier operator has dropped."""
        for flag in self.dropped:
            cond = cond & ~flag
        return cond

    def fail(self, op: str, reason: str, cond: Column, on_error: str = "send") -> None:
        if on_error not in ON_ERROR:
            raise ValueError(f"on_error must be one of {ON_ERROR}, not {on_error!r}")
        flag = self.live(cond)
        if on_error.startswith("drop"):
            flag = F.col(*self.stage(drop=flag))
            self.dropped.append(flag)
        self.errors.append((op, reason, flag))

    # -- operators --

    def apply(self, specs: Iterable[dict]) -> Chain:
        for spec in specs:
            spec = dict(spec)
            kind = spec.pop("type")
            label = spec.pop("id", None) or kind
            method = getattr(self, "_" + kind, None)
            if kind not in OPERATOR_TYPES or method is None:
                raise ValueError(f"unknown operator {kind!r}; known: {', '.join(OPERATOR_TYPES)}")
            method(label, **{_ARG.get(k, k): v for k, v in spec.items()})
        return self

    def _store(self, parse_to: str, values: dict[str, Column], ok: Column) -> None:
        """Put planned fields, all NULL unless ``ok``, under ``parse_to``."""
        if parse_to in ("attributes", "resource"):
            getattr(self, parse_to).put(values)
        else:
            self.put(parse_to, F.when(ok, F.to_json(maps.present(values))))

    def _store_map(self, parse_to: str, parsed: str) -> None:
        """Merge a parsed map column into the target where it is not NULL."""
        new = F.col(parsed)
        if parse_to not in ("attributes", "resource"):
            self.put(parse_to, F.to_json(new))
            return
        fields = getattr(self, parse_to)
        fields.static = {k: F.coalesce(new[k], c) for k, c in fields.static.items()}
        if fields.dynamic is None:
            fields.dynamic = parsed
        else:
            old = F.coalesce(F.col(fields.dynamic), maps.empty())
            fields.dynamic = self.once("merged", F.when(new.isNotNull(), maps.merge(old, new)).otherwise(old))

    def _regex_parser(self, op, source, parse_from="body", parse_to="attributes", on_error="send"):
        pattern = regex.named(source)
        got = self.once("g", regex.capture(self.get(parse_from), pattern))
        ok = regex.matched(got, pattern)
        self.fail(op, "regex does not match", ~ok, on_error)
        self._store(parse_to, {n: regex.group(got, pattern, n) for n in pattern.names}, ok)

    def _json_parser(self, op, parse_from="body", parse_to="attributes", on_error="send"):
        got = self.once("json", maps.from_json_object(self.get(parse_from)))
        self.fail(op, "not a JSON object", F.col(got).isNull(), on_error)
        self._store_map(parse_to, got)

    def _key_value_parser(self, op, parse_from="body", parse_to="attributes", delimiter="=", pair_delimiter=None,
                          on_error="send", lenient=False):
        if not delimiter or delimiter == pair_delimiter:
            raise ValueError("delimiter must be set and differ from pair_delimiter")
        parts = self.once("kv", kv_parts(self.get(parse_from), delimiter, pair_delimiter))
        got = self.once("map", F.when(kv_ok(F.col(parts), lenient), kv_map(F.col(parts), lenient)))
        self.fail(op, "not key=value text", F.col(got).isNull(), on_error)
        self._store_map(parse_to, got)

    def _severity_parser(self, op, parse_from="attributes.severity", preset="default", on_error="send"):
        (num,) = self.stage(sev=severity.preset_number(self.get(parse_from), preset))
        self.fail(op, "unknown severity", F.col(num).isNull(), on_error)
        self.replace(
            severity_number=F.coalesce(F.col(num), F.col("severity_number")),
            severity_text=F.coalesce(severity.number_name(F.col(num)), F.col("severity_text")),
        )

    def _time_parser(self, op, parse_from, layout_type="strptime", layout="%Y-%m-%dT%H:%M:%SZ", on_error="send"):
        (got,) = self.stage(time=timefmt.parse_time(self.get(parse_from), layout, layout_type))
        self.fail(op, "time does not fit the layout", F.col(got).isNull(), on_error)
        self.replace(ts=F.coalesce(F.col(got), F.col("ts")))

    def _add(self, op, field, value):
        self.put(field, F.lit(str(value)))

    def _remove(self, op, field):
        self.fail(op, f"{field} is missing", self.fixed(field).isNull())
        self.unset(field)

    def _copy(self, op, from_, to):
        value = self.fixed(from_)
        self.fail(op, f"{from_} is missing", value.isNull())
        self.put(to, value)

    def _move(self, op, from_, to):
        value = self.fixed(from_)
        self.fail(op, f"{from_} is missing", value.isNull())
        self.unset(from_)
        self.put(to, value)

    # -- results --

    def _is_dropped(self) -> Column:
        gone = F.lit(False)
        for flag in self.dropped:
            gone = gone | flag
        return gone

    def _failed(self) -> Column:
        out = F.lit(False)
        for _, _, flag in self.errors:
            out = out | flag
        return out

    def _errors(self) -> Column:
        none = F.array().cast("array<struct<op:string,reason:string>>")
        reasons = [F.when(flag, F.struct(F.lit(op).alias("op"), F.lit(why).alias("reason"))) for op, why, flag in self.errors]
        # Most records have no error; they skip the building of the list.
        return F.when(self._failed(), F.array_compact(F.array(*reasons))).otherwise(none) if reasons else none

    def _kept(self, keep_dropped: bool) -> DataFrame:
        return self.df if keep_dropped or not self.dropped else self.df.filter(~self._is_dropped())

    def records(self, keep_dropped: bool = False) -> DataFrame:
        """The record table, with ``_errors`` (and ``_dropped`` if kept)."""
        cols = [
            *[F.col(c) for c in self.carried], "ts", "severity_text", "severity_number", "body",
            self.attributes.as_map().alias("attributes"), self.resource.as_map().alias("resource"),
            self._errors().alias("_errors"),
        ]
        if keep_dropped:
            cols.append(self._is_dropped().alias("_dropped"))
        return self._kept(keep_dropped).select(*cols)

    def flat(self, fields: dict[str, str] | list[str], keep: Iterable[str] = (), keep_dropped: bool = False) -> DataFrame:
        """Chosen fields as plain columns (``{output name: field path}``).

        ``_errors``, ``_dropped`` and ``_parse_error`` may be named as paths.
        """
        if not isinstance(fields, dict):
            fields = {f.rsplit(".", 1)[-1]: f for f in fields}
        special = {"_errors": self._errors, "_dropped": self._is_dropped, "_parse_error": self._failed,
                   "severity_number": lambda: F.col("severity_number"), "ts": lambda: F.col("ts")}
        cols = [(special[p]() if p in special else self.get(p)).alias(name) for name, p in fields.items()]
        return self._kept(keep_dropped).select(*keep, *cols)


OPERATOR_TYPES = (
    "regex_parser", "json_parser", "key_value_parser", "severity_parser", "time_parser",
    "add", "remove", "copy", "move",
)


def apply_operators(df: DataFrame, specs: Iterable[dict], keep_dropped: bool = False) -> DataFrame:
    """Run operator specs in order over a record table (batch or stream)."""
    return Chain(df).apply(specs).records(keep_dropped)


def parse_quality(df: DataFrame, *by: str) -> DataFrame:
    """Counts per source from records kept with ``keep_dropped=True``."""
    by = by or ("receiver",)
    failed = F.size("_errors") > 0
    return df.groupBy(*by).agg(
        F.count("*").alias("events_in"),
        F.count_if(~F.col("_dropped")).alias("events_out"),
        F.count_if(F.col("_dropped")).alias("events_dropped"),
        F.count_if(failed).alias("parse_errors"),
        F.count_if(~failed).alias("parsed"),
    ).withColumn("match_rate", F.col("parsed") / F.col("events_in"))


def stringify_attrs(df: DataFrame, column: str = "attributes") -> DataFrame:
    """Turn a struct, map or variant of typed values into a string map."""
    text = F.to_json(F.col(column), {"ignoreNullFields": "false"})
    return df.withColumn(column, F.coalesce(maps.from_json_object(text), maps.empty()))
