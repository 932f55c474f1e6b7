"""Syslog envelopes as column expressions over a table of raw lines.

The raw line stays in ``body``. A recognised envelope sets severity, timestamp
and the attributes below; ``message`` and ``content`` hold the text after the
header. A line in another protocol is not an error: it passes through with
severity unspecified, and ``syslog_mismatch_report`` counts it.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maps, regex, severity
from .chain import Chain

# The two header grammars and the bare priority prefix.
PATTERNS = {
    "rfc3164": r"^<(?P<pri>\d{1,3})>(?P<time>[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (?P<hostname>\S+) (?P<content>[\s\S]*)$",
    "rfc5424": r'^<(?P<pri>\d{1,3})>(?P<version>\d{1,2}) (?P<time>\S+) (?P<hostname>\S+) (?P<appname>\S+) (?P<proc_id>\S+) (?P<msg_id>\S+) (?P<structured_data>-|(?:\[[^\s="\]]+(?: [^\s="\]]+="[^"\\]*(?:\\.[^"\\]*)*")*\])+)(?: (?P<content>[\s\S]*))?$',
    "none": r"^<(?P<pri>\d{1,3})>(?P<content>[\s\S]*)$",
}
MAX_PRIORITY = 191

# Java walks a repeated group by recursion unless the repeat is possessive. The
# alternatives cannot overlap here, so that matches the same text in a loop.
_SD_ELEMENT = r'(\[[^ \t\n\f\r="\]]+(?: [^ \t\n\f\r="\]]+="[^"\\]*+(?:\\.[^"\\]*+)*+")*+\])'
_SD_PARAM = r' ([^ \t\n\f\r="\]]+)="([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_REPEATS = r'[^"\\]*(?:\\.[^"\\]*)*")*\])+)', r'[^"\\]*+(?:\\.[^"\\]*+)*+")*+\])++)'


def header(protocol: str) -> regex.Pattern:
    """The grammar of a header, in a form that takes structured data of any length."""
    found = regex.named(PATTERNS[protocol])
    return dataclasses.replace(found, java=found.java.replace(*_REPEATS), whole=found.whole.replace(*_REPEATS))


def structured_data(text: Column) -> Column:
    """Structured data as JSON text ``{id: {name: value}}``; NULL for ``-``."""
    elements = F.regexp_extract_all(text, F.lit(_SD_ELEMENT), F.lit(1))
    ids = F.transform(elements, lambda e: F.regexp_extract(e, r"^\[([^ \t\n\f\r=\"\]]+)", 1))

    def params(e: Column) -> Column:
        names = F.regexp_extract_all(e, F.lit(_SD_PARAM), F.lit(1))
        values = F.regexp_extract_all(e, F.lit(_SD_PARAM), F.lit(2))
        plain = F.when(F.contains(e, F.lit("\\")), F.transform(values, lambda v: F.regexp_replace(v, r'\\(["\\\]])', "$1"))).otherwise(values)
        return F.to_json(maps.last_wins(names, plain))

    bodies = F.transform(elements, params)
    keyed = F.transform(F.arrays_zip(ids.alias("id"), bodies.alias("body")), lambda z: F.concat(
        F.lit('"'), F.replace(z["id"], F.lit("\\"), F.lit("\\\\")), F.lit('":'), z["body"]))
    return F.when(text != "-", F.concat(F.lit("{"), F.array_join(keyed, ","), F.lit("}")))


def rfc3164_time(text: Column, year: int | None = None, reference: Column | None = None) -> Column:
    """The header has no year: take it from ``reference`` (a timestamp; a time
    after it belongs to the year before) or use ``year``."""
    clean = F.regexp_replace(text, r"\s+", " ")

    def at(y: Column) -> Column:
        return F.try_to_timestamp(F.concat_ws(" ", y.cast("string"), clean, F.lit("+0000")), F.lit("yyyy MMM d HH:mm:ss xx"))

    if reference is None:
        return at(F.lit(year if year is not None else 1970))
    this_year = at(F.year(reference))
    return F.when(this_year > reference, at(F.year(reference) - 1)).otherwise(this_year)


def envelope(chain: Chain, protocol: str, year: int | None = None, reference: Column | None = None) -> str:
    """Decode the header on a chain; returns the name of the column of header
    parts, NULL where there is no valid header."""
    if protocol not in PATTERNS:
        raise ValueError(f"protocol must be one of {sorted(PATTERNS)}, not {protocol!r}")
    pattern = header(protocol)
    raw = chain.once("env", regex.capture(F.col("body"), pattern))
    # NULL unless the header and its priority are valid, and so are its parts.
    valid = regex.group(raw, pattern, "pri").cast("int") <= MAX_PRIORITY
    (got,) = chain.stage(env=F.when(valid, F.col(raw)))
    part = lambda name: regex.group(got, pattern, name)
    pri = part("pri").cast("int")
    fields = {"priority": pri.cast("string"), "facility": F.floor(pri / 8).cast("string")}
    if protocol == "rfc5424":
        text = F.regexp_replace(part("content"), "^\ufeff", "")
        fields |= {n: F.nullif(part(n), F.lit("-")) for n in ("hostname", "appname", "proc_id", "msg_id")}
        fields |= {"version": part("version"), "structured_data": structured_data(part("structured_data"))}
        time = F.try_to_timestamp(F.nullif(part("time"), F.lit("-")))
    elif protocol == "rfc3164":
        text = part("content")
        fields["hostname"] = part("hostname")
        time = rfc3164_time(part("time"), year, reference)
    else:
        text, time = part("content"), None
    fields["content"] = text
    if protocol != "none":
        fields["message"] = text
    number = severity.syslog_number(pri % 8)
    chain._store("attributes", fields, F.col(got).isNotNull())
    chain.replace(
        severity_number=F.coalesce(number, F.col("severity_number")),
        severity_text=F.coalesce(severity.number_name(number), F.col("severity_text")),
        **({} if time is None else {"ts": F.coalesce(time, F.col("ts"))}),
    )
    return got


def normalize_syslog(df: DataFrame, protocol: str = "rfc3164", year: int | None = None, reference: Column | None = None) -> DataFrame:
    """Record table with the envelope decoded; adds ``envelope_matched``."""
    chain = Chain(df)
    got = envelope(chain, protocol, year, reference)
    chain.replace(envelope_matched=F.col(got).isNotNull())
    chain.carried.append("envelope_matched")
    return chain.records()


def syslog_mismatch_report(df: DataFrame, protocol: str = "rfc3164", by: str = "receiver") -> DataFrame:
    """Share of lines per receiver whose header is not ``protocol``, and the
    protocol that fits most of them (``protocol`` itself unless another fits more)."""
    other = "rfc5424" if protocol == "rfc3164" else "rfc3164"

    def fits(name: str) -> Column:
        pattern = header(name)
        pri = F.regexp_extract("body", r"^<(\d{1,3})>", 1).try_cast("int")
        return F.coalesce(F.col("body").rlike(pattern.java) & (pri <= MAX_PRIORITY), F.lit(False))

    counted = df.select(by, fits(protocol).alias("own"), fits(other).alias("other")).groupBy(by).agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("own")).alias("matched"),
        F.count_if(F.col("other")).alias("matched_other"),
    )
    return counted.select(
        by, "lines", (F.col("lines") - F.col("matched")).alias("mismatched"),
        ((F.col("lines") - F.col("matched")) / F.col("lines")).alias("mismatch_rate"),
        F.when(F.col("matched_other") > F.col("matched"), other).otherwise(protocol).alias("suggested_protocol"),
    )
