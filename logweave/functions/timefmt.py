"""Collector time layouts -> Spark datetime patterns.

Layouts without a zone directive are read as UTC whatever the session zone is.
An unknown directive fails when the job is built, not row by row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strptime directives and the Spark pattern letters they mean.
STRPTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "b": "MMM", "h": "MMM",
    "B": "MMMM", "j": "DDD", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "L": "SSS", "p": "a", "z": "xx", "Z": "z",
    "T": "HH:mm:ss", "F": "yyyy-MM-dd",
}

# Reference-time tokens, longest first.
GOTIME = [
    ("January", "MMMM"), ("Z07:00", "XXX"), ("-07:00", "xxx"), ("Z0700", "XX"),
    ("-0700", "xx"), ("2006", "yyyy"), ("Jan", "MMM"), ("MST", "z"),
    ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"),
    ("06", "yy"), ("15", "HH"), ("PM", "a"), ("_2", "d"),
    ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
]

# Epoch layouts and the number of microseconds in one unit.
EPOCH_UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1}

_GO_FRACTION = re.compile(r"([.,])(0+|9+)")
_WEEKDAY = re.compile(r"Mon(day)?")
_ZONE = re.compile(r"(?<!')[xXz]+(?!')")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]{}#]", text) else text


def _strptime(layout: str) -> str:
    out = ""
    for part in re.findall(r"%.|[^%]+|%$", layout, flags=re.S):
        if not part.startswith("%"):
            out += _literal(part)
        elif part == "%%":
            out += "%"
        elif part[1:] in STRPTIME:
            out += STRPTIME[part[1:]]
        else:
            raise ValueError(f"unsupported directive {part!r} in {layout!r}")
    return out


def _gotime(layout: str) -> str:
    out, i = "", 0
    while i < len(layout):
        fraction = _GO_FRACTION.match(layout, i)
        if _WEEKDAY.match(layout, i):
            raise ValueError(f"weekday names cannot be parsed: {layout!r}")
        if fraction and out.endswith(("s", "ss")):
            digits = "S" * len(fraction[2])
            out += f"[{fraction[1]}{digits}]" if fraction[2][0] == "9" else fraction[1] + digits
            i = fraction.end()
            continue
        for token, letters in GOTIME:
            if layout.startswith(token, i):
                out, i = out + letters, i + len(token)
                break
        else:
            out, i = out + _literal(layout[i]), i + 1
    return out.replace("''", "") if "'" in out and "'''" not in out else out


def to_spark_pattern(layout: str, layout_type: str = "strptime") -> str:
    if layout_type == "strptime":
        return _strptime(layout)
    if layout_type == "gotime":
        return _gotime(layout)
    raise ValueError(f"unknown layout type {layout_type!r}")


def parse_time(text: Column, layout: str, layout_type: str = "strptime") -> Column:
    """Timestamp read from ``text``; NULL where the text does not fit."""
    if layout_type == "epoch":
        return _epoch(text, layout)
    if layout_type == "strptime" and layout == "%s":
        return _epoch(text, "s")
    pattern = to_spark_pattern(layout, layout_type)
    if _ZONE.search(re.sub(r"'[^']*'", "", pattern)):
        return F.try_to_timestamp(text, F.lit(pattern))
    return F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(pattern + " xx"))


def _epoch(text: Column, unit: str) -> Column:
    if unit == "ns":
        return F.timestamp_micros((text.try_cast("decimal(38,0)") / 1000).cast("bigint"))
    whole = unit.split(".")[0]
    if whole not in EPOCH_UNITS:
        raise ValueError(f"unknown epoch layout {unit!r}")
    value = text.try_cast("decimal(38,9)") if "." in unit else text.try_cast("bigint")
    return F.timestamp_micros((value * EPOCH_UNITS[whole]).cast("bigint"))
