"""Severity numbers, their names, and the presets of the severity parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 25 severity numbers of the published log data model.
NUMBER_NAMES = ["UNSPECIFIED"] + [
    f"{level}{step if step > 1 else ''}"
    for level in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
    for step in (1, 2, 3, 4)
]

# Syslog level 0..7 -> severity number.
SYSLOG_NUMBERS = [21, 19, 18, 17, 13, 10, 9, 5]

# Words the default preset understands, besides the number names.
ALIASES = {
    "emerg": 21, "emergency": 21, "panic": 21, "alert": 19, "crit": 18, "critical": 18,
    "err": 17, "warning": 13, "notice": 10, "information": 9, "informational": 9,
}

PRESETS = {
    "default": {
        **{str(level): number for level, number in enumerate(SYSLOG_NUMBERS)},
        **{name.lower(): number for number, name in enumerate(NUMBER_NAMES) if number},
        **ALIASES,
    },
    "none": {},
}


def preset_number(value: Column, preset: str = "default") -> Column:
    """Severity number for a field value, ignoring case; NULL if unknown."""
    if preset not in PRESETS:
        raise ValueError(f"unknown severity preset {preset!r}")
    entries = ", ".join(f"'{word}', {number}" for word, number in PRESETS[preset].items())
    if not entries:
        return F.lit(None).cast("int")
    return F.element_at(F.expr(f"map({entries})"), F.lower(value))


def syslog_number(level: Column) -> Column:
    return F.get(F.expr(f"array({', '.join(map(str, SYSLOG_NUMBERS))})"), level)


def number_name(number: Column) -> Column:
    names = ", ".join(f"'{name}'" for name in NUMBER_NAMES)
    return F.get(F.expr(f"array({names})"), number)


def label(text: Column, number: Column) -> Column:
    """Severity text when there is one, else the name of the number."""
    name = F.coalesce(number_name(F.coalesce(number, F.lit(0))), F.lit(NUMBER_NAMES[0]))
    return F.coalesce(F.nullif(text, F.lit("")), name)


def severity_class(severity: Column) -> Column:
    s = F.lower(F.coalesce(severity, F.lit("")))
    return (
        F.when(s.contains("err") | s.contains("fatal"), "error")
        .when(s.contains("warn"), "warn")
        .when(s.contains("info"), "info")
        .when(s.contains("debug"), "debug")
        .when(s.contains("trace"), "trace")
        .otherwise("info")
    )
