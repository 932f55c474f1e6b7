"""RE2-style patterns on Spark's Java regex engine.

Collector configs carry RE2 patterns with named groups. Spark runs
``java.util.regex``, which differs on group names, ``$``, ``.`` and ``\\s``.
``translate`` rewrites a pattern so both dialects accept the same lines and
capture the same text; ``capture`` runs it once per row for all groups.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# RE2's \s is these five characters; Java's also has vertical tab.
_SPACE = r"\t\n\f\r "
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")
_POSIX_CLASS = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank",
    "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower",
    "print": "Print", "punct": "Punct", "upper": "Upper", "xdigit": "XDigit",
}
_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")
_FLAGS = re.compile(r"\(\?([A-Za-z]*)(-[A-Za-z]+)?([:)])")

# Never part of a text log line; lines that do hold it take the slow path.
_SEP = "\x01"


@dataclass(frozen=True)
class Pattern:
    java: str
    groups: tuple[str | None, ...]
    whole: str

    @property
    def names(self) -> list[str]:
        return [g for g in self.groups if g]


def _read_class(src: str, i: int) -> tuple[str, int]:
    """Rewrite one ``[...]`` starting at ``i``; returns text and next index."""
    for anything in (r"[\s\S]", r"[\S\s]"):
        if src.startswith(anything, i):
            return anything, i + len(anything)
    out, i = "[", i + 1
    if src.startswith("^", i):
        out, i = out + "^", i + 1
    if src.startswith("]", i):
        out, i = out + r"\]", i + 1
    while i < len(src) and src[i] != "]":
        posix = _POSIX.match(src, i)
        if posix and posix[2] in _POSIX_CLASS:
            out += (r"\P" if posix[1] else r"\p") + "{" + _POSIX_CLASS[posix[2]] + "}"
            i = posix.end()
        elif src[i] == "\\" and i + 1 < len(src):
            esc = src[i + 1]
            out += {"s": _SPACE, "S": f"[^{_SPACE}]"}.get(esc, "\\" + esc)
            i += 2
        else:
            out += "\\" + src[i] if src[i] in "[&~" else src[i]
            i += 1
    if i >= len(src):
        raise ValueError(f"unterminated character class in {src!r}")
    return out + "]", i + 1


def translate(src: str) -> Pattern:
    """RE2 pattern -> Java pattern plus group names in order.

    Raises ``ValueError`` for constructs RE2 itself rejects (look-around,
    back-references, possessive quantifiers).
    """
    out, groups, i, depth, top_alt = "", [], 0, 0, False
    multiline = re.match(r"\(\?[a-z]*m", src) is not None
    while i < len(src):
        ch = src[i]
        if ch == "\\" and i + 1 < len(src):
            esc = src[i + 1]
            if esc.isdigit() and esc != "0" or esc in "kCGZ":
                raise ValueError(f"\\{esc} is not available in {src!r}")
            if esc == "Q":
                end = src.find(r"\E", i)
                end = len(src) if end < 0 else end + 2
                out, i = out + src[i:end], end
                continue
            out += {"s": f"[{_SPACE}]", "S": f"[^{_SPACE}]"}.get(esc, "\\" + esc)
            i += 2
        elif ch == "[":
            text, i = _read_class(src, i)
            out += text
        elif ch == "(":
            depth += 1
            named, flags = _NAMED.match(src, i), _FLAGS.match(src, i)
            if named:
                groups.append(named[1])
                out, i = out + "(", named.end()
            elif flags:
                if "U" in flags[1]:
                    raise ValueError(f"flag U is not available in {src!r}")
                if flags[3] == ")":
                    depth -= 1
                out, i = out + flags[0], flags.end()
            elif src.startswith("(?", i):
                raise ValueError(f"look-around is not available in {src!r}")
            else:
                groups.append(None)
                out, i = out + "(", i + 1
        elif ch == "$":
            out, i = out + (r"(?=\n|\z)" if multiline else r"\z"), i + 1
        else:
            if ch == "+" and i and src[i - 1] in "*+?}" and not src.endswith("\\" + src[i - 1], 0, i):
                raise ValueError(f"possessive quantifier in {src!r}")
            depth -= ch == ")"
            top_alt = top_alt or (ch == "|" and depth == 0)
            out, i = out + ch, i + 1
    if depth:
        raise ValueError(f"unbalanced brackets in {src!r}")
    head = "" if src.startswith("^") and not top_alt and not multiline else r"\A[\s\S]*?"
    tail = "" if src.endswith("$") and not src.endswith("\\$") and not top_alt and not multiline else r"[\s\S]*\z"
    whole = f"(?d){head}{out}{tail}" if not head and not tail else f"(?d){head}(?:{out}){tail}"
    return Pattern("(?d)" + out, tuple(groups), whole)


def named(src: str) -> Pattern:
    """``translate`` for parsers, which need at least one named group."""
    pattern = translate(src)
    if not pattern.names:
        raise ValueError(f"pattern needs at least one named group: {src!r}")
    return pattern


def capture(text: Column, pattern: Pattern) -> Column:
    """Named groups of the first match as one array, after a leading ``''``.

    One regex pass per row: a matched line is rewritten to its groups with a
    separator in front of each, then split. ``regexp_extract`` per group would
    run the pattern once per group and once more for the match test. A line
    that holds the separator itself gets one it cannot hold, made from its own
    SHA-256. A line that does not match comes back unsplit, so test with
    ``matched``. Put the result in its own column before reading from it.
    """
    idx = [i + 1 for i, g in enumerate(pattern.groups) if g]

    def parts(sep: Column, groups: list[Column]) -> Column:
        return F.split(F.regexp_replace(text, F.lit(pattern.whole), F.concat(*groups)), sep, -1)

    plain = F.split(F.regexp_replace(text, F.lit(pattern.whole), F.lit("".join(f"{_SEP}${i}" for i in idx))), _SEP, -1)
    own = F.concat(F.lit(_SEP), F.sha2(text, 256), F.lit(_SEP))
    rare = parts(own, [c for i in idx for c in (own, F.lit(f"${i}"))])
    return F.when(F.contains(text, F.lit(_SEP)), rare).otherwise(plain)


def matched(captured: str, pattern: Pattern) -> Column:
    """Whether the line behind a captured column matched."""
    return F.expr(f"coalesce(size(`{captured}`) = {len(pattern.names) + 1}, false)")


def group(captured: str, pattern: Pattern, name: str) -> Column:
    """Text of one named group; NULL when the line did not match."""
    return F.expr(f"get(`{captured}`, {pattern.names.index(name) + 1})")
