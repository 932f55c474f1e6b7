"""The leaves of a JSON text with their paths, in one pass over its tokens.

A fold over the tokens keeps the path to where it is. Values in the accumulator
that are not binary are copied at every step, so the path (a slot of four bytes for
each open object or list) and the leaves found so far (their slots, and eight bytes
each that say where the slots end and which token is the value) are binary, and
what was found last is a block of its own. A slot is the number of a key's token, or a
list position with the highest bit set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a fold collects before it sets them aside.
_BLOCK = 2048
_LIST = 1 << 31
_HIDDEN = (1 << 32) - 1
# In compact JSON with escaped quotes out of the way. Empty objects and lists are one token.
_TOKEN = r'"[^"]*":?|\{\}|\[\]|[{}\[\]]|[^{}\[\],:"]+'
# Control characters do not occur in JSON texts: they stand for an escaped backslash and an escaped quote.
_BACKSLASH, _QUOTE = "\x01", "\x02"


def tokens(json: Column) -> Column:
    """Tokens of compact JSON, for ``leaf_paths``: keys end with a colon."""
    plain = F.replace(F.replace(json, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    return F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0))


def _text(token: Column) -> Column:
    """The text of a quoted token."""
    raw = F.substring(token, F.lit(2), F.length(token) - 2)
    escaped = F.contains(token, F.lit("\\")) | F.contains(token, F.lit(_BACKSLASH)) | F.contains(token, F.lit(_QUOTE))
    whole = F.replace(F.replace(token, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    return F.when(escaped, F.variant_get(F.parse_json(whole), "$", "string")).otherwise(raw)


def _slot(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value), 8, "0"))


def _number(data: Column, at: Column, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, at, F.lit(size))), 16, 10).cast("bigint")


def leaf_paths(tokens_: Column, sensitive: tuple[str, ...] = (), shown: str = "") -> Column:
    """An array of ``(path, value, is_text)``, one for each leaf, from ``tokens``.

    ``path`` is an array of keys and ``[i]`` list positions. Empty objects and
    lists are leaves. What stands under a key that is, in any case, among ``sensitive`` is
    one leaf with the text ``shown``.
    """
    none, zero = F.lit(b""), F.lit(0).cast("bigint")
    names = ("no", "top", "path", "hide", "size", "block", "slots", "entries", "ends")
    start = F.struct(*[v.alias(n) for n, v in zip(names, (zero, zero, none, zero, zero, none, none, none, none))])

    def grown(acc: Column, **changed: Column) -> Column:
        return F.struct(*[changed.get(n, acc[n]).alias(n) for n in names])

    def found(acc: Column, outer: Column, last: Column, token: Column, **changed: Column) -> Column:
        """With a leaf whose slots are those of ``outer`` and ``last``."""
        end = acc["size"] + F.octet_length(outer) + 4
        entry = F.unhex(F.lpad(F.hex(F.shiftleft(end, 32) + token), 16, "0"))
        full, listed = F.octet_length(acc["block"]) >= _BLOCK, F.octet_length(acc["entries"]) >= _BLOCK
        return grown(
            acc, size=end, block=F.concat(F.when(full, none).otherwise(acc["block"]), outer, _slot(last)), slots=F.when(full, F.concat(acc["slots"], acc["block"])).otherwise(acc["slots"]),
            entries=F.concat(F.when(listed, none).otherwise(acc["entries"]), entry), ends=F.when(listed, F.concat(acc["ends"], acc["entries"])).otherwise(acc["ends"]), **changed)

    def after(top: Column) -> Column:
        """The next place in a list; in an object a key comes next."""
        return F.when(top >= _LIST, top + 1).otherwise(top)

    def step(acc: Column, token: Column) -> Column:
        no = acc["no"] + 1
        size = F.octet_length(acc["path"]).cast("bigint")
        is_key = token.endswith(":")
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        inner = F.when(token == "[", F.lit(_LIST).cast("bigint")).otherwise(zero)
        deeper = grown(acc, no=no, path=F.concat(acc["path"], _slot(acc["top"])), top=inner)
        up = F.substring(acc["path"], F.lit(1), F.octet_length(acc["path"]) - 4)
        back = _number(acc["path"], F.octet_length(acc["path"]) - 3, 4)
        leaf = found(acc, acc["path"], acc["top"], no, no=no, top=after(acc["top"]))
        if not sensitive:
            return F.when(is_key, grown(acc, no=no, top=no)).when(opens, deeper).when(closes, grown(acc, no=no, path=up, top=after(back))).otherwise(leaf)
        # ``hide`` is the length of the path at the key whose value is hidden, and 0 where none is.
        hides = F.lower(F.substring(token, F.lit(2), F.length(token) - 3)).isin(*sensitive) & (acc["hide"] == 0)
        key = grown(acc, no=no, top=no, hide=F.when(hides, size).otherwise(acc["hide"]))
        hidden = lambda path, top: found(acc, path, top, F.lit(_HIDDEN), no=no, path=path, top=after(top), hide=zero)
        return (F.when(is_key, key).when(opens, deeper)
                .when(closes, F.when((acc["hide"] > 0) & (size - 4 == acc["hide"]), hidden(up, back)).otherwise(grown(acc, no=no, path=up, top=after(back))))
                .otherwise(F.when(acc["hide"] == 0, leaf).when(size == acc["hide"], hidden(acc["path"], acc["top"])).otherwise(grown(acc, no=no, top=after(acc["top"])))))

    folded = F.aggregate(tokens_, start, step, lambda acc: F.struct(F.concat(acc["slots"], acc["block"]).alias("slots"), F.concat(acc["ends"], acc["entries"]).alias("ends")))

    def read(all_: Column) -> Column:
        """All slots, as numbers, and the end and the value's token of each leaf."""
        ends = lambda i: _number(all_["ends"], i * 8 + 1, 8)
        mask = F.lit((1 << 32) - 1)

        def step_text(slot: Column) -> Column:
            key = F.get(tokens_, (slot - 1).cast("int"))
            return F.when(slot >= _LIST, F.concat(F.lit("["), (slot - _LIST).cast("string"), F.lit("]"))).otherwise(_text(F.substring(key, F.lit(1), F.length(key) - 1)))

        def leaf(i: Column) -> Column:
            first = F.when(i > 0, F.shiftright(ends(i - 1), 32)).otherwise(zero)
            n = ((F.shiftright(ends(i), 32) - first) / 4).cast("int")
            # The first slot is that of the document itself.
            at = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
            path = F.transform(at, lambda j: step_text(_number(all_["slots"], (first + j * 4 + 1).cast("int"), 4)))
            token = ends(i).bitwiseAND(mask)
            own = F.get(tokens_, (token - 1).cast("int"))
            text = (token == _HIDDEN) | own.startswith('"')
            value = F.when(token == _HIDDEN, F.lit(shown)).when(own.startswith('"'), _text(own)).otherwise(own)
            return F.struct(path.alias("path"), value.alias("value"), text.alias("is_text"))

        count = (F.octet_length(all_["ends"]) / 8).cast("int")
        return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), leaf)

    return F.flatten(F.transform(F.array(folded), read))
