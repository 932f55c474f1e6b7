import duckdb
import pytest
from pyspark.sql import functions as F

from logweave.functions import regex
from logweave.operators.syslog import PATTERNS
from logweave.operators.templates import LINE_PATTERNS
from logweave.plans.lines import LINES, quote
from logweave.plans.registry import bare

SF = "/root/testdata/sf0.001"
ODD = ["", "x", "\n", "a b\n", "a\r", "a\x0bb", "%ASA-6-302013: up\n", "%ASA-6-302013: up\r", "%ASA-6-302013:\x0bup", "%ASA-6-302013: a\nb",
       "%ASA-6-302013: has \x01 in it", "<34>Oct  1 22:14:15 h su: x", "[2024-01-01 00:00:00,1] INFO a (b) (c.D$e)", "é %ASA-1-2: ü", "CEF:0|a|b|c|d|e|f|g"]


def lines(con):
    """Good and broken lines of every template, with newline, CR and VT variants."""
    con.execute(f"create or replace view events as select * from read_parquet('{SF}/events.parquet') where event_id < 8")
    found = set(ODD)
    for expr in LINES.values():
        for (text,) in con.execute(bare(f"select {expr} from {{events}}")).fetchall():
            found |= {text, text + "\n", text + "\r", text.replace(" ", "\x0b", 1), text.replace(" ", "\t", 1), text[:-1], "z" + text}
    return sorted(found)


@pytest.mark.parametrize("name", [*LINE_PATTERNS, *[f"syslog {p}" for p in PATTERNS], "loose", "flags", "optional"])
def test_same_captures_as_re2(spark, name):
    more = {"loose": r"(?P<word>\w+)\s(?P<rest>[^\s]*)$", "flags": r"(?i)(?P<a>[[:alpha:]]+)-(?P<b>\d)", "optional": r"^(?P<a>x)?(?P<b>.*?)(?: (?P<c>\S+))?$"}
    src = LINE_PATTERNS.get(name) or more.get(name) or PATTERNS[name.split()[-1]]
    pattern = regex.named(src)
    con = duckdb.connect()
    texts = lines(con)
    df = spark.createDataFrame([(t,) for t in texts], "body string").withColumn("g", regex.capture(F.col("body"), pattern))
    ok = regex.matched("g", pattern)
    got = df.select("body", ok.alias("ok"), *[F.when(ok, regex.group("g", pattern, n)).alias(n) for n in pattern.names]).collect()
    names = ", ".join(quote(n) for n in pattern.names)
    con.execute("create table t as select unnest(?::varchar[]) as body", [texts])
    told = {b: (m, g) for b, m, g in con.execute(
        f"select body, regexp_matches(body, {quote(src)}), regexp_extract(body, {quote(src)}, [{names}]) from t").fetchall()}
    assert len(got) == len(texts) == len(told)
    for row in got:
        match, groups = told[row.body]
        assert row.ok == match, (row.body, match)
        if match:
            assert {n: row[n] for n in pattern.names} == groups, row.body
    assert any(m for m, _ in told.values())


@pytest.mark.parametrize("bad", [r"(?=x)(?P<a>x)", r"(?P<a>x)\1", r"(?<!x)(?P<a>y)", r"(?P<a>x++)", r"(?P<a>[x)", r"(?P<a>x"])
def test_rejects_what_re2_rejects(bad):
    with pytest.raises(Exception):
        regex.named(bad)


def test_needs_a_named_group():
    with pytest.raises(ValueError, match="named group"):
        regex.named(r"^(\d+)$")
    assert regex.translate(r"^(\d+)$").names == []


def test_dollar_and_space():
    p = regex.translate(r"a\s[\w.$\s]+$")
    assert p.java == "(?d)a[\\t\\n\\f\\r ][\\w.$\\t\\n\\f\\r ]+\\z"
