"""Captured syslog traffic, and the splitting of TCP payloads into messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_syslog_frames(source: DataFrame, receiver: str, transport: str = "udp", payload: str = "payload",
                       received_at: str = "received_at") -> DataFrame:
    """Frames ``(receiver, transport, payload, received_at)`` from a landed
    table or stream (files, or a Kafka topic's ``value`` and ``timestamp``)."""
    if transport not in ("udp", "tcp"):
        raise ValueError(f"transport must be udp or tcp, not {transport!r}")
    kept = [c for c in source.columns if c not in ("receiver", "transport", payload, received_at)]
    return source.select(*kept, F.lit(receiver).alias("receiver"), F.lit(transport).alias("transport"),
                         F.col(payload).cast("string").alias("payload"), F.col(received_at).cast("timestamp").alias("received_at"))


def kafka_frames(spark: SparkSession, servers: str, topic: str, receiver: str, transport: str = "udp", stream: bool = True) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    raw = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return read_syslog_frames(raw, receiver, transport, "value", "timestamp")


#: Bytes of frame positions that a fold collects before it sets them aside.
_BLOCK = 2048


def split_octet_frames(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Messages of octet-counted payloads (``<bytes> <message>…``).

    Adds ``frame_no``, ``message`` and ``_leftover``: the tail that does not
    hold a whole frame (NULL if nothing is left). A payload without a whole
    frame gives one row with a NULL message. Lengths count bytes.

    A fold copies what it has gathered at every step, all but binary values. So
    the payload and the positions found, eight bytes each, are binary, and the
    newest positions are a block of their own.
    """
    none = F.lit(b"")
    start = F.struct(F.col(payload).cast("binary").alias("data"), F.lit(1).alias("pos"), none.alias("block"), none.alias("found"), F.lit(False).alias("done"))

    def step(acc, _):
        head = F.regexp_extract(F.substring(acc["data"], acc["pos"], F.lit(11)).cast("string"), r"^([0-9]{1,9}) ", 1)
        at = acc["pos"] + F.length(head) + 1
        n = F.when(head != "", head).cast("int")
        whole = F.coalesce(at + n - 1 <= F.octet_length(acc["data"]), F.lit(False))
        entry = F.unhex(F.lpad(F.hex(F.shiftleft(at.cast("bigint"), 32) + n), 16, "0"))
        full = F.octet_length(acc["block"]) >= _BLOCK
        grown = F.struct(acc["data"].alias("data"), (at + n).alias("pos"), F.concat(F.when(full, none).otherwise(acc["block"]), entry).alias("block"),
                         F.when(full, F.concat(acc["found"], acc["block"])).otherwise(acc["found"]).alias("found"), F.lit(False).alias("done"))
        ended = F.struct(*[acc[name].alias(name) for name in ("data", "pos", "block", "found")], F.lit(True).alias("done"))
        return F.when(acc["done"], acc).when(whole, grown).otherwise(ended)

    def cut(acc):
        entry = lambda i: F.conv(F.hex(F.substring(acc["found"], i * 8 + 1, F.lit(8))), 16, 10).cast("bigint")
        text = lambda e: F.substring(acc["data"], F.shiftright(e, 32).cast("int"), e.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).cast("string")
        count = F.octet_length(acc["found"]) / 8
        numbers = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        left = F.when(acc["pos"] <= F.octet_length(acc["data"]), F.substring(acc["data"], acc["pos"], F.octet_length(acc["data"])).cast("string"))
        return F.struct(F.transform(numbers, lambda i: text(entry(i))).alias("messages"), left.alias("left"))

    # No payload holds more frames than it has digits before a blank.
    most = F.regexp_count(F.col(payload).cast("string"), F.lit(r"[0-9] "))
    steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(steps, start, step, lambda acc: F.struct(acc["data"].alias("data"), acc["pos"].alias("pos"), F.concat(acc["found"], acc["block"]).alias("found")))
    cut_up = df.select("*", F.explode(F.transform(F.array(folded), cut)).alias("_fold"))
    return cut_up.select(*df.columns, F.col("_fold.left").alias("_leftover"), F.posexplode_outer("_fold.messages").alias("frame_no", "message")).select(
        *df.columns, "frame_no", "message", "_leftover")
