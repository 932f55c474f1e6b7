"""Windows events exported as XML, one event per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maps
from ..operators.chain import computed_once

_EVENT = """System struct<Provider: struct<_Name: string>, EventID: string, Level: string,
    TimeCreated: struct<_SystemTime: string>, Channel: string, Computer: string>, _corrupt_record string"""


def read_windows_events(df: DataFrame, channel: str = "Security", query: str = "*", xml: str = "xml") -> DataFrame:
    """Records of one channel that an XPath ``query`` selects (``*`` is all).

    The XML stays in ``body``; the header fields become attributes. Rows that
    are not well-formed XML are not events and give no record.
    """
    kept = [c for c in df.columns if c != xml]
    df = computed_once(df, "_event", F.from_xml(F.col(xml), _EVENT, {"mode": "PERMISSIVE"}))
    system = F.col("_event.System")
    wanted = F.col("_event._corrupt_record").isNull() & (system["Channel"] == channel)
    # Only rows known to be well-formed reach the XPath engine.
    hit = F.lit(True) if query.strip() in ("", "*") else F.xpath_boolean(F.col(xml), F.lit(query))
    df = df.filter(F.when(wanted, hit).otherwise(F.lit(False)))
    return df.select(
        *kept, F.try_to_timestamp(system["TimeCreated"]["_SystemTime"]).alias("ts"), F.col(xml).alias("body"),
        maps.present({
            "event_id": system["EventID"], "channel": system["Channel"], "computer": system["Computer"],
            "provider": system["Provider"]["_Name"], "level": system["Level"], "time_created": system["TimeCreated"]["_SystemTime"],
        }).alias("attributes"))
