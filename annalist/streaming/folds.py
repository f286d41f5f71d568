"""Sessions folded as their rows come, with state that Spark keeps and drops again.

A session's state holds, for each column, the last value that was there and the seq it came with. Each batch gives the
sessions that it touched as they are now. A state that wasn't touched for some time is dropped by its time to live; a row
that comes later starts a new one, and its summary is a part: since parts carry the seq of each value, any number of
them fold to the same summary as all rows at once, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LAST = ("cwd", "git_branch", "last_assistant_text", "raw_path")
KEY = "session_id string, source string"
STATE = ", ".join(f"{c} string, {c}_seq long" for c in LAST) + ", parser_version int, parser_version_seq long, first_activity_ms long, last_activity_ms long"
PARTS = f"{KEY}, {STATE}"


def fold_parts(parts: DataFrame) -> DataFrame:
    """Parts of sessions folded: of each column the value of the greatest seq, the least first and the greatest last time."""
    columns = [*LAST, "parser_version"]
    out = parts.groupBy("session_id", "source").agg(
        *(F.max(F.when(F.col(c).isNotNull(), F.struct(f"{c}_seq", c))).alias(c) for c in columns), F.min("first_activity_ms").alias("first_activity_ms"), F.max("last_activity_ms").alias("last_activity_ms")
    )
    values = [x for c in columns for x in (F.col(f"{c}.{c}").alias(c), F.col(f"{c}.{c}_seq").alias(f"{c}_seq"))]
    return out.select("session_id", "source", *values, "first_activity_ms", "last_activity_ms").select(*(c.split()[0] for c in PARTS.split(", ")))


class SessionFold(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [c.split()[0] for c in STATE.split(", ")]
        now = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(names)
        for some in rows:
            for c in (*LAST, "parser_version"):
                there = some[some[c].notna()]
                if len(there):
                    last = there.loc[there["seq"].idxmax()]
                    if now[f"{c}_seq"] is None or int(last["seq"]) >= now[f"{c}_seq"]:
                        now[c], now[f"{c}_seq"] = (int(last[c]) if c == "parser_version" else last[c]), int(last["seq"])
            for c, least in (("first_activity_ms", min), ("last_activity_ms", max)):
                there = some[c].dropna()
                if len(there):
                    value = int(least(there))
                    now[c] = value if now[c] is None else least(now[c], value)
        self.state.update(tuple(now.values()))
        yield pd.DataFrame({"session_id": [key[0]], "source": [key[1]], **{c: pd.Series([v], dtype=object) for c, v in now.items()}})

    def close(self) -> None:
        pass


def session_parts(rows: DataFrame, idle_ms: int = 6 * 3_600_000) -> DataFrame:
    """A stream of parts (PARTS) of the sessions of streamed rows (the columns of store.fold_sessions, with seq as long).

    The query needs Spark's RocksDB state store. State: a row for each session that was touched in the last idle_ms.
    """
    rows = rows.select("session_id", "source", *LAST, "parser_version", "first_activity_ms", "last_activity_ms", "seq")
    return rows.groupBy("session_id", "source").transformWithStateInPandas(statefulProcessor=SessionFold(idle_ms), outputStructType=PARTS, outputMode="Update", timeMode="ProcessingTime")


def first_seen(rows: DataFrame, keys: tuple[str, ...], within: str = "1 hour") -> DataFrame:
    """A stream without the rows whose key came in the last `within`; the rest of the repeats is the store's to know.

    Time is when a row arrives, so no row is late and none is lost; keys older than `within` leave the state.
    """
    return rows.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within).dropDuplicatesWithinWatermark(list(keys)).drop("_arrived")
