"""Tags of sessions. Tag tables are small beside the history; Spark broadcasts them while their size allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import scalars as S


def tagged(session_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """source, session_id, name of every link."""
    return session_tags.join(tags.select(F.col("id").alias("tag_id"), "name", "display_name", "color"), "tag_id")


def with_tag(rows: DataFrame, session_tags: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Rows of sessions that have the tag: a semi join."""
    links = tagged(session_tags, tags).where(F.col("name") == S.tag_name(F.lit(tag)))
    return rows.join(links.select("source", "session_id"), ["source", "session_id"], "left_semi")


def list_tags(tags: DataFrame, session_tags: DataFrame, tag: str | None = None) -> DataFrame:
    rows = tags if tag is None else tags.where(F.col("name") == S.tag_name(F.lit(tag)))
    counts = session_tags.groupBy("tag_id").agg(F.count("*").alias("n"), F.min("created_ms").alias("first_ms"), F.max("created_ms").alias("last_ms"))
    out = rows.join(counts.withColumnRenamed("tag_id", "id"), "id", "left")
    return out.select("name", "display_name", "color", F.coalesce("n", F.lit(0)).alias("sessions"), "first_ms", "last_ms").orderBy("name")


def tagged_sessions(session_tags: DataFrame, tags: DataFrame, history: DataFrame, how: str = "left", tag: str | None = None) -> DataFrame:
    """Tagged sessions with project, number of prompts and last time; how='inner' leaves out those without prompts."""
    links = tagged(session_tags, tags)
    links = links if tag is None else links.where(F.col("name") == S.tag_name(F.lit(tag)))
    wanted = links.select("source", "session_id").distinct()
    sums = history.join(wanted, ["source", "session_id"], "left_semi").groupBy("source", "session_id").agg(F.min("project").alias("project"), F.count("*").alias("n"), F.max("timestamp_ms").alias("last_ms"))
    out = links.join(sums, ["source", "session_id"], how)
    return out.select("name", "source", "session_id", "project", F.coalesce("n", F.lit(0)).alias("n"), "last_ms").orderBy(F.desc("last_ms"), "name", "source", "session_id")


def tags_of_session(session_tags: DataFrame, tags: DataFrame, session_id: str, source: str | None = None) -> DataFrame:
    links = tagged(session_tags, tags).where(F.col("session_id") == session_id)
    links = links if source is None else links.where(F.col("source") == source)
    return links.select("name", "display_name", "color").distinct().orderBy("name")


def ensure_tag(tags: DataFrame, name: str, color: str | None, now_ms: int) -> DataFrame:
    """tags with the tag: display name and time are the new ones, a color stays unless a new one is given."""
    if not name.strip():
        raise ValueError("a tag needs a name")
    key = S.tag_name(F.lit(name))
    new = tags.sparkSession.range(1).select(key.alias("name"), F.lit(" ".join(name.split())).alias("new_name"), F.lit(color).cast("string").alias("new_color"))
    next_id = tags.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))
    out = tags.join(new, "name", "full").withColumn("_one", F.lit(1)).join(next_id.withColumn("_one", F.lit(1)), "_one")
    hit = F.col("new_name").isNotNull()
    return out.select(
        F.coalesce("id", "next_id").alias("id"), "name", F.coalesce("new_name", "display_name").alias("display_name"), F.coalesce("new_color", "color").alias("color"),
        F.coalesce("created_ms", F.lit(now_ms)).cast("long").alias("created_ms"), F.when(hit, F.lit(now_ms)).otherwise(F.col("updated_ms")).cast("long").alias("updated_ms"),
    )


def new_links(history: DataFrame, tags: DataFrame, session_tags: DataFrame, session_id: str, name: str, now_ms: int, source: str | None = None) -> DataFrame:
    """The links that tagging a session adds, one for each source that has the session; numbered after the last."""
    rows = history.where(F.col("session_id") == session_id)
    rows = (rows if source is None else rows.where(F.col("source") == source)).select("source", "session_id").distinct()
    tag = tags.where(F.col("name") == S.tag_name(F.lit(name))).select(F.col("id").alias("tag_id"), F.lit(1).alias("_one"))
    links = rows.withColumn("_one", F.lit(1)).join(tag, "_one").drop("_one").join(session_tags.select("source", "session_id", "tag_id"), ["source", "session_id", "tag_id"], "left_anti")
    last = session_tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"), F.lit(1).alias("_one"))
    nth = F.row_number().over(Window.orderBy("source"))  # a row per source at most
    return links.withColumn("nth", nth).withColumn("_one", F.lit(1)).join(last, "_one").select((F.col("last") + F.col("nth")).alias("id"), "source", "session_id", "tag_id", F.lit(now_ms).cast("long").alias("created_ms"))


def without_tag(session_tags: DataFrame, tags: DataFrame, session_id: str, name: str, source: str | None = None) -> DataFrame:
    """session_tags without a session's links to the tag: an anti join."""
    doomed = session_tags.where(F.col("session_id") == session_id)
    doomed = doomed if source is None else doomed.where(F.col("source") == source)
    doomed = doomed.join(tags.where(F.col("name") == S.tag_name(F.lit(name))).select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return session_tags.join(doomed.select("source", "session_id", "tag_id"), ["source", "session_id", "tag_id"], "left_anti").select(*session_tags.columns)
