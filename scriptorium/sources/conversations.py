"""The store of conversations: deliveries, titles, listing, single conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"


def latest(deliveries: DataFrame) -> DataFrame:
    """One row per id: the last archived delivery, of several the longest. A null edition is the default one."""
    keys = F.struct("archived", F.length("messages").alias("n"), "messages")
    rows = deliveries.groupBy("id").agg(F.max_by(F.struct(*[c for c in deliveries.columns if c != "id"]), keys).alias("r")).select("id", "r.*")
    return rows.withColumn("edition", F.coalesce("edition", F.lit("10e")))


def titles(turns: DataFrame, width: int = 60) -> DataFrame:
    """``id, title``: the first user message (id, pos, role, content), cut to ``width`` characters and dots. Conversations without
    one give no row."""
    first = turns.filter("role = 'user'").groupBy("id").agg(F.min_by("content", "pos").alias("t"))
    return first.select("id", F.when(F.length("t") > width, F.concat(F.substring("t", 1, width), F.lit("..."))).otherwise(F.col("t")).alias("title"))


def listing(store: DataFrame, user: str, edition: str) -> DataFrame:
    """A user's conversations of an edition, newest first."""
    return store.filter((F.col("user_name") == user) & (F.col("edition") == edition)).orderBy(F.desc("id")).select("id", "title", "created")


def messages_of(store: DataFrame, conv_id: int, user: str) -> DataFrame:
    """``pos, role, content`` of one conversation; empty if it is not the user's."""
    rows = store.filter((F.col("id") == conv_id) & (F.col("user_name") == user)).select(F.from_json("messages", MESSAGES).alias("m"))
    return rows.select(F.posexplode("m").alias("pos", "x")).select("pos", "x.role", "x.content")


def prompt(system: str, history: DataFrame, context: str, question: str, keep: int = 6) -> list[dict[str, str]]:
    """Messages for a model: instructions with the context, the last ``keep`` messages (pos, role, content), the question."""
    rows = history.orderBy(F.desc("pos")).limit(keep).collect()
    past = [{"role": r["role"], "content": r["content"]} for r in sorted(rows, key=lambda r: r["pos"])]
    return [{"role": "system", "content": f"{system}\n\n{context}"}, *past, {"role": "user", "content": question}]
