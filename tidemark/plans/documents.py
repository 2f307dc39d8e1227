"""The reports as JSON, for a distributed write.

The nested documents come as lines in an order: one line per entry, with the braces and commas that
its place asks for, so all lines of a snapshot joined are the one document a single machine would
print, whatever its size. What a line opens and closes follows from the first and last names around
it, which are mergeable minima and maxima; no task sees more than its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators.clean import Prepared
from tidemark.plans.reports import status, summary, topic_info, topic_info_parts


def _inside(document: Column, end: int = 1) -> Column:
    """JSON text without its opening brace and its last `end` characters."""
    return F.substring(document, F.lit(2), F.length(document) - (1 + end))


def _in_lines(rows: DataFrame, outer: str, inner: str, before: str, after: str) -> DataFrame:
    """Lines of rows (snapshot_id, outer, inner, head, entry, tail): the document opens with
    `before` and ends with `after`; an outer name opens with `head` and ends with `tail`; entries are
    parted by commas. Every row has its own (snapshot_id, outer, inner); inner may be null where
    an outer name has no entries. Columns: the keys, opening, head, entry, closing and line."""
    keys = ["snapshot_id", outer]
    within = rows.groupBy(*keys).agg(F.min(inner).alias("_first"), F.max(inner).alias("_last"))
    ends = within.groupBy("snapshot_id").agg(F.min(outer).alias("_from"), F.max(outer).alias("_to"))
    placed = rows.join(within.join(ends, "snapshot_id"), keys)
    first, last = F.col(inner).eqNullSafe(F.col("_first")), F.col(inner).eqNullSafe(F.col("_last"))
    opens, ends_all = first & (F.col(outer) == F.col("_from")), last & (F.col(outer) == F.col("_to"))
    made = placed.select(
        *keys,
        inner,
        F.when(opens, before).otherwise(",").alias("opening"),
        F.when(first, F.col("head")).otherwise("").alias("head"),
        F.coalesce("entry", F.lit("")).alias("entry"),
        F.concat(F.when(last, F.col("tail")).otherwise(""), F.when(ends_all, after).otherwise("")).alias("closing"),
    )
    return made.withColumn("line", F.concat("opening", "head", "entry", "closing"))


def summary_document(prepared: Prepared, topic_configs: DataFrame | None = None) -> DataFrame:
    """{group: {state, topics: {topic: {partitions, lag_max, lag_min, par, cv[, configs]}}}}, in lines
    by snapshot, group and topic."""
    configs = F.when(F.size("configs") > 0, F.col("configs"))
    body = F.struct("partitions", "lag_max", "lag_min", "par", "cv", configs.alias("configs"))
    rows = summary(prepared, topic_configs).select(
        *S.STATS_KEY,
        F.concat(
            _inside(F.to_json(F.create_map("group_id", F.struct("state"))), 2), F.lit(',"topics":{')
        ).alias("head"),
        F.when(F.col("topic").isNotNull(), _inside(F.to_json(F.create_map("topic", body)))).alias("entry"),
        F.lit("}}").alias("tail"),
    )
    return _in_lines(rows, "group_id", "topic", "{", "}")


def status_documents(prepared: Prepared) -> DataFrame:
    """{"group-topic": {eta, rate, lag}}, one line per group and topic."""
    verdict = F.struct("eta", "rate", "lag")
    return status(prepared).select(
        *S.STATS_KEY, F.to_json(F.create_map("status_key", verdict)).alias("document")
    )


def topic_document(topic_partitions: DataFrame, parts: bool = False) -> DataFrame:
    """{topics: {name: {name, partitions[, partinfo: [...]]}}}, in lines by snapshot, topic and
    partition; without `parts` a topic is one line."""
    keys = ["snapshot_id", "topic"]
    topics = topic_info(topic_partitions).select(*keys, "partitions")
    body = F.struct(F.col("topic").alias("name"), "partitions")
    head, entry, tail = _inside(F.to_json(F.create_map("topic", body)), 2), F.lit(None).cast("string"), "}"
    if parts:
        # `nisrs` holds the list of in-sync replicas, as the printed document has it.
        info = F.struct(F.col("partition").alias("id"), "leader", "replicas", F.col("isr").alias("nisrs"))
        listed = topic_info_parts(topic_partitions).select(*keys, "partition", F.to_json(info).alias("entry"))
        topics, entry = topics.join(listed, keys, "left"), F.col("entry")
        head, tail = F.concat(head, F.lit(',"partinfo":[')), "]}"
    else:
        topics = topics.withColumn("partition", F.lit(None).cast("int"))
    rows = topics.select(*keys, "partition", head.alias("head"), entry.alias("entry"), F.lit(tail).alias("tail"))
    return _in_lines(rows, "topic", "partition", '{"topics":{', "}}")


def broker_documents(brokers: DataFrame, broker_name: str = "", cluster_id: str = "") -> DataFrame:
    """{brokers: {id: {id, host, port}}, broker_name, cluster_id}, one line per broker."""
    body = F.struct(F.col("broker_id").alias("id"), "host", "port")
    whole = F.struct(
        F.create_map(F.col("broker_id").cast("string"), body).alias("brokers"),
        F.lit(broker_name).alias("broker_name"),
        F.lit(cluster_id).alias("cluster_id"),
    )
    return brokers.select("broker_id", F.to_json(whole).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON lines, written by all tasks."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def write_document(lines: DataFrame, path: str) -> None:
    """The lines of `summary_document` or `topic_document` as text, sorted over all tasks: the files
    of a folder `snapshot_id=...`, one after the other by name, are the document."""
    order = lines.columns[:3]
    sorted_lines = lines.orderBy(*order).select("snapshot_id", F.col("line").alias("value"))
    sorted_lines.write.mode("overwrite").partitionBy("snapshot_id").text(path)
