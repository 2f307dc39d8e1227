"""The registered queries: every operator over whole tables derived from the test data."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import health, skew, text
from tidemark.operators import clean, lag, rates
from tidemark.operators.clean import Prepared, prepare
from tidemark.operators.ordering import with_position
from tidemark.operators.skew import rate_skew
from tidemark.options import Options
from tidemark.plans import documents, reports
from tidemark.schemas import PARTITION_KEY, STATS_KEY
from tidemark.session import fixed, shared_dir
from tidemark.sources import tables as scans
from tidemark.sources.logs import committed_offsets_from_log
from tidemark.sources.tables import LagTables
from tidemark.streaming.closed import ClosedPolls, Control, Folders, closed_polls
from tidemark.streaming.logs import OffsetsAtPolls, committed_points, end_offset_points
from tidemark.streaming.loop import SnapshotLoop
from tidemark.workload.views import (
    OFFSETS_AND_GROUPS,
    WIDE,
    Views,
    bucketed_tables,
    stored_folder,
    stored_stream,
    stored_tables,
)

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}

HIDE_EMPTY = Options()
ALL_GROUPS = Options(show_empty=True)
PARTIAL = Options(include="partial", show_empty=True)
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _on_tables(*names: str):
    """Over the named ones of the derived tables; only these are derived."""

    def register(query: Callable[[LagTables], DataFrame]):
        _registry[query.__name__] = lambda spark, sf_dir: query(stored_tables(spark, sf_dir, only=names))
        return query

    return register


def _on_prepared(options: Options = HIDE_EMPTY):
    def register(query: Callable[[Prepared], DataFrame]):
        _registry[query.__name__] = lambda spark, sf_dir: query(
            prepare(stored_tables(spark, sf_dir, only=OFFSETS_AND_GROUPS), options)
        )
        return query

    return register


def _on_wide(query: Callable[[Prepared], DataFrame]):
    """Over the form of the tables in which one topic has 5,000 partitions."""
    _registry[query.__name__] = lambda spark, sf_dir: query(
        prepare(stored_tables(spark, sf_dir, WIDE, OFFSETS_AND_GROUPS), HIDE_EMPTY)
    )
    return query


def _on_views(query: Callable[[Views], DataFrame]):
    _registry[query.__name__] = lambda spark, sf_dir: query(Views(spark, sf_dir))
    return query


# sources


@_on_tables("groups")
def s1_groups(t):
    return scans.group_scan(t.groups).select("snapshot_id", "group_id")


@_on_tables("groups")
def s2_group_state(t):
    return clean.with_state(t.groups).select("snapshot_id", "group_id", "state")


@_on_tables("group_offsets")
def s3_committed_scan(t):
    return scans.committed_scan(t.group_offsets).select(*STATS_KEY, "partition", "committed_offset")


@_on_prepared()
def s4_end_offsets_requested(p):
    return p.end_offsets.join(p.requested, PARTITION_KEY, "left_semi")


@_on_tables("topic_partitions")
def s5_topics(t):
    return reports.topic_info(t.topic_partitions).select("snapshot_id", "topic", "partitions")


@_on_tables("topic_partitions")
def s6_topic_metadata(t):
    return reports.topic_metadata(t.topic_partitions, "click").drop("configs")


@_on_tables("topic_offsets", "topic_configs")
def s7_topic_configs(t):
    topics = scans.end_offset_scan(t.topic_offsets).select("topic").distinct()
    maps = scans.config_maps(t.topic_configs)
    return topics.join(maps, "topic").select("topic", F.explode("configs"))


@_on_tables("brokers", "topic_partitions")
def s8_brokers(t):
    led = reports.topic_info_parts(t.topic_partitions).groupBy("leader").agg(
        F.count("*").alias("led")
    )
    return t.brokers.join(led, F.col("broker_id") == F.col("leader")).drop("leader")


@_on_prepared(ALL_GROUPS)
def s9_topic_usage(p):
    return clean.topic_usage(p)


@_on_views
def s10_end_offsets(v):
    return v.end_offsets().select(*PARTITION_KEY, "end_offset")


@_on_views
def s11_committed_offsets(v):
    return committed_offsets_from_log(v.commits(), v.index).select(
        *STATS_KEY, "partition", "committed_offset"
    )


@_on_views
def s10_stable_offsets(v):
    ends = v.end_offsets().select(*PARTITION_KEY, F.col("end_offset").alias("last_offset"))
    return v.stable_offsets().join(ends, PARTITION_KEY).select(
        *PARTITION_KEY, F.col("end_offset").alias("stable_offset"), "last_offset"
    )


@_on_views
def s10_uneven_polls(v):
    return v.end_offsets(v.uneven_index()).select(*PARTITION_KEY, "end_offset")


@_on_views
def s11_uneven_polls(v):
    return committed_offsets_from_log(v.commits(), v.uneven_index()).select(
        *STATS_KEY, "partition", "committed_offset"
    )


# filters and joins


@_on_prepared(Options(include="-s", exclude="nt$", show_empty=True))
def f1_f2_group_filter(p):
    return clean.topic_groups(p)


@_on_tables("groups")
def f5_live_groups(t):
    return clean.live_groups(t.groups, HIDE_EMPTY).select("snapshot_id", "group_id", "state")


@_on_prepared()
def f7_f8_report_filter(p):
    return reports.filter_report(reports.report(p), "st", "^c|w$")


@_on_prepared(Options(only_issues=True))
def f9_only_issues(p):
    return reports.report(p)


@_on_prepared()
def f10_search(p):
    return reports.search_report(reports.report(p), "P C", "lag").select(
        *STATS_KEY, "lag", "match_index"
    )


@_on_tables("topic_offsets", "group_offsets")
def f12_error_rows(t):
    return clean.error_rows(t).groupBy("snapshot_id", "kind").agg(F.count("*").alias("n"))


@_on_tables("topic_offsets", "group_offsets")
def f12_error_rows_listed(t):
    return clean.error_rows(t)


@_on_prepared()
def j1_partition_lag(p):
    return lag.partition_lag(p)


def j1_bucketed_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over offset tables in buckets: no shuffle."""
    return lag.partition_lag(prepare(bucketed_tables(spark, sf_dir)))


_registry["j1_bucketed_lag"] = j1_bucketed_lag


# lag statistics


@_on_prepared(ALL_GROUPS)
def l1_lag_stats(p):
    return lag.lag_stats(p)


@_on_prepared()
def a5_median(p):
    return lag.lag_stats(p).select(*STATS_KEY, "lag_median")


@_on_wide
def l1_lag_stats_wide(p):
    return lag.lag_stats(p)


@_on_prepared()
def a7_a8_skew(p):
    return lag.lag_stats(p, median=False).select(*STATS_KEY, "par", "cv")


@_on_prepared()
def a10_rate_skew(p):
    return rate_skew(p)


@_on_prepared()
def a11_totals(p):
    return reports.totals(reports.report(p))


@_on_prepared()
def a13_follow(p):
    return reports.follow(reports.report(p)).select(*STATS_KEY, "lag")


# rates


@_on_prepared(Options(pairing="disjoint"))
def k0b_disjoint_pairs(p):
    return rates.rates(p).select(
        "snapshot_id",
        "prev_snapshot_id",
        "group_id",
        "topic",
        "events_consumed",
        "consumption_rate",
        "arrival_rate",
        "remaining_sec",
    )


@_on_prepared(ALL_GROUPS)
def k1_consumption(p):
    return rates.group_rates(p, with_lag=False)


@_on_prepared()
def k3_partition_rates(p):
    return rates.partition_rates(p)


@_on_prepared()
def k4_arrival(p):
    return rates.arrival_rates(p)


@_on_prepared(PARTIAL)
def k4_arrival_filtered(p):
    return rates.arrival_rates(p)


@_on_prepared()
def k5_eta_net(p):
    return rates.rates(p).select(*STATS_KEY, "remaining_sec", "remaining_hms")


@_on_prepared(Options(eta_method="simple"))
def k6_eta_simple(p):
    return rates.rates(p).select(*STATS_KEY, "remaining_sec", "remaining_hms")


@_on_prepared(ALL_GROUPS)
def k9_rates(p):
    return rates.rates(p)


# text


@_on_prepared()
def c1_hms(p):
    return lag.partition_lag(p).select(
        *STATS_KEY, "partition", text.hms(F.col("lag") * 100).alias("hms")
    )


@_on_prepared()
def c2_si_numbers(p):
    lags, ends = F.col("lag"), F.col("end_offset")
    return lag.partition_lag(p).select(
        *STATS_KEY,
        "partition",
        text.si_integer(lags * lags * 37 - 500).alias("shown_lag"),
        text.si_rate(ends * ends / 8.0).alias("shown_rate"),
    )


@_on_prepared()
def c5_ratio_text(p):
    return lag.lag_stats(p, median=False).select(
        *STATS_KEY, *[text.ratio_text(F.col(c)).alias(c) for c in ("par", "cv")]
    )


@_on_tables("topic_offsets", "topic_configs")
def c6_config_text(t):
    topics = scans.end_offset_scan(t.topic_offsets).select("snapshot_id", "topic").distinct()
    configs = scans.config_scan(t.topic_configs)
    return topics.join(configs, "topic").select(
        "snapshot_id",
        "topic",
        "key",
        text.config_text(F.col("key"), F.col("value")).alias("shown"),
    )


@_on_prepared(ALL_GROUPS)
def c8_anonymise(p):
    return clean.topic_groups(p).select(
        *STATS_KEY,
        text.anonymous("group", F.col("group_id")).alias("shown_group"),
        text.anonymous("topic", F.col("topic")).alias("shown_topic"),
    )


@_on_prepared()
def c9_c11_viewport(p):
    stats = lag.lag_stats(p, median=False)
    rows = stats.join(clean.topic_usage(p), ["snapshot_id", "topic"])
    covered, total = F.col("n_parts"), F.col("n_partitions")
    return rows.select(
        *STATS_KEY,
        text.of_total(covered, total).alias("covered"),
        text.percent(covered, total).alias("percent"),
    )


# health


def _verdicts(df: DataFrame, *names: str) -> DataFrame:
    """The two fields of each verdict as columns of their own."""
    plain = [c for c in df.columns if c not in names]
    split = [F.col(f"{n}.{f}").alias(f"{n}_{f}") for n in names for f in ("status", "reason")]
    return df.select(*plain, *split)


@_on_prepared()
def h1_eta_status(p):
    eta = health.eta_status(F.col("remaining_sec")).alias("eta")
    return _verdicts(rates.rates(p).select(*STATS_KEY, eta), "eta")


_RATE_INPUTS = (F.col, ("lag_sum", "consumption_rate", "arrival_rate"))


@_on_prepared()
def h2_rate_status(p):
    rate = health.rate_status(*map(*_RATE_INPUTS)).alias("rate")
    return _verdicts(rates.rates(p).select(*STATS_KEY, rate), "rate")


@_on_prepared()
def h3_issue_flag(p):
    eta = F.col("remaining_sec")
    return rates.rates(p).select(
        *STATS_KEY,
        health.has_issues(eta, F.col("lag_sum"), F.col("arrival_rate")).alias("has_issues"),
        health.eta_level(eta).alias("eta_level"),
    )


@_on_prepared()
def h4_rate_level(p):
    level = health.rate_level(*map(*_RATE_INPUTS))
    return rates.rates(p).select(*STATS_KEY, level.alias("rate_level"))


@_on_prepared()
def h6_cv_level(p):
    level = health.cv_level(F.col("cv"))
    return lag.lag_stats(p, median=False).select(*STATS_KEY, level.alias("cv_level"))


@_on_prepared()
def h7_h8_bands(p):
    cv, par = F.col("cv"), F.col("par")
    return lag.lag_stats(p, median=False).select(
        *STATS_KEY,
        skew.cv_band(cv).alias("cv_band"),
        skew.par_band(par).alias("par_band"),
        skew.skew_diagnosis(cv, par).alias("diagnosis"),
    )


@_on_prepared()
def h10_rank_bucket(p):
    return reports.partition_detail(p).select(*STATS_KEY, "partition", "lag_rank", "rate_rank")


@_on_tables("groups")
def h11_state_level(t):
    level = health.state_level(F.col("state")).alias("state_level")
    return clean.with_state(t.groups).select("snapshot_id", "group_id", level)


# reports


@_on_prepared()
def p1_report_sorted(p):
    return reports.number_report(reports.report(p), "lag").select(*STATS_KEY, "lag", "position")


@_on_prepared()
def p1_sort_keys(p):
    rows = reports.report(p)
    rows = fixed(rows)  # numbered three times below
    result = rows.select(*STATS_KEY)
    for key in ("eta", "topic", "newrate"):
        numbered = reports.number_report(rows, key)
        result = result.join(
            numbered.select(*STATS_KEY, F.col("position").alias(f"by_{key}")), STATS_KEY
        )
    return result


@_on_prepared()
def p3_page(p):
    return reports.page(reports.report(p), 20, 10, "lag").select(
        *STATS_KEY, "lag", "first_row", "last_row", "n_rows", "percent"
    )


@_on_prepared()
def p3_deep_page(p):
    return reports.page(reports.report(p), 600, 40, "lag").select(
        *STATS_KEY, "lag", "first_row", "last_row", "n_rows", "percent"
    )


@_on_tables("groups")
def p5_sorted_ids(t):
    groups = clean.live_groups(t.groups, ALL_GROUPS).select("snapshot_id", "group_id")
    return with_position(groups, [F.col("group_id").asc()], ["snapshot_id"])


@_on_prepared(Options(max_pairs=5))
def p6_poll_budget(p):
    return rates.rates(p).select(*STATS_KEY, "events_consumed", "remaining_sec")


def _sliced(options: Options):
    """Prepared tables of the snapshots 5 to 11 only."""

    def register(query: Callable[[Prepared], DataFrame]):
        _registry[query.__name__] = lambda spark, sf_dir: query(
            prepare(stored_tables(spark, sf_dir, only=OFFSETS_AND_GROUPS).between(5, 11), options)
        )
        return query

    return register


def _pairs(p):
    return rates.rates(p).select(
        "snapshot_id", "prev_snapshot_id", "group_id", "topic", "events_consumed", "remaining_sec"
    )


@_sliced(Options(pairing="disjoint"))
def k0b_slice(p):
    return _pairs(p)


@_sliced(Options(max_pairs=2))
def p6_slice(p):
    return _pairs(p)


@_sliced(Options(max_pairs=2, pairing="disjoint"))
def p6_slice_detail(p):
    return rates.partition_history(p).select(*STATS_KEY, "partition", "lag", "rate")


@_on_tables(*OFFSETS_AND_GROUPS, "topic_partitions")
def d1_last_pair(t):
    return reports.partition_detail(prepare(t.latest_pair()), t.topic_partitions)


@_on_tables(*OFFSETS_AND_GROUPS, "topic_partitions", "topic_configs")
def d1_header(t):
    return reports.detail_header(prepare(t), t.topic_partitions, t.topic_configs).select(
        *STATS_KEY,
        "partitions",
        "lag_sum",
        "lag_min",
        "lag_max",
        "par",
        "cv",
        "consumption_rate",
        "arrival_rate",
        "remaining_sec",
        "remaining_hms",
        "replication_factor",
        F.coalesce(F.size("configs"), F.lit(0)).alias("n_configs"),
    )


@_on_tables(*OFFSETS_AND_GROUPS, "topic_partitions")
def o8_shown_detail(t):
    options = Options(anonymize=True)
    detail = reports.partition_detail(prepare(t, options), t.topic_partitions)
    return reports.shown_detail(detail, options)


@_on_tables("brokers", "topic_partitions")
def o3_brokers(t):
    shape = "struct<brokers:map<string,struct<id:int,host:string,port:int>>,broker_name:string,cluster_id:string>"
    read = documents.broker_documents(t.brokers, "host-1", "demo").select(
        F.from_json("document", shape).alias("d")
    )
    led = reports.topic_info_parts(t.topic_partitions).groupBy("leader").agg(F.count("*").alias("led"))
    rows = read.select(F.explode("d.brokers"), "d.broker_name", "d.cluster_id")
    return rows.select("key", "value.*", "broker_name", "cluster_id").join(
        led, F.col("id") == F.col("leader")
    ).drop("leader")


def _numbered_by(rows, keys, number):
    rows = fixed(rows)  # numbered several times
    result = None
    for key in keys:
        own = number(rows, key).withColumnRenamed("position", f"by_{key}")
        kept = [c for c in (*STATS_KEY, "partition") if c in rows.columns]
        own = own.select(*kept, f"by_{key}")
        result = own if result is None else result.join(own, kept)
    return result


@_on_prepared()
def p1_more_sort_keys(p):
    keys = ("group", "partitions", "rate", "par", "cv")
    return _numbered_by(reports.report(p), keys, reports.number_report)


@_on_prepared()
def p1_reversed(p):
    reverse = lambda rows, key: reports.number_report(rows, key, key == "topic")
    return _numbered_by(reports.report(p), ("lag", "topic"), reverse)


@_on_prepared()
def p4_detail_sort_keys(p):
    keys = ("partition", "groupoffset", "topicoffset", "rate")
    rows = rates.partition_history(p)
    if not p.is_narrow(reports.TOPIC_ROWS):
        return _numbered_by(rows, keys, reports.number_detail)
    for key in keys:
        rows = reports.number_detail(rows, key, whole=True).withColumnRenamed("position", f"by_{key}")
    return rows.select(*STATS_KEY, "partition", *[f"by_{key}" for key in keys])


@_on_prepared()
def p4_detail_sorted(p):
    whole = p.is_narrow(reports.TOPIC_ROWS)
    return reports.number_detail(rates.partition_history(p), "lag", whole).select(
        *STATS_KEY, "partition", "lag", "position"
    )


@_on_prepared()
def r1_report(p):
    return reports.report(p)


@_on_prepared(Options(anonymize=True))
def r1_report_anonymous(p):
    return reports.report(p)


@_on_tables(*OFFSETS_AND_GROUPS)
def r1_report_last_pair(t):
    return reports.report(prepare(t.latest_pair()))


@_on_prepared()
def r2_status(p):
    return _verdicts(reports.status(p), "eta", "rate", "lag")


def _map_text(column: str):
    pairs = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.coalesce(F.array_join(pairs, ";"), F.lit("")).alias(column)


@_on_tables(*OFFSETS_AND_GROUPS, "topic_configs")
def r3_summary(t):
    rows = reports.summary(prepare(t), t.topic_configs)
    return rows.select(*[c for c in rows.columns if c != "configs"], _map_text("configs"))


@_on_tables(*OFFSETS_AND_GROUPS, "topic_configs")
def o1_summary_json(t):
    """The lines of the document read back, so that values and not spellings are compared."""
    lines = documents.summary_document(prepare(t), t.topic_configs)
    body = (
        "struct<partitions:bigint,lag_max:bigint,lag_min:bigint,par:double,cv:double,"
        "configs:map<string,string>>"
    )
    read = lambda c, end, shape: F.from_json(F.concat(F.lit("{"), F.col(c), F.lit(end)), f"map<string,{shape}>")
    keys = ["snapshot_id", "group_id"]
    groups = lines.filter("head <> ''").select("snapshot_id", F.explode(read("head", "}}}", "struct<state:string>")))
    groups = groups.select("snapshot_id", F.col("key").alias("group_id"), "value.state")
    topics = lines.select(*keys, F.explode_outer(read("entry", "}", body)).alias("topic", "v"))
    joined = groups.join(topics, keys).select(*keys, "state", "topic", "v.*")
    return joined.withColumn("configs", _map_text("configs"))


@_on_tables(*OFFSETS_AND_GROUPS, "topic_configs")
def o1_document_places(t):
    """What the lines open and close: a document of any size is put together without being seen."""
    lines = documents.summary_document(prepare(t), t.topic_configs)
    return lines.select(*STATS_KEY, "opening", "head", "closing")


@_on_prepared()
def o2_status_json(p):
    verdict = "struct<status:string,reason:string>"
    shape = f"map<string,struct<eta:{verdict},rate:{verdict},lag:{verdict}>>"
    read = documents.status_documents(p).select(
        *STATS_KEY, F.explode(F.from_json("document", shape)).alias("status_key", "v")
    )
    return _verdicts(read.select(*STATS_KEY, "status_key", "v.*"), "eta", "rate", "lag")


@_on_tables("topic_partitions")
def o3_topic_json(t):
    shape = "struct<id:int,leader:int,replicas:array<int>,nisrs:array<int>>"
    head = "map<string,struct<name:string,partitions:bigint,partinfo:array<int>>>"
    lines = documents.topic_document(t.topic_partitions, parts=True)
    heads = lines.filter("head <> ''").select(
        "snapshot_id", F.explode(F.from_json(F.concat(F.lit("{"), "head", F.lit("]}}")), head))
    )
    names = heads.select("snapshot_id", F.col("key").alias("topic"), "value.name")
    parts = lines.filter("entry <> ''").select("snapshot_id", "topic", F.from_json("entry", shape).alias("p"))
    return names.join(parts, ["snapshot_id", "topic"]).select(
        "snapshot_id",
        F.col("name").alias("topic"),
        F.col("p.id").alias("partition"),
        "p.leader",
        *_joined(("p.replicas", "replicas"), ("p.nisrs", "isr")),
        F.size("p.nisrs").alias("nisrs"),
    )


@_on_prepared()
def o4_lag_table(p):
    return reports.lag_table(p)


@_on_prepared()
def o5_rate_table(p):
    return reports.rate_table(p)


@_on_prepared(ALL_GROUPS)
def o6_summary_table(p):
    return reports.summary_table(p)


@_on_prepared()
def o7_shown_report(p):
    return reports.shown_report(reports.report(p))


@_on_tables(*OFFSETS_AND_GROUPS, "topic_partitions")
def d1_partition_detail(t):
    return reports.partition_detail(prepare(t), t.topic_partitions)


@_on_wide
def d1_detail_wide(p):
    return reports.partition_detail(p).drop("replicas", "isr", "leader")


@_on_tables("topic_partitions")
def t1_topic_info(t):
    return reports.topic_info(t.topic_partitions)


def _joined(*columns):
    return [F.array_join(F.col(c).cast("array<string>"), ",").alias(name) for c, name in columns]


@_on_tables("topic_partitions")
def t2_topic_info_parts(t):
    return reports.topic_info_parts(t.topic_partitions).select(
        *PARTITION_KEY, "leader", *_joined(("replicas", "replicas"), ("isr", "isr")), "nisrs"
    )


# results of the first-generation tool

LEGACY = Options(legacy=True)


@_on_prepared(LEGACY)
def l1_lag_stats_legacy(p):
    return lag.lag_stats(p).select(
        *STATS_KEY, "n_parts", "lag_min", "lag_max", "lag_sum", "lag_median"
    )


@_on_prepared(LEGACY)
def k1_consumption_legacy(p):
    return rates.group_rates(p).select(*STATS_KEY, "events_consumed", "lag_sum")


# streams, run to their end: one file per poll, several micro-batches, a closing row at the end

DAY = 86400


def _fresh(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4()}"


def _cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def _closed_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = [stored_stream(spark, sf_dir, n) for n in ("group_offsets", "topic_offsets")]
    return closed_polls(*streams, DAY, "0 seconds")


def _run(sink: Folders, rows: DataFrame) -> DataFrame:
    sink.run(rows, _cores(rows.sparkSession)).awaitTermination()
    return sink.results(rows.sparkSession)


def x1_streaming_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = stored_tables(spark, sf_dir, only=("groups",)).groups
    sink = ClosedPolls(lambda t, o: lag.lag_stats(prepare(t, o)), _fresh(spark), groups=groups)
    return _run(sink, _closed_polls(spark, sf_dir)).drop("lag_mean")


def x2_streaming_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = stored_tables(spark, sf_dir, only=("groups",)).groups
    sink = ClosedPolls(lambda t, o: rates.rates(prepare(t, o)), _fresh(spark), pairs=True, groups=groups)
    return _run(sink, _closed_polls(spark, sf_dir)).select(
        "snapshot_id", "prev_snapshot_id", "group_id", "topic", "time_delta", "events_consumed",
        "consumption_rate", "arrival_rate", "lag_sum", "remaining_sec", "remaining_hms",
    )


def x3_poll_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch report of every pair, fed by a stream through foreachBatch."""
    loop = SnapshotLoop(lambda t: reports.report(prepare(t)), _fresh(spark))
    rows = stored_stream(spark, sf_dir, "snapshot_rows").filter("snapshot_id is not null")
    query = loop.run(rows)
    query.awaitTermination()
    loop.finish(spark, query.lastProgress["batchId"])
    return loop.results(spark)


def x4_end_offsets_from_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = end_offset_points(stored_stream(spark, sf_dir, "topic_log"), DAY, "0 seconds")
    ends = _run(OffsetsAtPolls(_fresh(spark)), points)
    return ends.select(*PARTITION_KEY, "end_offset")


def x5_committed_from_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = committed_points(stored_stream(spark, sf_dir, "commit_log"), DAY, "0 seconds")
    rows = _run(OffsetsAtPolls(_fresh(spark), committed=True), points)
    return rows.select(*STATS_KEY, "partition", "committed_offset")


def x6_changed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a stream whose options change on the way: from the 10th poll on without the groups
    g-s..., with simple ETAs; from the 20th on as at first. It stops after 25 polls."""
    control = Control(f"{_fresh(spark)}/control")
    control.change(spark, EPOCH + timedelta(days=10), Options(exclude="^g-s", eta_method="simple"))
    control.change(spark, EPOCH + timedelta(days=20), Options())
    sink = ClosedPolls(
        lambda t, o: rates.rates(prepare(t, o)), _fresh(spark), pairs=True, polls=25, control=control,
        groups=stored_tables(spark, sf_dir, only=("groups",)).groups,
    )
    query = sink.run(_closed_polls(spark, sf_dir), _cores(spark), processingTime="0 seconds")
    sink.until_done(query)
    return sink.results(spark).select(
        "snapshot_id", "prev_snapshot_id", "group_id", "topic", "time_delta", "events_consumed",
        "consumption_rate", "arrival_rate", "lag_sum", "remaining_sec",
    )


for _query in (
    x1_streaming_lag,
    x2_streaming_rates,
    x3_poll_loop,
    x4_end_offsets_from_stream,
    x5_committed_from_stream,
    x6_changed_filter,
):
    _registry[_query.__name__] = _query


def queries() -> dict[str, Query]:
    return dict(_registry)
