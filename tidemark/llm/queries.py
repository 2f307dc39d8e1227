"""Registered queries of this package: thin digests over its operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate,
    dialogue,
    ledger,
    lines,
    mixing,
    pii,
    quality,
    repetition,
    runs,
    shards,
    simhash,
    toxicity,
    urls,
)
from tidemark.llm.oracle import oracle_sql
from tidemark.llm.text import fixed, held_out
from tidemark.session import shared_dir

__all__ = ["oracle_sql", "queries"]
SHARDS = 24
#: Stands for the secret a deployment would read from its own store.
KEY = "an example key"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _judged(docs: DataFrame, score: str, cut: float) -> DataFrame:
    return docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= cut).cast("int").alias("predicted"),
    )


def op1_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, KEY)


def op2_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    docs, text = table(spark, folder, "documents"), F.col("text")
    rows = fixed(
        docs.select(
            "doc_id",
            shards.record_bytes(text).alias("bytes"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            shards.virtual_slot(F.col("doc_id"), text).alias("slot"),
        )
    )
    maps = f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}"
    slots = shards.current_map(spark, maps, shards.measured(rows), SHARDS)
    return shards.placed(rows, slots, ["doc_id", "text_crc32", "bytes"]).select(
        "doc_id",
        F.col("bytes").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot").alias("virtual_slot"),
    )


def op3_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = repetition.judged(docs).select("doc_id", "repetition.*", "repetition_kept")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("repetition_kept")).alias("kept"),
        "covered_words",
    )


def op4_simhash_vp_trees(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.clustered(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.sized(table(spark, folder, "documents"))
    return mixing.mixed(rows, mixing.targets(rows)).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def captures_and_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Captures with a day of fetch, and dated list entries, both derived from `pages`.

    A page is fetched on one of 360 days by its id. Of the hosts and sites of all pages, those
    whose md5 starts with a low digit are listed: added on a day given by the next digits,
    removed 90 days later if the digit is odd, and added again 90 days after that if it is 1.
    """
    pages = table(spark, folder, "pages").select("page_id", "url")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.withColumn("fetched_on", day((F.col("page_id") * 7919) % 360))
    site = urls.site_of(F.col("url"))
    names = pages.select(F.explode(F.array(site, F.substring_index(site, "/", 1))).alias("pattern"))
    names = names.filter("pattern is not null").distinct()
    digits = lambda a, n: F.conv(F.substring(F.md5("pattern"), a, n), 16, 10).cast("int")
    chosen = names.withColumn("digit", digits(1, 1)).filter("digit < 5")
    chosen = chosen.withColumn("day", digits(2, 3) % 180)
    event = lambda shift, added, when: F.when(
        when, F.struct((F.col("day") + shift).alias("n"), F.lit(added).alias("added"))
    )
    odd = F.col("digit") % 2 == 1
    events = F.array_compact(
        F.array(event(0, True, F.lit(True)), event(90, False, odd), event(180, True, F.col("digit") == 1))
    )
    kind = F.when(F.contains(F.col("pattern"), F.lit("/")), "places").otherwise("domains")
    entries = chosen.select(kind.alias("list"), "pattern", F.explode(events).alias("e"))
    return captures, entries.select("list", "pattern", day(F.col("e.n")).alias("on"), "e.added")


def op7_deletion_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = lines.per_document(lines.decided(docs))
    return found.withColumn("dropped", F.concat_ws(",", "dropped"))


def op8_dated_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    captures, entries = captures_and_lists(spark, folder)
    return urls.judged(captures, entries).select(
        "page_id",
        "url",
        F.date_format("fetched_on", "yyyy-MM-dd").alias("fetched_on"),
        F.size("matches").cast("long").alias("n_matches"),
        F.when(F.size("matches") > 0, F.col("matches")[0]["pattern"]).alias("first_pattern"),
        (F.size("matches") > 0).alias("blocked"),
    )


def op6_nonnegative_pu(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (table(spark, folder, t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    return _judged(toxicity.scored(docs.select("doc_id", "text"), model), "toxicity", 0.5)


def op9_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, folder, "benchmark"))


def op10_ftrl_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (table(spark, folder, t) for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    return _judged(quality.scored(docs.select("doc_id", "text"), model), "quality", 0.3)


def op11_blob_ledger(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    place = f"{shared_dir(spark)}/ledger-{uuid.uuid4()}"
    ledger.scan(docs, place)
    named = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    joined = lambda found: F.array_join(F.transform(found, named), ",")
    kinds = F.transform("secrets", lambda s: s["kind"])
    number = lambda kind: F.size(F.filter(kinds, lambda k: k == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in ledger.BASE]))
    return ledger.located(docs, place).select(
        "doc_id",
        *[number(r.kind).alias(f"n_{r.kind}") for r in ledger.BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) where the words of one document in ten repeat with period p from word
    a on; those texts are their words joined by one space."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    split = F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")
    planted = h % 10 == 0
    rows = docs.select("doc_id", "text", h.alias("h"))
    rows = rows.withColumn("words", F.when(planted, F.filter(split, lambda w: w != "")))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr(
        "array_join(slice(concat(slice(words, 1, a), flatten(array_repeat("
        "slice(words, a + 1, p), cast((n - a) div p + 1 as int)))), 1, n), ' ')"
    )
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op12_kruskal_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_planted_runs(table(spark, folder, "documents").select("doc_id", "text"))
    found = runs.detected(docs).select("doc_id", "periodic.*")
    first = lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"], r["period"])
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    digest = F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256)
    longest = F.array_max(F.transform("runs", first))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        F.col("longest.length").alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        digest.alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) of which some are lost, emptied, cut, repeated or given
    another role, by a hash of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(
        F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")
    ).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return (
        rows.filter("fate <> 0")
        .withColumn("text", text)
        .withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
        .select("conv_id", "turn", "role", "text", copies)
        .drop("col")
    )


def op13_astar_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    every = rows.select(F.col("conv_id").alias("original")).distinct()
    found = dialogue.reports(damaged(rows))
    joined = every.join(found, F.col("original").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(
        F.col("original").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in dialogue.COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
