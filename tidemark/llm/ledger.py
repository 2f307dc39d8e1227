"""Secret scans through an incremental ledger of blobs.

Every historical version of a file is addressed by its content (SHA-256 of the UTF-8 bytes), so
equal texts are one blob whatever their paths. A scan looks up which rules, each with a version,
a blob has met before, reads only texts of blobs with a rule it has not met, and applies only
those rules. What it finds is appended to the ledger; `located` joins findings back to all paths.

Ledger: Parquet folders `entries/run=<id>` in a folder all executors share, one row per blob and
scan: blob, rules (name@version, those applied), found (kind, version, start, end). A run is one
job; a folder without Parquet's mark of success is not read, so a scan that dies leaves
nothing behind but unread files and is repeated. Two scans at once may both read a blob; equal
findings count once.

Positions: a rule's matches and the gaps between them come from one pattern, so a match starts
at the sum of all earlier gaps and matches; the running sums are a window per blob and rule.
Start and end (exclusive) count code points. Leftmost, non-overlapping; a match whose `group` is
shorter than `least` is dropped after matching.

Null text is the empty text. Rows may repeat; a row without id or path is a path like any other.
Columns `blob` and `secrets` of the input are replaced in the result. Functions of Spark only.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.text import fixed


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int = 0  # the part whose length counts
    least: int = 0  # code points of that part

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base patterns, then public formats of keys that they miss. A pattern
#: of one class ends where the class ends, so its least length may stand inside the pattern.
BASE = (
    Rule(
        "assign",
        1,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_password", 1, r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~-]+:[^\s:@/]{3,}@"),
)
FOUND = "array<struct<kind:string,version:int,start:long,end:long>>"
#: Blobs still to be scanned that are broadcast after counting them (some 150 bytes each).
MOST_BROADCAST = 200_000


def address(text: Column) -> Column:
    """32 bytes that name a content."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def entries(spark: SparkSession, ledger: str) -> DataFrame | None:
    """All finished entries of a ledger; None if there are none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/entries/run=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    runs = [str(f.getPath().getParent()) for f in found or []]
    schema = f"blob binary, rules array<string>, found {FOUND}"
    return spark.read.schema(schema).parquet(*runs) if runs else None


def pending(blobs: DataFrame, known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, todo): distinct blobs with the rules that they have not met."""
    met = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("met"))
    todo = F.array_except(names(rules), F.coalesce("met", F.array().cast("array<string>")))
    return (
        blobs.select("blob").distinct().join(met, "blob", "left")
        .select("blob", todo.alias("todo")).filter(F.size("todo") > 0)
    )


def names(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.lit(r.name) for r in rules])


def _pieces(rule: Rule) -> Column:
    """Lengths of every match, of the gap before it and of its group; null where the rule is
    not to be applied or does not match."""
    text, length = F.col("text"), lambda part: F.transform(part, lambda x: F.length(x).cast("long"))
    matches = lambda group: length(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)))
    zipped = F.arrays_zip(
        length(F.split(text, rule.pattern, -1)).alias("gap"),
        matches(0).alias("size"),
        matches(rule.group).alias("part"),
    )
    hit = F.array_contains("todo", rule.name) & text.rlike(rule.pattern)
    return F.when(hit, zipped)


def scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Entries (blob, rules, found) of texts (blob, text, todo), one row per blob."""
    hits = F.array(
        *[
            F.struct(
                F.lit(r.kind).alias("kind"),
                F.lit(r.version).alias("version"),
                F.lit(r.least).alias("least"),
                _pieces(r).alias("pieces"),
            )
            for r in rules
        ]
    )
    hit = texts.select(
        "blob", "todo", F.explode_outer(F.filter(hits, lambda h: h["pieces"].isNotNull())).alias("h")
    )
    piece = hit.select(
        "blob", "todo", "h.kind", "h.version", "h.least", F.posexplode_outer("h.pieces").alias("at", "p")
    )
    upto = (
        Window.partitionBy("blob", "kind").orderBy("at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    end = F.sum(F.col("p.gap") + F.col("p.size")).over(upto)
    placed = piece.withColumn("end", end).withColumn("start", F.col("end") - F.col("p.size"))
    # The gap behind the last match has no match of its own.
    held = F.col("p.size").isNotNull() & (F.col("p.part") >= F.col("least"))
    found = F.when(held, F.struct("kind", "version", "start", "end"))
    return placed.groupBy("blob").agg(
        F.first("todo").alias("rules"), F.array_sort(F.collect_list(found)).cast(FOUND).alias("found")
    )


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Bring the ledger up to date with all texts of `versions`."""
    spark = versions.sparkSession
    rows = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one = lambda of: of.groupBy("blob").agg(F.first("text").alias("text"))
    known = entries(spark, ledger)
    if known is None:
        texts = one(rows).withColumn("todo", names(rules))
    else:
        due = fixed(pending(rows, known, rules))
        n = due.count()
        if not n:
            return
        if n <= MOST_BROADCAST:  # texts of known blobs stay where they are
            due = F.broadcast(due)
            rows = rows.join(due.select("blob"), "blob", "left_semi")
        texts = one(rows).join(due, "blob")
    scanned(texts, rules).write.parquet(f"{ledger}/entries/run={uuid.uuid4()}")


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, secrets): what the present versions of the rules found, for blobs with findings.
    secrets is sorted by start, then kind as listed, each finding once."""
    known = entries(spark, ledger)
    if known is None:
        return spark.createDataFrame([], "blob binary, secrets array<struct<start:long,place:int,end:long,kind:string>>")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    current = F.filter(
        "found", lambda f: F.array_contains(names(rules), F.concat(f["kind"], F.lit("@"), f["version"]))
    )
    ordered = F.transform(
        current,
        lambda f: F.struct(
            f["start"].alias("start"),
            F.array_position(kinds, f["kind"]).cast("int").alias("place"),
            f["end"].alias("end"),
            f["kind"].alias("kind"),
        ),
    )
    held = known.select("blob", ordered.alias("found")).filter(F.size("found") > 0)
    return held.groupBy("blob").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("secrets")
    )


def located(
    versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text"
) -> DataFrame:
    """Every row of `versions` with its blob and secrets (an empty list if it has none). A blob
    that very many paths share is hot on the left of the join only, where AQE splits it."""
    spark = versions.sparkSession
    rows = versions.withColumn("blob", address(F.col(text))).drop("secrets")
    found = findings(spark, ledger, rules)
    none = F.array().cast(found.schema["secrets"].dataType)
    return rows.join(found, "blob", "left").withColumn("secrets", F.coalesce("secrets", none))
