"""Fixed input schemas and the constant values the operators share.

Readers never infer a schema: the same StructTypes serve batch and stream.
"""

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _INT, _STR, _BOOL, _TS = (
    T.LongType(),
    T.IntegerType(),
    T.StringType(),
    T.BooleanType(),
    T.TimestampType(),
)

SCHEMAS: dict[str, T.StructType] = {
    "snapshots": _struct(snapshot_id=_LONG, captured_at=_TS),
    "groups": _struct(
        snapshot_id=_LONG,
        group_id=_STR,
        raw_state=_STR,
        member_count=_INT,
        describe_failed=_BOOL,
        is_simple=_BOOL,
    ),
    "group_offsets": _struct(
        snapshot_id=_LONG,
        captured_at=_TS,
        group_id=_STR,
        topic=_STR,
        partition=_INT,
        committed_offset=_LONG,
        error=_STR,
    ),
    "topic_offsets": _struct(
        snapshot_id=_LONG,
        captured_at=_TS,
        topic=_STR,
        partition=_INT,
        end_offset=_LONG,
        error=_STR,
    ),
    "topic_partitions": _struct(
        snapshot_id=_LONG,
        topic=_STR,
        topic_id=_STR,
        partition=_INT,
        leader=_INT,
        replicas=T.ArrayType(_INT),
        isr=T.ArrayType(_INT),
        topic_error=_STR,
        partition_error=_STR,
    ),
    "topic_configs": _struct(topic=_STR, key=_STR, value=_STR),
    "brokers": _struct(broker_id=_INT, host=_STR, port=_INT),
    "topic_log": _struct(topic=_STR, partition=_INT, offset=_LONG, timestamp=_TS),
    "commit_log": _struct(
        group_id=_STR, topic=_STR, partition=_INT, offset=_LONG, commit_ts=_TS
    ),
}

# Group states.
STABLE = "STABLE"
EMPTY = "EMPTY"
PREPARING_REBALANCE = "PREPARING_REBALANCE"
COMPLETING_REBALANCE = "COMPLETING_REBALANCE"
DEAD = "DEAD"
UNKNOWN = "UNKNOWN"
GROUP_STATES = (
    UNKNOWN,
    PREPARING_REBALANCE,
    COMPLETING_REBALANCE,
    STABLE,
    DEAD,
    EMPTY,
)

# Key columns used throughout.
PARTITION_KEY = ["snapshot_id", "topic", "partition"]
# The same for joins of large tables. A sort compares its first column alone as long as that differs;
# a poll and a topic are the same in very many rows, a partition is not.
JOIN_KEY = ["partition", "snapshot_id", "topic"]
STATS_KEY = ["snapshot_id", "group_id", "topic"]
