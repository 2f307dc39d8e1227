"""Consumer-lag analytics on Spark: snapshots of offsets in, DataFrames out."""

from tidemark.options import Options
from tidemark.sources.tables import LagTables

__all__ = ["LagTables", "Options"]
