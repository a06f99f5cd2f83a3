"""Report and prediction sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

# Columns that name a run; sinks use them as partition folders.
RUN_COLUMNS = ["task", "dataset", "filters", "model", "run"]


def filter_tag(num_sent: str = "all", num_causal: str = "all", plicit: str = "all") -> str:
    """Active filters joined by ``_``; ``all`` when there are none."""
    return "_".join(v for v in (num_sent, num_causal, plicit) if v != "all") or "all"


def _partitions(df: DataFrame) -> list[str]:
    return [c for c in RUN_COLUMNS if c in df.columns]


def _writer(df: DataFrame, mode: str):
    """Overwriting replaces the folders of the runs that are written and no others."""
    return df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*_partitions(df))


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with keys in sorted order, one folder per run; a rerun replaces its own."""
    _writer(df.select(*sorted(df.columns)), mode).json(path)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, one folder per run; nested values are written as JSON."""
    nested = {
        f.name: F.to_json(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, (ArrayType, MapType, StructType))
    }
    flat = df.withColumns(nested) if nested else df
    _writer(flat, mode).option("header", True).option("escape", '"').csv(path)
