"""The column checks over streams: missing cells and formats by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqscan.functions import patterns as P
from dqscan.functions import text as X


def missing_by_window(stream: DataFrame, time: str, columns: list[str], width: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, field, null_count, blank_count, total_rows) of each window; rows later than `late` are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("raw")) for c in columns]))
    rows = stream.withWatermark(time, late).select(F.col(time).alias("t"), cells.alias("x"))
    window = F.window("t", width, slide) if slide else F.window("t", width)
    out = rows.groupBy(window.alias("w"), F.col("x.field").alias("field")).agg(
        F.sum(F.col("x.raw").isNull().cast("long")).alias("null_count"), F.sum(F.coalesce(X.strip(F.col("x.raw")) == "", F.lit(False)).cast("long")).alias("blank_count"), F.count("*").alias("total_rows")
    )
    return out.select(F.col("w.start").alias("start"), "field", "null_count", "blank_count", "total_rows")


def formats_by_window(stream: DataFrame, time: str, column: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, label, n): how many cells have which format in each window."""
    v = X.clean(F.col(column))
    rows = stream.withWatermark(time, late).select(F.col(time).alias("t"), P.format_label(v, kind).alias("label")).where(v.isNotNull())
    return rows.groupBy(F.window("t", width).alias("w"), "label").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "label", "n")
