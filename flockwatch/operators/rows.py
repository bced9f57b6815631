"""Row numbers and projections that other operators start from."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` with each row's place in file order, from 1.

    Rows read from Parquet files are ordered by file name and place in the file, however Spark
    packs files into tasks; the files' row counts (one number each) are summed first. Other
    rows are ordered by partition and place there. No row moves.
    """
    part, mark = "_row_part", "_row_mark"
    try:
        marked = df.select("*", F.col("_metadata.file_path").alias(part), F.col("_metadata.row_index").alias(mark))
        marked.schema
    except AnalysisException:  # not read from Parquet files
        id_ = F.monotonically_increasing_id()
        marked = df.select("*", F.shiftrightunsigned(id_, 33).alias(part), id_.bitwiseAND(F.lit((1 << 33) - 1)).alias(mark))
    sizes = marked.groupBy(part).agg(F.count(F.lit(1)).alias("_row_count"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a file or partition
    base = sizes.select(part, F.coalesce(F.sum("_row_count").over(earlier), F.lit(0)).alias("_row_base"))
    place = F.col("_row_base") + F.col(mark) + 1
    return marked.join(F.broadcast(base), part).withColumn(name, place.cast("long")).drop(mark, part, "_row_base")


def preprocess(df: DataFrame, mapping: dict[str, str], convert: dict[str, Column] | None = None) -> DataFrame:
    """Only the mapped columns, under the analyzer's names, each converted by its own semantic."""
    convert = convert or {}
    return df.select(*[convert.get(user, F.col(f"`{user}`")).alias(name) for name, user in mapping.items()])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under their names for readers, those without one under their own."""
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def not_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose `columns` are neither null nor empty."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return df
