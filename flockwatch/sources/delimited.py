"""Delimited text files."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNIFF = 65_536
INFER_ROWS = 100


def suggested(path: str) -> bool:
    """Whether this reader is the one to try for a file of that name."""
    return path.endswith(".csv")


@dataclass(frozen=True)
class Dialect:
    separator: str = ","
    quote: str = '"'
    header: bool = True

    def with_(self, **changes) -> "Dialect":
        return replace(self, **changes)


def _head(spark: SparkSession, path: str) -> str:
    """The first `SNIFF` characters of the file (of the first one, if the path names several)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(str(f.getPath()) for f in (fs.globStatus(at) or []))
    if not found:
        raise FileNotFoundError(path)
    at = jvm.org.apache.hadoop.fs.Path(found[0])
    if fs.getFileStatus(at).isDirectory():
        inner = sorted(str(f.getPath()) for f in fs.listStatus(at) if not f.getPath().getName().startswith(("_", ".")))
        at = jvm.org.apache.hadoop.fs.Path(inner[0])
    stream = fs.open(at)
    try:
        raw = bytes(stream.readNBytes(4 * SNIFF))  # no character takes more than four bytes
    finally:
        stream.close()
    return raw.decode("utf-8", "ignore")[:SNIFF]


def sniff(spark: SparkSession, path: str) -> Dialect:
    """Separator and quote from the head of the file, read where Spark can read it; a header is assumed."""
    found = csv.Sniffer().sniff(_head(spark, path))
    return Dialect(found.delimiter, found.quotechar or '"')


@dataclass(frozen=True)
class DelimitedFile:
    """One file under one dialect: its description, a preview, and the whole as a DataFrame or as Parquet."""

    spark: SparkSession
    path: str
    dialect: Dialect

    def describe(self) -> dict[str, str]:
        return {"separator": self.dialect.separator, "quote": self.dialect.quote, "header": str(self.dialect.header)}

    @cached_property
    def spans_lines(self) -> bool:
        """Whether some line has an odd number of quotes, as lines have that begin or end a field of several lines.

        Files without such lines are read in splits, others one task a file.
        """
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(self.dialect.quote), F.lit("")))
        return not self.spark.read.text(self.path).where(quotes % 2 == 1).isEmpty()

    def _reader(self, split: bool = False):
        d = self.dialect
        return self.spark.read.options(sep=d.separator, quote=d.quote, escape=d.quote, header=d.header, multiLine=not split, mode="PERMISSIVE", encoding="UTF-8")

    def schema(self) -> T.StructType:
        """Names, and types that hold for the first rows: whole numbers, numbers, true and false, else text."""
        head = self._reader().option("inferSchema", False).csv(self.path).limit(INFER_ROWS)
        rows, fields = head.collect(), []
        for i, name in enumerate(head.columns):
            values = [r[i] for r in rows if r[i] is not None]
            fields.append(T.StructField(name, _type_of(values)))
        return T.StructType(fields)

    def read(self) -> DataFrame:
        """All rows. Fields beyond the schema are dropped, missing ones and those that don't parse are null."""
        return self._reader(split=not self.spans_lines).schema(self.schema()).csv(self.path)

    def preview(self, n: int) -> DataFrame:
        return self._reader().schema(self.schema()).csv(self.path).limit(n)

    def to_parquet(self, path: str) -> None:
        self.read().write.mode("overwrite").parquet(path)


def _type_of(values: list[str]) -> T.DataType:
    for kind, ok in ((T.LongType(), _is_long), (T.DoubleType(), _is_double), (T.BooleanType(), lambda v: v.lower() in ("true", "false"))):
        if values and all(ok(v.strip()) for v in values):
            return kind
    return T.StringType()


def _is_long(v: str) -> bool:
    body = v[1:] if v[:1] in "+-" else v
    return body.isdigit() and body.isascii() and abs(int(v)) < 1 << 63


#: What the reader takes for a number with a fraction; others would turn null.
_double = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Inf(inity)?")


def _is_double(v: str) -> bool:
    return _double.fullmatch(v) is not None


def open_file(spark: SparkSession, path: str, dialect: Dialect | None = None) -> DelimitedFile:
    return DelimitedFile(spark, path, dialect or sniff(spark, path))


def with_one_timestamp(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """A file read with dates parsed, and the name of its only timestamp column; TypeError if there isn't exactly one."""
    df = spark.read.options(header=True, inferSchema=True).csv(path)
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    if len(found) != 1:
        raise TypeError(f"one timestamp column is needed, there are {len(found)}")
    return df, found[0]
