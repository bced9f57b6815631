"""What can be imported: readers that know a format, and the choice among them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from . import delimited


class Opened(Protocol):
    """A source under one configuration."""

    def describe(self) -> dict[str, str]: ...

    def preview(self, n: int) -> DataFrame: ...

    def read(self) -> DataFrame: ...

    def to_parquet(self, path: str) -> None: ...


class Importer(Protocol):
    """A format: whether a path looks like it, its first configuration (None where that can't be told), and others."""

    name: str

    def suggested(self, path: str) -> bool: ...

    def open(self, spark: SparkSession, path: str) -> Opened | None: ...

    def configured(self, spark: SparkSession, path: str, **changes) -> Opened: ...


class Delimited:
    """Delimited text files."""

    name = "CSV"

    def suggested(self, path: str) -> bool:
        return delimited.suggested(path)

    def open(self, spark: SparkSession, path: str) -> Opened | None:
        try:
            return delimited.open_file(spark, path)
        except delimited.csv.Error:  # no dialect can be made out
            return None

    def configured(self, spark: SparkSession, path: str, **changes) -> Opened:
        """A dialect given by hand: separator, quote, header."""
        return delimited.open_file(spark, path, delimited.Dialect(**changes))


IMPORTERS: tuple[Importer, ...] = (Delimited(),)


def importer_for(path: str, importers: tuple[Importer, ...] = IMPORTERS) -> Importer | None:
    """The first importer that takes the path for its own."""
    return next((i for i in importers if i.suggested(path)), None)
