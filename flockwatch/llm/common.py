"""What the training-data operators share: reading, shared scratch tables, Arrow helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..arrow import BATCH_BYTES, BATCH_ROWS, ship, small_batches
from ..scratch import cut, scratch_path, shared_dir

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "cut", "scratch_path", "shared_dir", "ship", "small_batches"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tidy() -> None:
    """Give back the memory of a task; its worker process goes on to serve others."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def arrow_batch(schema: str, rows: list[tuple], *first):
    """A record batch of rows of plain types; `first` are columns that are there already."""
    import pyarrow as pa

    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    own = fields[len(first) :]
    values = list(zip(*rows, strict=True)) if rows else [()] * len(own)
    columns = [*first, *(pa.array(v, type=types[kind]) for v, (_, kind) in zip(values, own, strict=True))]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def join_by_size(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, share: int = 1000) -> DataFrame:
    """`rows` left-joined with `facts`, one for each key, of which `size` says how many rows it has.

    Facts with more than one in `share` of all those rows are at most `share` in number, so they are
    broadcast; no key with more rows goes through the shuffle.
    """
    facts = cut(facts)
    least = max(1, (facts.agg(F.sum(size)).first()[0] or 0) // share)
    large, small = facts.where(F.col(size) > least).drop(size), facts.where(F.col(size) <= least).drop(size)
    hot = rows.join(F.broadcast(large), keys)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(small, keys, "left")
    return hot.unionByName(rest)


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(column: str = "text") -> Column:
    """The UTF-8 bytes of a text, null as none."""
    return text_of(column).cast("binary")


def map_texts(docs: DataFrame, keep: list[str], fields: str, make) -> DataFrame:
    """Run a per-text function over Arrow batches.

    `make()` is called once a task and returns a function from a list of UTF-8 byte strings
    (null as empty) to one list or Arrow array for each of `fields`; the columns `keep` pass through.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    inner = docs.select(*[F.col(f"`{c}`") for c in keep], utf8().alias("_utf8"))
    added = StructType.fromDDL(fields)
    schema = StructType(inner.schema.fields[:-1] + added.fields)
    arrow = to_arrow_schema(added)

    def run(batches):
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            found = work(batch.column(batch.num_columns - 1).to_pylist())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(found, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return inner.mapInArrow(run, schema)


#: Name of the column that tells rows apart by doc_id and text where doc_id alone may repeat.
ROW_KEY = "_row_key"


def row_key(text_sha: Column | None = None) -> Column:
    """A hash of doc_id and text; `text_sha` is the text's SHA-256 if it is there already."""
    sha = F.sha2(utf8(), 256) if text_sha is None else text_sha
    return F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), sha).cast("binary"), 256)


def free_name(wanted: str, taken: list[str]) -> str:
    """`wanted`, with as many underscores before it as make it none of `taken`, whatever the case."""
    lowered = {c.lower() for c in taken}
    while wanted.lower() in lowered:
        wanted = f"_{wanted}"
    return wanted


def take_rows(docs: DataFrame, keys: DataFrame, times: str | None = None) -> DataFrame:
    """The rows of `docs` whose key is in `keys` (its only column but `times`), once each, or as often as `times` says.

    Join and numbering share one exchange on the key, which no two different texts or ids have
    in common. Of rows that agree in doc_id and text but not in all columns, the first by its
    other columns as JSON is taken, so reruns agree. Columns of any name pass through.
    """
    key, nth, often = (free_name(n, docs.columns) for n in (ROW_KEY, "_nth", "_times"))
    named = docs.withColumn(key, row_key())
    keys = keys.select(F.col(ROW_KEY).alias(key), *([F.col(times).alias(often)] if times else []))
    met = named.join(keys, key, "left_semi" if times is None else "inner")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy(key).orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    rows = met.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
    if times is not None:
        rows = rows.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(often).cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
