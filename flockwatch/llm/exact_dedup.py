"""Exact dedup over an extendible-hash index that lives in shared files.

The index maps a 64-bit key of a text (the head of its SHA-256) to a bucket. A directory
of `2**depth` entries names the bucket of each key prefix; buckets that hold more than
`capacity` keys split, and the directory doubles when a split needs one more bit. Texts
are dealt to buckets by the directory. Each owner task takes a range of buckets, hence of
keys: it walks its texts in the order of keys, chains the different texts of a key, tells
them apart by their bytes, and writes the chains as the files of its buckets. Rows find
their group in the index that is read back from these files.

Scale: keys are counted first, combined before the shuffle, and are all that the directory
is cut from; it is the only thing collected and has `SLOTS` entries at most, as the capacity
grows with the table beyond that. Texts move once; equal ones that a task meets within `HELD`
bytes travel as one, so a group that holds a third of all rows sends one text for each such
stretch, and its owner holds one text of it. Groups with more than a thousandth of all grouped rows,
of which there are fewer than a thousand, are broadcast to their rows.

Defined results: a null text counts as empty; a null doc_id is below any other and stays
only if its group has no other; rows that repeat a doc_id and a text are one group, and
exactly one of them has kept = true. Empty input gives an empty result. Further columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, arrow_batch, cut, join_by_size, row_key, scratch_path, small_batches, take_rows, text_of, tidy, utf8

#: Keys of a bucket, entries of the directory, and bytes of texts that a task combines at a time.
CAPACITY, SLOTS, HELD = 2000, 1 << 16, 16 << 20


@dataclass(frozen=True)
class Directory:
    """`slots[prefix]` is the bucket of a key's first `depth` bits; buckets are numbered by key range."""

    depth: int
    slots: tuple[int, ...]

    @property
    def buckets(self) -> int:
        return self.slots[-1] + 1


def grow_directory(histogram: dict[int, int], max_depth: int, capacity: int) -> Directory:
    """Split overfull buckets, doubling the directory when a bucket already uses all its bits.

    `histogram` counts keys by their first `max_depth` bits. A bucket is (prefix, bits).
    """
    depth, done, open_ = 0, [], [(0, 0, sum(histogram.values()), sorted(histogram))]
    while open_:
        prefix, bits, count, cells = open_.pop()
        if count <= capacity or bits == max_depth:
            done.append((prefix, bits))
            continue
        depth = max(depth, bits + 1)
        shift = max_depth - bits - 1
        for bit in (0, 1):
            child = prefix << 1 | bit
            own = [c for c in cells if c >> shift == child]
            open_.append((child, bits + 1, sum(histogram[c] for c in own), own))
    done.sort(key=lambda b: b[0] << (max_depth - b[1]))
    slots = [0] * (1 << depth)
    for number, (prefix, bits) in enumerate(done):
        width = 1 << (depth - bits)
        slots[prefix * width : (prefix + 1) * width] = [number] * width
    return Directory(depth, tuple(slots))


def _prefix(key: str, bits: int):
    return F.shiftrightunsigned(F.col(key), 64 - bits) if bits else F.lit(0).cast("long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and the 64-bit index key of each row."""
    sha = F.sha2(text_of().cast("binary"), 256)
    return docs.select("doc_id", sha.alias("text_sha256")).withColumn(
        "key", F.conv(F.substring("text_sha256", 1, 16), 16, -10).cast("long")
    )


def build_directory(entries: DataFrame, capacity: int = CAPACITY, slots: int = SLOTS) -> Directory:
    """The directory of all keys of `entries`; the histogram it is cut from has `slots` cells at most."""
    keys = entries.select("key").distinct()
    bits = slots.bit_length() - 1
    cells = keys.groupBy(_prefix("key", bits).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.cell: r.n for r in cells.collect()}
    # half the slots may be used up by buckets; deeper ones could only come from uneven keys
    return grow_directory(histogram, bits, max(capacity, -(-2 * sum(histogram.values()) // slots)))


def _combined(directory: Directory, owners: int, schema: str):
    """(doc_id, text) to one row for each different text in a stretch: owner, bucket, key, bytes, largest doc_id, count."""
    import numpy as np

    slots, shift = np.array(directory.slots), 64 - directory.depth

    def combine(batches):
        met: dict[bytes, list] = {}
        size = 0

        def flush():
            out = []
            for text, (low, n) in met.items():
                key = int.from_bytes(hashlib.sha256(text).digest()[:8], "big")
                bucket = int(slots[key >> shift])
                out.append((bucket * owners // directory.buckets, bucket, key - (1 << 64) * (key >> 63), text, low, n))
            return arrow_batch(schema, out)

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = met.get(text)
                if known is None:
                    met[text] = [id_, 1]
                    size += len(text) + 100
                else:
                    known[0] = id_ if known[0] is None else known[0] if id_ is None else max(known[0], id_)
                    known[1] += 1
            if size >= HELD:
                yield flush()
                met, size = {}, 0
        if met:
            yield flush()
        tidy()

    return combine


def _chained(schema: str):
    """Rows of a task's buckets, sorted by bucket and key, to the chains of their keys."""

    def own(batches):
        at, chain = None, []  # chain: [text, largest doc_id, count] of each different text of the key

        def links():
            rows = sorted((hashlib.sha256(text).hexdigest(), text, id_, n) for text, id_, n in chain)
            return [(*at, k, sha, id_, n) for k, (sha, _, id_, n) in enumerate(rows, 1)]

        for batch in batches:
            out = []
            for bucket, key, text, id_, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (bucket, key) != at:
                    out += links()
                    at, chain = (bucket, key), []
                for link in chain:
                    if link[0] == text:
                        link[1] = id_ if link[1] is None else link[1] if id_ is None else max(link[1], id_)
                        link[2] += n
                        break
                else:
                    chain.append([text, id_, n])
            yield arrow_batch(schema, out)
        yield arrow_batch(schema, links() if chain else [])
        tidy()

    return own


def write_index(docs: DataFrame, directory: Directory) -> DataFrame:
    """bucket, key, link, text_sha256, keep_id, group_size of each different text, written by the owners as files of its bucket."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString().replace("bigint", "long")
    owners = min(directory.buckets, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = f"owner int, bucket int, key long, body binary, keep_id {id_type}, n long"
    posting = f"bucket int, key long, link int, text_sha256 string, keep_id {id_type}, group_size long"
    texts = docs.select("doc_id", utf8().alias("body")).mapInArrow(_combined(directory, owners, dealt), dealt)
    owned = texts.repartitionById(owners, F.col("owner")).sortWithinPartitions("bucket", "key").select("bucket", "key", "body", "keep_id", "n")
    path = scratch_path(spark)
    owned.mapInArrow(_chained(posting), posting).write.partitionBy("bucket").parquet(path)
    stored = spark.read.schema("key long, link int, text_sha256 string, " + f"keep_id {id_type}, group_size long, bucket int")
    return stored.parquet(path)


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256 and its bucket (null if alone)."""
    # rows that repeat doc_id and text: only the first of them may stay
    nth = Window.partitionBy("key", "text_sha256", "doc_id").orderBy("key")
    rows = cut(fingerprints(docs).withColumn("nth", F.row_number().over(nth)))
    index = write_index(docs, build_directory(rows, capacity))
    groups = index.where("group_size > 1").select("key", "text_sha256", "keep_id", "group_size", "bucket", F.col("group_size").alias("rows"))
    found = join_by_size(rows, groups, ["key", "text_sha256"], "rows")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
        "bucket",
    )


def survivors(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `docs`, all columns, that the groups keep; a repeated row is kept once."""
    kept = exact_groups(docs, capacity).where("kept").select(row_key(F.col("text_sha256")).alias(ROW_KEY))
    return take_rows(docs, kept)
