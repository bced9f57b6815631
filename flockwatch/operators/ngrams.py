"""Word n-grams of messages, and which of them are repeated by whom.

Numbers and counts of repeats come from passes over ranges of hashes of their words (`gram_tables`),
so words stay in the messages until a result asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NGRAM_SIZES, longer_ngrams, tokens
from ..scratch import cut, release
from .gram_tables import Numbered, Repeated
from .rows import not_blank, numbered

#: Columns of the full report.
FULL = ("ngram_id", "n", "words", "total_reps", "distinct_posters", "user_id", "reps_per_user", "message_surrogate_id", "message_id", "message_text", "timestamp")


def messages(df: DataFrame, number: bool = True) -> DataFrame:
    """message_surrogate_id (place in the input, from 1, before blank rows go), message_id, message_text, user_id, timestamp."""
    if number:
        df = numbered(df, "message_surrogate_id")
    kept = not_blank(df, "message_text", "user_id")
    return kept.select(*(["message_surrogate_id"] if number else []), "message_id", "message_text", "user_id", "timestamp")


def occurrences(df: DataFrame, *keys: str, sizes: tuple[int, ...] = NGRAM_SIZES) -> DataFrame:
    """One row for each n-gram in each message: `keys`, start, n, words."""
    grams = df.select(*keys, tokens(F.col("message_text")).alias("_1")).where(F.size("_1") >= min(sizes))
    for n in range(2, max(sizes) + 1):  # each size grows from the one before
        grams = grams.withColumn(f"_{n}", longer_ngrams(F.col(f"_{n - 1}"), F.col("_1"), n))
    by_size = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_{n}").alias("grams")) for n in sizes])
    return grams.select(*keys, F.inline(by_size)).select(*keys, "n", F.posexplode("grams").alias("start", "words"))


def message_counts(df: DataFrame, *keys: str, sizes: tuple[int, ...] = NGRAM_SIZES) -> DataFrame:
    """`keys`, words, n, count. Texts are dealt out by `keys` before they are taken apart, so n-grams never move."""
    return occurrences(df.repartition(*keys), *keys, sizes=sizes).groupBy(*keys, "words", "n").agg(F.count(F.lit(1)).alias("count"))


def definitions(df: DataFrame, sizes: tuple[int, ...] = NGRAM_SIZES) -> DataFrame:
    """ngram_id, words, n of messages()."""
    return Numbered(df, sizes).definitions()


def analyze(df: DataFrame, sizes: tuple[int, ...] = NGRAM_SIZES) -> dict[str, DataFrame]:
    """message_ngrams, ngrams and message_authors of user_id, message_id, message_text, timestamp.

    The numbers are those of `gram_tables`; message_ngrams and ngrams are made when they are asked for.
    """
    own = messages(df)
    made = Numbered(own, sizes)
    return {"message_ngrams": made.counts(), "ngrams": made.definitions(), "message_authors": own}


def _repeated_tables(outputs: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """ngram_stats, and of each message that has one of its n-grams: ngram_id, user_id, reps_per_user, message_surrogate_id and the n-gram's own columns."""
    counts, authors = outputs["message_ngrams"], outputs["message_authors"]
    joined = cut(counts.join(authors.select("message_surrogate_id", "user_id"), "message_surrogate_id"))
    stats = cut(_stats(joined, "ngram_id").join(outputs["ngrams"], "ngram_id").select("ngram_id", "words", "n", "total_reps", "distinct_posters"))
    every, joined = joined, cut(joined.join(stats.select("ngram_id"), "ngram_id", "left_semi"))
    release(every)
    by_user = joined.groupBy("ngram_id", "user_id").agg(F.sum("count").cast("int").alias("reps_per_user"))
    return stats, joined.drop("count").join(by_user.join(stats, "ngram_id"), ["ngram_id", "user_id"])


def _with_messages(rows: DataFrame, authors: DataFrame) -> DataFrame:
    """The full report: numbers are joined first, so a text goes with each row of the result, and only there."""
    return rows.join(authors.drop("user_id"), "message_surrogate_id").select(*FULL)


def repeated(outputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """ngram_stats (n-grams met more than once) and ngram_full (who repeats them where) from analyze()'s tables."""
    stats, rows = _repeated_tables(outputs)
    full = _with_messages(rows, outputs["message_authors"])
    down = [F.desc("n"), F.desc("total_reps"), F.desc("distinct_posters")]
    return {
        "ngram_stats": stats.orderBy(*down, "ngram_id"),
        "ngram_full": full.orderBy(*down, F.desc("reps_per_user"), "user_id", "message_surrogate_id", "ngram_id"),
    }


def _stats(counts: DataFrame, *keys: str) -> DataFrame:
    """total_reps and distinct_posters of what occurs more than once.

    Summing by poster first keeps the exact distinct count to a count of rows.
    """
    by_user = counts.groupBy(*keys, "user_id").agg(F.sum("count").alias("reps"))
    total = by_user.groupBy(*keys).agg(F.sum("reps").alias("total_reps"), F.count("user_id").alias("distinct_posters"))
    return total.where("total_reps > 1")


def repeated_words(df: DataFrame, sizes: tuple[int, ...] = NGRAM_SIZES) -> DataFrame:
    """words, n, total_reps, distinct_posters without ids."""
    return Repeated(messages(df), sizes).rows()


def repeated_summary(df: DataFrame, sizes: tuple[int, ...] = NGRAM_SIZES) -> DataFrame:
    """repeated()'s ngram_stats in no order, by the passes of `gram_tables`."""
    return Repeated(messages(df), sizes).summary()


def repeated_words_full(df: DataFrame, sizes: tuple[int, ...] = NGRAM_SIZES) -> DataFrame:
    """Each message and poster of each repeated n-gram, without ids."""
    made = Repeated(messages(df), sizes, ("user_id", "message_id")).full()
    return made.select("words", "n", "total_reps", "distinct_posters", "user_id", "reps_per_user", "message_id")


def repeated_report(df: DataFrame, text: Column | None = None, sizes: tuple[int, ...] = NGRAM_SIZES) -> DataFrame:
    """repeated()'s ngram_full in no order, by the passes of `gram_tables`; `text` is what goes out for a message's text, if not itself."""
    own = messages(df)
    carried = own if text is None else own.withColumn("message_text", text)
    return Repeated(own, sizes).report(carried).select(*FULL)


def repeated_report_in_order(df: DataFrame, sizes: tuple[int, ...] = NGRAM_SIZES) -> DataFrame:
    """Place of each row of repeated()'s ngram_full in its order, as nth, and the columns that it is sorted by; the rows are in no order."""
    own = messages(df)
    return Repeated(own, sizes).report(own.select("message_surrogate_id", "user_id"), words=False, places=True)
