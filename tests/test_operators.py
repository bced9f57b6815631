import os
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import accumulate

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flockwatch.operators import coordination, hashtags, ngrams, timeofday
from flockwatch.operators.rows import numbered, preprocess, renamed

D = datetime


def posts(spark, rows):
    return spark.createDataFrame(rows, "user_id string, timestamp timestamp_ntz")


def test_temporal_golden(spark):
    df = posts(spark, [("a", D(2024, 1, 1, 23, 15)), ("b", D(2024, 2, 3, 23, 59)), ("c", D(2024, 5, 5)), ("d", None)])
    got = {tuple(r) for r in timeofday.interval_count(df).collect()}
    assert got == {("00:00:00", "01:00:00", 1), ("23:00:00", "00:00:00", 2), (None, None, 0)}


def test_temporal_odd_interval(spark):
    df = posts(spark, [("a", D(1970, 1, 1, 0, 6)), ("a", D(1970, 1, 2, 0, 1))])
    got = {r.time_interval_start for r in timeofday.interval_count(df, 7 * 60).collect()}
    assert got == {"00:00:00", "23:55:00"}


def test_minute_buckets(spark):
    df = posts(spark, [("a", D(2024, 1, 1, 0, 10)), ("a", D(2024, 1, 1, 23, 59)), ("a", None)])
    got = {(r.bucket, r.time_interval, r["count"]) for r in timeofday.minute_buckets(df).collect()}
    assert got == {(0, "00:00-00:30", 1), (47, "23:30-00:00", 1)}
    with pytest.warns(UserWarning):
        timeofday.minute_buckets(df, 7)


def test_coordination_golden(spark):
    rows = [("u1", D(2024, 1, 1, 10, 2)), ("u2", D(2024, 1, 1, 10, 7)), ("u1", D(2024, 1, 1, 10, 21)), (None, D(2024, 1, 1)), ("u3", None)]
    got = {tuple(r) for r in coordination.cooccurrence(posts(spark, rows)).collect()}
    assert got == {("u1", "u1", 4), ("u2", "u2", 2), ("u1", "u2", 1), ("u2", "u1", 1)}
    all_ = {tuple(r) for r in coordination.cooccurrence(posts(spark, rows), first_window="all").collect()}
    assert all_ == {("u1", "u1", 6), ("u2", "u2", 3), ("u1", "u2", 2), ("u2", "u1", 2)}
    assert coordination.cooccurrence(posts(spark, [])).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 7200)), min_size=1, max_size=30))
def test_coordination_brute_force(spark, rows):
    start = D(2024, 1, 1, 11, 3)
    rows = [(u, start + timedelta(seconds=s)) for u, s in rows]
    got = {(r[0], r[1]): r[2] for r in coordination.cooccurrence(posts(spark, rows)).collect()}
    step = timedelta(minutes=5)
    low = min(t for _, t in rows)
    w = low - timedelta(seconds=(low - D(2024, 1, 1)).total_seconds() % 300)
    want = Counter()
    while w <= max(t for _, t in rows):
        users = {u for u, t in rows if w <= t < w + 3 * step}
        want.update((a, b) for a in users for b in users)
        w += step
    assert got == dict(want)


def brute_gini(tags):
    x = sorted(Counter(tags).values())
    c = list(accumulate(x))
    return (len(x) + 1 - 2 * sum(c) / c[-1]) / len(x)


def test_hashtags_golden(spark):
    rows = [("['a', 'b']", 8, 10), ("['a']", 8, 50), ("[]", 9, 0), (None, 9, 30), ("['c']", 10, 0)]
    df = spark.createDataFrame([(h, D(2024, 1, 1, a, b)) for h, a, b in rows] + [("['z']", None)], "hashtags string, time timestamp_ntz")
    got = {r.time.hour: r for r in hashtags.gini_by_hour(df).collect()}
    assert set(got) == {8, 10}
    assert got[8].hashtags == ["a", "b", "a"] and got[8]["count"] == 3 and abs(got[8].gini - 1 / 6) < 1e-6
    assert got[10].hashtags == ["c"] and got[10].gini == 0
    assert hashtags.gini_by_hour(df.where("false")).count() == 0


@pytest.mark.parametrize("tags, want", [("ab", 0), ("abbb", 0.25), ("aaaaa", 0), ("aabcccc", None)])
def test_gini_values(spark, tags, want):
    df = spark.createDataFrame([("[" + ", ".join(f"'{t}'" for t in tags) + "]", D(2024, 1, 1))], "hashtags string, time timestamp_ntz")
    got = hashtags.gini_by_hour(df).first().gini
    assert abs(got - (brute_gini(tags) if want is None else want)) < 1e-6


def messages(spark, rows):
    return spark.createDataFrame(rows, "user_id string, message_id long, message_text string, timestamp timestamp_ntz").coalesce(1)


def test_ngrams_golden(spark):
    t = D(2024, 1, 1)
    out = ngrams.analyze(messages(spark, [("alice", 1, "A b c d", t), ("bob", 2, "a, b c!", t)]))
    assert {tuple(r) for r in out["ngrams"].collect()} == {(0, "a b c", 3), (1, "a b c d", 4), (2, "b c d", 3), (3, "a b c ", 4), (4, "b c ", 3)}
    assert {tuple(r) for r in out["message_ngrams"].collect()} == {(1, 0, 1), (1, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (2, 4, 1)}
    more = ngrams.repeated(out)
    assert [tuple(r) for r in more["ngram_stats"].collect()] == [(0, "a b c", 3, 2, 2)]
    full = more["ngram_full"].collect()
    assert [(r.ngram_id, r.user_id, r.reps_per_user, r.message_surrogate_id) for r in full] == [(0, "alice", 1, 1), (0, "bob", 1, 2)]
    assert more["ngram_full"].columns == "ngram_id n words total_reps distinct_posters user_id reps_per_user message_surrogate_id message_id message_text timestamp".split()


def test_ngrams_blank_rows(spark):
    t = D(2024, 1, 1)
    out = ngrams.analyze(messages(spark, [("a", 1, "", t), (None, 2, "x y z", t), ("c", 3, "p q r", t)]))
    assert [r.message_surrogate_id for r in out["message_authors"].collect()] == [3]
    assert [tuple(r) for r in out["message_ngrams"].collect()] == [(3, 0, 1)]
    none = ngrams.analyze(messages(spark, [("a", 1, "two words", t)]))
    assert none["ngrams"].count() == 0 and ngrams.repeated(none)["ngram_full"].count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.text("ab é_-٣", max_size=24)), min_size=1, max_size=8))
def test_ngrams_brute_force(spark, rows):
    out = ngrams.analyze(messages(spark, [(u, i, m, D(2024, 1, 1)) for i, (u, m) in enumerate(rows)]))
    ids, counts = {}, Counter()
    for i, (_, text) in enumerate(rows, 1):
        words = re.split(r"\W+", text.lower()) if text else []
        for k in range(len(words) - 2):
            for n in (3, 4, 5):
                if k + n <= len(words):
                    counts[i, ids.setdefault(" ".join(words[k : k + n]), len(ids))] += 1
    assert {r.words: r.ngram_id for r in out["ngrams"].collect()} == ids
    assert {(r[0], r[1]): r[2] for r in out["message_ngrams"].collect()} == dict(counts)
    reps, who = Counter(), defaultdict(set)
    for (i, g), c in counts.items():
        reps[g] += c
        who[g].add(rows[i - 1][0])
    got = {r.ngram_id: (r.total_reps, r.distinct_posters) for r in ngrams.repeated(out)["ngram_stats"].collect()}
    assert got == {g: (c, len(who[g])) for g, c in reps.items() if c > 1}


def test_rows(spark):
    df = spark.range(0, 100, 1, 7)
    assert [r.place - 1 for r in numbered(df, "place").orderBy("id").collect()] == list(range(100))
    assert preprocess(df, {"a": "id", "b": "id"}).columns == ["a", "b"]
    assert renamed(df, {"id": "The Id"}).columns == ["The Id"]


def test_numbers_follow_files(spark, tmp_path):
    """A small file before a large one: tasks take the large one first, numbers don't."""
    spark.range(0, 10).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(10, 50_000).coalesce(1).write.parquet(str(tmp_path / "b"))
    (tmp_path / "all").mkdir()
    for k, d in enumerate("ab"):
        next((tmp_path / d).glob("part-*.parquet")).rename(tmp_path / "all" / f"part-{k}.parquet")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = numbered(spark.read.parquet(str(tmp_path / "all")).select("id"), "place")
        assert got.where("place != id + 1").count() == 0 and got.count() == 50_000 and got.columns == ["id", "place"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_busy_windows_in_blocks(spark, monkeypatch):
    rows = [(f"u{k}", D(2024, 1, 1, 10, k % 20)) for k in range(30)]
    want = {tuple(r) for r in coordination.cooccurrence(posts(spark, rows)).collect()}
    monkeypatch.setattr(coordination, "BLOCK", 3)
    assert {tuple(r) for r in coordination.cooccurrence(posts(spark, rows)).collect()} == want


def test_pairs_are_counted_where_they_are_made(spark):
    """No shuffle carries pairs: the last one carries the users of each window, and users of all blocks meet."""
    rows = [(f"u{k}", D(2024, 1, 1, 10, k % 20)) for k in range(30)]
    df = coordination.cooccurrence(posts(spark, rows))
    got = {(r[0], r[1]): r[2] for r in df.collect()}
    want = Counter()
    for low in range(0, 60, 5):
        users = {u for u, t in rows if low <= t.minute < low + 15}
        want.update((a, b) for a in users for b in users)
    assert got == dict(want)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    full = df._jdf.queryExecution().executedPlan().toString()
    top = full[: full.index("Exchange")]
    assert "Generate explode(a" in top and "Generate explode(b" in top and "cooccurrence_count" in plan


def test_pairs_are_counted_in_batches(spark):
    """No row is made for a pair and window: what counts is one step, of batches, and lists of users with one count are taken apart above it."""
    import random

    rand = random.Random(3)
    zoned = spark.createDataFrame([(rand.randrange(700), D(2024, 1, 1, 10, rand.randrange(60))) for _ in range(1500)], "user_id int, timestamp timestamp_ntz")
    zoned = zoned.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    df = coordination.cooccurrence(zoned, first_window="all")
    full = df._jdf.queryExecution().executedPlan().toString()
    top = full[: full.index("Exchange")]
    assert "MapInArrow" in top and "Aggregate" not in top
    windows = zoned.select(F.window("timestamp", "15 minutes", "5 minutes")["start"].alias("w"), "user_id").distinct()
    want = windows.join(windows.withColumnRenamed("user_id", "other"), "w").groupBy("user_id", "other").count()
    assert Counter(map(tuple, df.collect())) == Counter(map(tuple, want.collect()))


def test_pairs_by_lists_and_by_matrix(monkeypatch):
    """Both ways to count, in pieces of any size, give what sets of windows give."""
    import numpy as np
    import pyarrow as pa

    rand = np.random.default_rng(5)

    def side(users, share):
        there = rand.random((users, 40)) < share
        there[0] = False  # one who meets nobody
        return (pa.array([f"{users}-{k}" for k in range(users)]), *np.nonzero(there)), there.astype(int)

    (one, x), (two, y) = side(30, 0.1), side(50, 0.6)
    for dense, tile, step, held, rows in [(0, 7, 8, 9, 10), (10**9, 7, 8, 9, 10), (32, 256, 1024, 1 << 20, 1 << 19)]:
        for name, value in {"DENSE": dense, "TILE": tile, "STEP": step, "HELD": held, "ROWS": rows}.items():
            monkeypatch.setattr(coordination, name, value)
        for other, times, own in [(two, x @ y.T, False), (one, x @ x.T, True)]:
            want = Counter({(one[0][a].as_py(), other[0][b].as_py(), int(times[a, b])): 1 for a, b in zip(*np.nonzero(times))})
            want.update({(b, a, n): 1 for a, b, n in list(want)} if not own else {})
            got = Counter()
            for batch in coordination._meet(one, other, own):
                for r in batch.to_pylist():
                    got.update((a, b, r["cooccurrence_count"]) for a in r["a"] for b in r["b"])
            assert got == want


def test_plans_stay_in_the_jvm(spark):
    from flockwatch.plans import catalog

    for name in ("time_coordination", "ngram_stats", "hashtag_gini", "temporal_interval_count"):
        df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan, name


def test_scratch_leaves_no_shuffles_and_releases(spark):
    """What is shuffled to write a scratch table goes with the write, and tables that are used up go with `release`."""
    import os

    from flockwatch.scratch import cut, release

    def shuffled():
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for top in local for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    before = shuffled()
    table = cut(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count())
    assert not shuffled() - before and table.count() == 1000
    where = table.inputFiles()[0].split(":", 1)[1].rsplit("/", 1)[0]
    release(table)
    assert not os.path.exists("/" + where.lstrip("/"))


def test_report_moves_digests_not_texts(spark):
    """A text of the report is repeated for each of its n-grams, so no join or sort of the query carries it."""
    from flockwatch.plans import catalog

    plan = catalog.ngram_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    sort = plan.index("Sort [")
    assert "md5" not in plan[:sort] and "md5" in plan[sort:]


def test_ngram_numbers_in_passes(spark, monkeypatch):
    """Small chunks, ranges and passes, odd bytes, long words and order of rows: numbers are still those of the first meeting."""
    from flockwatch.operators import gram_tables

    for name, value in (("CHUNK", 40), ("WORDS_A_PASS", 60), ("HELD", 16)):
        monkeypatch.setattr(gram_tables, name, value)
    long = "w" * 60
    texts = [f"a b c d{k % 7} é{k % 3} {long}{k % 2} {long}{k % 2} !" if k % 5 else f"-- B a_b {k} c 𝒳 ²" for k in range(80)]
    texts[7] = "a b c " * 60
    for order in (1, -1):  # descending ids are sorted into chunks anew
        rows = [("u", k, t, D(2024, 1, 1)) for k, t in enumerate(texts)]
        own = ngrams.messages(messages(spark, rows)).orderBy(F.col("message_surrogate_id") * order).coalesce(1)
        made = gram_tables.Numbered(own, (3, 4, 5))
        assert made.passes == 6 and made.tasks > 1 and made.chunks.count() > 20
        ids, counts = {}, Counter()
        for i, text in enumerate(texts, 1):
            words = re.split(r"\W+", text.lower())
            for k in range(len(words) - 2):
                for n in (3, 4, 5):
                    if k + n <= len(words):
                        counts[i, ids.setdefault((" ".join(words[k : k + n]), n), len(ids))] += 1
        assert {(r.words, r.n): r.ngram_id for r in made.definitions().collect()} == ids
        got = made.counts().collect()
        assert {(r[0], r[1]): r[2] for r in got} == dict(counts) and len(got) == len(counts)


def test_repeated_words_in_passes(spark, monkeypatch):
    """In small chunks, ranges and passes, many users and few: totals and users are those of a plain count, and what is dealt out fits a pass."""
    from flockwatch.operators import gram_tables

    for name, value in (("CHUNK", 4000), ("WORDS_A_PASS", 600), ("HELD", 64)):
        monkeypatch.setattr(gram_tables, name, value)
    texts = [f"a b c d{k % 7} é{k % 3} x y !" if k % 5 else f"-- B a_b {k} c 𝒳 ²" for k in range(800)]
    texts[7] = "a b c " * 60
    for users in (3, 600):
        rows = [(f"u{k * 7 % users}", k, t, D(2024, 1, 1)) for k, t in enumerate(texts)]
        reps, who = Counter(), defaultdict(set)
        for user, _, text, _ in rows:
            words = re.split(r"\W+", text.lower())
            for n in (3, 4, 5):
                for k in range(len(words) - n + 1):
                    reps[gram := (" ".join(words[k : k + n]), n)] += 1
                    who[gram].add(user)
        want = sorted((*g, c, len(who[g])) for g, c in reps.items() if c > 1)
        assert gram_tables.Repeated(ngrams.messages(messages(spark, rows)), (3, 4, 5)).passes == 6
        got = ngrams.repeated_words(messages(spark, rows))
        assert sorted(tuple(r) for r in got.collect()) == want and got.schema.simpleString() == "struct<words:string,n:int,total_reps:bigint,distinct_posters:bigint>"
    assert ngrams.repeated_words(messages(spark, [("a", 1, "two words", D(2024, 1, 1))])).count() == 0


def test_marked_chunks_are_kept_once(spark):
    """Passes and result read one table of chunks with their marks; the chunks without go, unless a result that reads them was handed out."""
    from flockwatch.operators import gram_tables

    rows = [("u", k, f"a b c d{k % 3} e", D(2024, 1, 1)) for k in range(9)]
    for early in (False, True):
        made = gram_tables.Numbered(ngrams.messages(messages(spark, rows)), (3, 4, 5))
        where = made.chunks.inputFiles()[0].split(":", 1)[1]
        first = made.definitions() if early else None
        counts = made.counts()
        assert os.path.exists("/" + where.lstrip("/")) == early
        assert counts.groupBy("message_surrogate_id").count().where("count = 6").count() == 9
        again = sorted(map(tuple, made.definitions().collect()))
        assert len(again) == 16 and (first is None or sorted(map(tuple, first.collect())) == again)


def test_export_has_whole_texts(spark):
    """The exported report has each message's text itself, on every row."""
    from flockwatch.plans import catalog

    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet").select(F.col("doc_id").alias("post identifier"), "text")
    got = catalog.export_rename(spark, where).join(docs, "post identifier", "left")
    rows, same = got.agg(F.count(F.lit(1)), F.count_if(F.col("post content") == F.col("text"))).first()
    assert rows == same > 1000


def test_repeated_rows_in_passes(spark, monkeypatch):
    """In small chunks, ranges and passes: rows by message and numbered totals are those of a plain count, and come from the chunks without a join of n-grams."""
    from flockwatch.operators import gram_tables

    for name, value in (("CHUNK", 400), ("WORDS_A_PASS", 600), ("HELD", 64)):
        monkeypatch.setattr(gram_tables, name, value)
    texts = [f"a b c d{k % 7} é{k % 3} x y !" if k % 5 else f"-- B a_b {k} c 𝒳 ²" for k in range(300)]
    texts[7] = "a b c " * 60
    for users in (3, 280):
        rows = [(f"u{k * 7 % users}", k, t, D(2024, 1, 1)) for k, t in enumerate(texts)]
        reps, by_user, ids, own = Counter(), Counter(), {}, set()
        for user, m, text, _ in rows:
            words = re.split(r"\W+", text.lower())
            for k in range(len(words) - 2):
                for n in (3, 4, 5):
                    if k + n <= len(words):
                        gram = " ".join(words[k : k + n]), n
                        ids.setdefault(gram, len(ids))
                        reps[gram] += 1
                        by_user[gram, user] += 1
                        own.add((gram, user, m))
        who = Counter(g for g, _ in by_user)
        made = ngrams.repeated_summary(messages(spark, rows))
        assert sorted(map(tuple, made.collect())) == sorted((ids[g], *g, c, who[g]) for g, c in reps.items() if c > 1)
        made = ngrams.repeated_words_full(messages(spark, rows))
        assert sorted(map(tuple, made.collect())) == sorted((*g, reps[g], who[g], u, by_user[g, u], m) for g, u, m in own if reps[g] > 1)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Aggregate" not in plan and "Join" not in plan
    none = messages(spark, [("a", 1, "two words", D(2024, 1, 1))])
    assert ngrams.repeated_summary(none).count() == 0 and ngrams.repeated_words_full(none).count() == 0


def test_summary_is_put_in_order_by_many_tasks(spark):
    """The sort of the numbered summary is not drawn into one task, and no words move in it."""
    from flockwatch.plans import catalog

    made = catalog.summary_in_order(spark, "/root/testdata/sf0.001")
    assert "Repartition 1" not in made._jdf.queryExecution().optimizedPlan().toString()
    rows = made.orderBy("nth").collect()
    assert [r.nth for r in rows] == list(range(1, len(rows) + 1))
    assert all((-a.n, -a.total_reps, -a.distinct_posters, a.ngram_id) < (-b.n, -b.total_reps, -b.distinct_posters, b.ngram_id) for a, b in zip(rows, rows[1:]))


def test_pairs_are_put_in_order_by_many_tasks(spark):
    """The sort of the pairs is not drawn into one task, and numbers follow it."""
    from flockwatch.plans import catalog

    made = catalog.pairs_in_order(spark, "/root/testdata/sf0.001")
    assert "Repartition 1" not in made._jdf.queryExecution().optimizedPlan().toString()
    rows = made.orderBy("nth").collect()
    assert [r.nth for r in rows] == list(range(1, len(rows) + 1))
    assert all((-a[3], a[1], a[2]) < (-b[3], b[1], b[2]) for a, b in zip(rows, rows[1:]))


def _rows_are_made_last(df):
    """No join, sort or count is above the step that makes a report's rows, and a message's own columns are repeated after it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("MapInArrow")]
    return "Generate inline" in top and not any(x in top for x in ("Join", "Sort", "Aggregate", "Repartition"))


def test_export_rows_are_made_where_their_chunk_is(spark):
    from flockwatch.plans import catalog

    assert _rows_are_made_last(catalog.export_rename(spark, "/root/testdata/sf0.001"))


def _small_report(spark, monkeypatch):
    """Messages in many small chunks, ranges, passes and lists, and the rows of their report, in order, by plain counts."""
    from flockwatch.operators import gram_tables

    for name, value in (("CHUNK", 400), ("WORDS_A_PASS", 600), ("HELD", 64), ("LIST", 300)):
        monkeypatch.setattr(gram_tables, name, value)
    texts = [f"A b c d{k % 7} é{k % 3} x y !" if k % 5 else f"-- B a_b {k} c 𝒳 ²" for k in range(200)]
    texts[7], texts[9] = "a b c " * 60, ""
    rows = [(f"u{k * 7 % 23}", k, t, D(2024, 1, 1) + timedelta(seconds=k)) for k, t in enumerate(texts)]
    reps, by_user, ids, own = Counter(), Counter(), {}, set()
    for user, m, text, _ in rows:
        words = re.split(r"\W+", text.lower())
        for k in range(len(words) - 2):
            for n in (3, 4, 5):
                if k + n <= len(words):
                    gram = " ".join(words[k : k + n]), n
                    ids.setdefault(gram, len(ids))
                    reps[gram] += 1
                    by_user[gram, user] += 1
                    own.add((gram, m))
    who = Counter(g for g, _ in by_user)
    want = [(ids[g], g[1], g[0], reps[g], who[g], rows[m][0], by_user[g, rows[m][0]], m + 1, *rows[m][1:]) for g, m in own if reps[g] > 1]
    return messages(spark, rows), sorted(want, key=lambda r: (-r[1], -r[3], -r[4], -r[6], r[5], r[7], r[0]))


def test_report_in_passes(spark, monkeypatch):
    """All columns of the report are those of plain counts, and its rows are in no join or sort."""
    from flockwatch.plans import catalog

    assert _rows_are_made_last(catalog.ngram_report(spark, "/root/testdata/sf0.001"))
    df, want = _small_report(spark, monkeypatch)
    assert sorted(map(tuple, ngrams.repeated_report(df).collect())) == sorted(want)
    assert ngrams.repeated_report(messages(spark, [("a", 1, "two words", D(2024, 1, 1))])).count() == 0


def test_report_is_numbered_in_order_where_its_rows_are(spark, monkeypatch):
    """Places in the order of the report are those of a plain sort, but only cells of chunks are sorted, not rows."""
    from flockwatch.plans import catalog

    assert _rows_are_made_last(catalog.report_in_order(spark, "/root/testdata/sf0.001"))
    df, want = _small_report(spark, monkeypatch)
    columns = ("nth", "n", "total_reps", "distinct_posters", "reps_per_user", "user_id", "message_surrogate_id", "ngram_id")
    got = ngrams.repeated_report_in_order(df).select(*columns).orderBy("nth").collect()
    assert [tuple(r) for r in got] == [(k, r[1], r[3], r[4], r[6], r[5], r[7], r[0]) for k, r in enumerate(want, 1)]
    assert ngrams.repeated_report_in_order(messages(spark, [("a", 1, "two words", D(2024, 1, 1))])).count() == 0
