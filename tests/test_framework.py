import csv
import json
import zipfile
from datetime import datetime

import pytest

from flockwatch.functions.text import shortened, slug
from flockwatch.operators import semantics
from flockwatch.plans.analyses import REGISTRY, Analysis, CycleError, InputColumn, Registry, UnmappedInputs, bind, run
from flockwatch.plans.store import Store, VersionError, export_name, write_file
from flockwatch.sources import delimited, importers


@pytest.mark.parametrize(
    "expected, actual, score",
    [("identifier", "text", -4), ("identifier", "integer", -3), ("identifier", "url", -2), ("text", "url", -2), ("float", "integer", -1), ("time", "datetime", -2), ("datetime", "text", None), ("url", "url", 0)],
)
def test_compatibility(expected, actual, score):
    assert semantics.compatibility(expected, actual) == score


def test_automap_golden():
    inputs = [(i.name, i.data_type, list(i.hints)) for i in REGISTRY.primary("ngrams").inputs]
    got = semantics.automap({"id": "integer", "username": "identifier", "text": "text"}, inputs)
    assert got == {"user_id": "username", "message_id": "text", "message_text": "text"}


def test_automap_orders_by_score_then_place():
    one = lambda columns, expected, *hints: semantics.automap(columns, [("x", expected, list(hints))]).get("x")
    assert one({"a": "text", "b": "url", "c": "identifier"}, "identifier") == "c"
    assert one({"a": "text", "b": "url"}, "identifier", "A") == "a"
    assert one({"p": "url", "q": "datetime"}, "identifier") == "p"
    assert one({"screen_user_name": "integer", "z": "identifier"}, "identifier", "user name") == "screen_user_name"
    assert one({"a": "text"}, "datetime", "a") is None and semantics.automap({}, [("x", "text", [])]) == {}


def kinds(spark, values, type_="string"):
    return semantics.infer(spark.createDataFrame([(v,) for v in values], f"c {type_}")).get("c")


def test_inference(spark):
    assert kinds(spark, ["2024-01-02 03:04:05", "2024-01-02T03:04"]).data_type == "datetime"
    assert kinds(spark, ["02/01/2024 03:04"]).name == "datetime"
    assert kinds(spark, ["2024", "2023"]).name == "identifier"
    assert kinds(spark, [1_700_000_000, 1_700_000_001], "long").name == "timestamp_seconds"
    assert kinds(spark, [1_700_000_000_000], "long").name == "timestamp_milliseconds"
    assert kinds(spark, [1, 2, 9_000_000_000_000_000_000], "long").name == "integer"
    assert kinds(spark, [0.5, 1.5], "double").name == "float"
    assert kinds(spark, [True], "boolean").name == "boolean"
    assert kinds(spark, [" https://a.b/c "]).name == "url"
    assert kinds(spark, ["@who.is-it"]).name == "identifier"
    assert kinds(spark, ["some words here"]).name == "free_text"
    assert kinds(spark, [datetime(2024, 1, 1)], "timestamp_ntz").data_type == "datetime"
    assert kinds(spark, []) is None
    assert kinds(spark, [f"user{k}\t" for k in range(50)]).name == "identifier" and kinds(spark, ["\r\nhttps://a.b\u3000"]).name == "url"
    urls = ["http://a.b"] * 80 + ["not one"] * 20
    assert kinds(spark, urls).name != "url" and kinds(spark, urls[:-1] + ["http://a.b"]).name == "url"


def test_registry_order():
    def step(id, *needs):
        return Analysis(id, id, (), lambda *a: {}, base="p", depends_on=needs)

    r = Registry().add(Analysis("p", "p", (), lambda df: {}), step("c", "b"), step("a"), step("b", "a"))
    order = [a.id for a in r.secondaries("p")]
    assert order.index("a") < order.index("b") < order.index("c")
    with pytest.raises(CycleError):
        Registry().add(step("x", "y"), step("y", "x")).secondaries("p")
    with pytest.raises(ValueError):
        Registry().add(step("x", "gone")).secondaries("p")
    assert REGISTRY.primary("ngram_stats") is None and REGISTRY.secondary("ngrams", "ngram_stats").id == "ngram_stats"
    assert [p.id for p in REGISTRY.presenters_of("ngrams")] == ["ngram_repetition_by_poster"]


def test_run_end_to_end(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text("author,tweet id,body,posted at time\nann,t1,one two three four,2024-01-01 10:00:00\nbob,t2,one two three,2024-01-01 10:03:00\n")
    source = delimited.open_file(spark, str(path))
    assert source.dialect.separator == ","
    store = Store(spark, str(tmp_path / "data"))
    project = store.create("My Data!", source.read())
    assert project.id == "my_data" and store.create("My Data!", source.read()).id == "my_data_1"
    assert store.row_count("my_data") == 2 and store.input("my_data", 1).count() == 1 and len(store.projects()) == 2
    out = run(REGISTRY, store.input("my_data"), "ngrams", {"user_id": "author", "message_id": "tweet id", "message_text": "body", "timestamp": "posted at time"})
    store.save("my_data", "ngrams", out["ngrams"])
    store.save("my_data", "ngrams", out["ngram_stats"], "ngram_stats")
    assert store.analyses("my_data") == ["ngrams"] and store.secondaries("my_data", "ngrams") == ["ngram_stats"]
    assert (None, "ngrams") in store.outputs("my_data", "ngrams") and ("ngram_stats", "ngram_full") in store.outputs("my_data", "ngrams")
    stats = store.load("my_data", "ngrams", "ngram_stats", "ngram_stats")
    assert [(r.words, r.total_reps, r.distinct_posters) for r in stats.collect()] == [("one two three", 2, 2)]
    labels = REGISTRY.secondary("ngrams", "ngram_stats").outputs[0].labels
    made = store.export("my_data", "ngrams", "ngram_stats", "csv", labels, "ngram_stats")
    assert made.endswith("/exports/ngram_stats.csv")
    rows = list(csv.reader(open(made)))
    assert rows[0] == stats.columns and len(rows) == 2
    labels = REGISTRY.secondary("ngrams", "ngram_stats").outputs[1].labels
    full = list(csv.reader(open(store.export("my_data", "ngrams", "ngram_full", "csv", labels, "ngram_stats"))))
    assert ",".join(full[0]) == "ngram ID,ngram length,ngram content,ngram frequency,distinct user count,unique username,frequency by user,UPN,post identifier,post content,timestamp"
    assert REGISTRY.presenter("ngrams", "ngram_repetition_by_poster").chart(stats).first().asDict() == {"x": 2, "y": 2, "hover": "one two three"}
    times = run(REGISTRY, store.input("my_data"), "temporal")
    assert times["temporal"]["interval_count"].first()["count"] == 2
    with pytest.raises(UnmappedInputs):
        bind(store.input("my_data").select("author"), REGISTRY.primary("ngrams"))


def test_analyses_are_given_options_and_a_context(spark):
    df = spark.createDataFrame([("u", datetime(2024, 1, 1, 10))], "user_id string, timestamp timestamp_ntz")
    seen = {}

    def base(df, context, factor=1):
        seen["base"] = context
        df.write.parquet(f"{context.temp_dir}/kept")
        return {"t": context.spark.read.parquet(f"{context.temp_dir}/kept").selectExpr(f"count(*) * {factor} as n")}

    def more(base, before, context):
        return {"t": base["t"].union(before["t"])}

    made = Registry().add(
        Analysis("b", "b", (), base, (InputColumn("timestamp", "datetime", "t"),)),
        Analysis("first", "first", (), lambda base: base, base="b"),
        Analysis("second", "second", (), more, base="b", depends_on=("first",)),
    )
    out = run(made, df, "b", options={"b": {"factor": 5}})
    assert [r.n for r in out["second"]["t"].collect()] == [5, 5] and seen["base"].analysis.id == "b"


def test_store_waits_for_its_lock(spark, tmp_path, monkeypatch):
    from flockwatch.plans import store

    monkeypatch.setattr(store, "LOCK_SECONDS", 1)
    made = Store(spark, str(tmp_path / "s"))
    made.files.write(f"{made.root}/db.lock", "")
    assert made.create("A", spark.range(1)).id == "a"  # the lock is old by the time it is tried again, or taken to be
    assert made.analyses("a") == [] and made.secondaries("a", "x") == [] and made.outputs("a", "x") == []


def test_catalog_version(spark, tmp_path):
    (tmp_path / "db.json").write_text(json.dumps([{"class_": "version", "version": 99}]))
    with pytest.raises(VersionError):
        Store(spark, str(tmp_path))


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", <text>', ["x", "y"], None), (2, None, [], 0.5)], "n int, t string, l array<string>, d double")
    at = str(tmp_path / "out")
    rows = list(csv.reader(open(write_file(df, at, "csv"))))
    assert rows[0] == ["n", "t", "l", "d"] and ["1", 'a "quoted", <text>', "x,y", ""] in rows
    assert sorted(json.load(open(write_file(df, at, "json"))), key=lambda r: r["n"])[0] == {"n": 1, "t": 'a "quoted", <text>', "l": ["x", "y"], "d": None}
    with zipfile.ZipFile(write_file(df, at, "xlsx")) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "&lt;text&gt;" in sheet and '<row r="3">' in sheet and sheet.count("<row") == 3
    assert spark.read.parquet(write_file(df, at, "parquet")).count() == 2
    with pytest.raises(ValueError):
        write_file(df, at, "ods")
    assert export_name("ngram_stats", "ngram_stats") == "ngram_stats" and export_name("ngram_full", "ngram_stats") == "ngram_stats__ngram_full"


def test_delimited_golden(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b,c\n1,x,2\n2,y\n3,z,4,5\n" + "4,w,6\n" * 100 + "foo,w,6\n")
    f = delimited.open_file(spark, str(path), delimited.Dialect())
    assert [t.dataType.simpleString() for t in f.schema()] == ["bigint", "string", "bigint"]
    rows = [tuple(r) for r in f.read().collect()]
    assert rows[:3] == [(1, "x", 2), (2, "y", None), (3, "z", 4)] and rows[-1] == (None, "w", 6)
    assert f.preview(1).count() == 1 and delimited.suggested("a.csv") and not delimited.suggested("a.CSV")
    f.to_parquet(str(tmp_path / "x.parquet"))
    assert spark.read.parquet(str(tmp_path / "x.parquet")).count() == 104
    semi = tmp_path / "y.csv"
    semi.write_text("a;b\n'1';2\n'3;4';5\n")
    d = delimited.sniff(spark, str(semi))
    assert d.separator == ";" and d.with_(header=False).header is False
    with pytest.raises(TypeError):
        delimited.with_one_timestamp(spark, str(path))
    one = tmp_path / "z.csv"
    one.write_text("t,v\n2024-01-01 10:00:00,1\n")
    assert delimited.with_one_timestamp(spark, str(one))[1] == "t"


def test_fields_of_several_lines(spark, tmp_path):
    plain, spanning = tmp_path / "p.csv", tmp_path / "s.csv"
    plain.write_text('a,b\n1,"x, ""y"""\n2,z\n')
    spanning.write_text('a,b\n1,"x\ny"\n2,z\n')
    p, s = (delimited.open_file(spark, str(f), delimited.Dialect()) for f in (plain, spanning))
    assert not p.spans_lines and s.spans_lines
    assert [tuple(r) for r in p.read().collect()] == [(1, 'x, "y"'), (2, "z")] and [tuple(r) for r in s.read().collect()] == [(1, "x\ny"), (2, "z")]


def test_numbers_with_fractions(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("a,b\n1.5,nan\nNaN,inf\n-2e3,x\n")
    f = delimited.open_file(spark, str(path), delimited.Dialect())
    assert [t.dataType.simpleString() for t in f.schema()] == ["double", "string"]
    assert [r.b for r in f.read().collect()] == ["nan", "inf", "x"]


def test_sniff_reads_characters_not_lines(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a;b\n" + "1;2\n" * 5000)
    assert delimited.sniff(spark, str(path)).separator == ";"
    with pytest.raises(FileNotFoundError):
        delimited.sniff(spark, str(tmp_path / "none.csv"))


def test_importers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a|b\n1|2\n3|4\n")
    importer = importers.importer_for(str(path))
    assert importer.name == "CSV" and importers.importer_for("a.txt") is None
    assert importer.open(spark, str(path)).preview(1).count() == 1
    assert importer.configured(spark, str(path), separator="|", header=False).read().count() == 3
    path.write_text("")
    assert importer.open(spark, str(path)) is None


def test_names():
    assert slug("My Data!") == "my_data" and shortened(None) == "(N/A)" and shortened("x" * 30) == "x" * 20 + "..." and shortened(5) == "5"


def test_streams(spark, tmp_path):
    from flockwatch.streaming import windows

    src = str(tmp_path / "in")
    df = spark.createDataFrame([("u", datetime(2024, 1, 1, 10, 2), "['a', 'b']")], "user_id string, timestamp timestamp_ntz, hashtags string")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    for name, made in (
        ("s1", windows.hashtag_counts(stream.withColumnRenamed("timestamp", "time"))),
        ("s2", windows.active_users(stream)),
        ("s3", windows.interval_counts(stream)),
    ):
        q = made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("s1").count() == 2 and spark.table("s2").count() == 3 and spark.table("s3").first()["count"] == 1
