"""Registered queries of sources, exports, inference and mapping, and their SQL.

Files are made from the test tables first, as no table is a delimited file.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import shortened
from ..operators import semantics
from ..operators.rows import numbered, preprocess
from ..scratch import scratch_path
from ..sources import delimited, importers
from .analyses import REGISTRY
from .store import Store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _written(df: DataFrame, **options) -> str:
    path = scratch_path(df.sparkSession, ".csv")
    df.coalesce(1).write.options(**options).csv(path)
    return path


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def csv_import(spark, sf_dir):
    """Sniffed, inferred, imported as Parquet and read back."""
    path = _written(_customers(spark, sf_dir), header=True, sep=";", quoteAll=True)
    opened = importers.importer_for(path).open(spark, path)
    made = scratch_path(spark, ".parquet")
    opened.to_parquet(made)
    return spark.read.parquet(made)


def csv_preview(spark, sf_dir):
    path = _written(_customers(spark, sf_dir), header=True)
    return delimited.open_file(spark, path).preview(10)


def csv_dialect(spark, sf_dir):
    """A dialect given by hand, without a header."""
    path = _written(_customers(spark, sf_dir), header=False, sep="|", quote="'", quoteAll=True)
    read = importers.importer_for(path).configured(spark, path, separator="|", quote="'", header=False).read()
    return read.toDF("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def csv_ragged(spark, sf_dir):
    """Lines with too many and too few fields, and cells that don't parse."""
    key = F.col("c_custkey")
    later = lambda n: (key % n == 0) & (key >= 200)
    fields = [
        F.when(later(13), F.lit("foo")).otherwise(key.cast("string")),
        F.col("c_mktsegment"),
        F.when(key % 11 != 0, F.col("c_nationkey").cast("string")),
        F.when(later(7), F.lit("extra")),
    ]
    lines = _table(spark, sf_dir, "customer").select(F.concat_ws(",", *fields).alias("value"))
    path = scratch_path(spark, ".csv")
    spark.createDataFrame([("key,segment,nation",)], "value string").union(lines).coalesce(1).write.text(path)
    return delimited.open_file(spark, path, delimited.Dialect()).read()


def csv_one_timestamp(spark, sf_dir):
    shown = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("posted")
    path = _written(_table(spark, sf_dir, "events").select(shown, "event_type"), header=True)
    df, name = delimited.with_one_timestamp(spark, path)
    return df.select(F.col(name).cast("timestamp_ntz").alias("posted"), "event_type")


def _sheet(spark: SparkSession, path: str) -> list[list[str]]:
    """The cells of a workbook's first sheet, as text."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    raw = spark.read.format("binaryFile").load(path).first().content
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    return [["".join(c.itertext()) for c in row.iter(f"{space}c")] for row in root.iter(f"{space}row")]


def export_formats(spark, sf_dir):
    """A project of nations, saved, exported in every format under its labels, and read back."""
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    store = Store(spark, scratch_path(spark))
    project = store.create("Nations of the World", nations)
    store.save(project.id, "nations", {"names": store.input(project.id)})
    made = {x: store.export(project.id, "nations", "names", x, {"n_name": "Nation Name"}) for x in ("parquet", "csv", "json", "xlsx")}
    sheet = _sheet(spark, made["xlsx"])
    back = {
        "parquet": spark.read.parquet(made["parquet"]),
        "csv": spark.read.csv(made["csv"], header=True),
        "json": spark.read.json(made["json"], multiLine=True),
        "xlsx": spark.createDataFrame(sheet[1:], ", ".join(f"`{c}` string" for c in sheet[0])),
    }
    rows = [df.select(F.lit(x).alias("format"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "Nation Name") for x, df in back.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of every kind that inference tells apart."""
    ts, id_ = F.col("ts"), F.col("event_id").cast("string")
    seconds = F.unix_seconds(ts.cast("timestamp_ltz"))
    return _table(spark, sf_dir, "events").select(
        F.date_format("ts", "dd/MM/yyyy HH:mm").alias("posted_text"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("posted_iso"),
        seconds.alias("posted_s"),
        (seconds * 1000).alias("posted_ms"),
        (F.col("user_id") % 2 == 0).alias("even"),
        F.concat(F.lit("user"), id_, F.lit("\t")).alias("handle"),
        F.concat(F.lit("\r\nhttps://example.com/"), id_).alias("link"),
        F.concat(F.lit("event "), id_).alias("words"),
        F.col("event_id").alias("number"),
        "value",
        "ts",
    )


def _found(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    rows = [(name, c, s.name, s.data_type) for c, s in semantics.infer(df).items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, semantic string, data_type string")


def semantic_inference(spark, sf_dir):
    found = [_found(spark, name, _table(spark, sf_dir, name)) for name in ("events", "documents", "pages")]
    return found[0].union(found[1]).union(found[2])


def semantic_kinds(spark, sf_dir):
    return _found(spark, "probe", _probe(spark, sf_dir))


def datetime_conversion(spark, sf_dir):
    """Times given as text in two forms, as seconds and as milliseconds, each converted by what it is inferred to be."""
    probe = _probe(spark, sf_dir).select("number", "posted_text", "posted_iso", "posted_s", "posted_ms")
    found = semantics.infer(probe)
    return preprocess(probe, {c: c for c in probe.columns}, {c: found[c].convert(F.col(c)) for c in probe.columns})


def store_projects(spark, sf_dir):
    """Projects by display name; two of one name get ids of their own."""
    regions = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    store = Store(spark, scratch_path(spark))
    for r in regions.orderBy("r_regionkey").collect():
        store.create(f"{r.r_name} (posts)", regions.where(F.col("r_regionkey") >= r.r_regionkey))
    store.create("Once more", regions.limit(0))
    store.create("Once more", regions.limit(0))
    rows = [(p.id, p.display_name, store.row_count(p.id)) for p in store.projects()]
    return spark.createDataFrame(rows, "id string, display_name string, num_rows long")


def preview_cells(spark, sf_dir):
    """What a preview shows of the first rows."""
    rows = _table(spark, sf_dir, "pages").orderBy("page_id").limit(20).select("page_id", "url", "html").collect()
    shown = [tuple(shortened(x) for x in r) for r in rows]
    return spark.createDataFrame(shown, "page_id string, url string, html string")


def surrogate_ids_of_files(spark, sf_dir):
    """Numbers over two files of unequal size, the small one first."""
    events, at = _table(spark, sf_dir, "events").select("event_id"), scratch_path(spark)
    events.where("event_id < 10").coalesce(1).write.parquet(f"{at}/a")
    events.where("event_id >= 10").coalesce(1).write.parquet(f"{at}/b")
    return numbered(spark.read.parquet(f"{at}/a", f"{at}/b"), "place")


def column_automap(spark, sf_dir):
    rows = []
    columns = {c: s.data_type for c, s in semantics.infer(_table(spark, sf_dir, "events")).items()}
    for analysis in REGISTRY.primaries():
        mapped = semantics.automap(columns, [(i.name, i.data_type, list(i.hints)) for i in analysis.inputs])
        rows += [(analysis.id, i.name, mapped.get(i.name)) for i in analysis.inputs]
    return spark.createDataFrame(rows, "analysis string, input string, mapped string")


QUERIES = {
    f.__name__: f
    for f in (
        csv_import, csv_preview, csv_dialect, csv_ragged, csv_one_timestamp, export_formats, store_projects, preview_cells, surrogate_ids_of_files,
        semantic_inference, semantic_kinds, datetime_conversion, column_automap,
    )
}


def _kind_sql(column: str, kind: str) -> str:
    """Semantic and type of a column of a physical kind, by the share of valid cells of the first rows."""
    share = lambda test: f"avg(coalesce({test}, false)::int) > {semantics.THRESHOLD}"
    bare = f"regexp_replace({column}::varchar, '^\\s+|\\s+$', '', 'g')"
    formats = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d %H:%M", "%d/%m/%Y %H:%M", "%d-%m-%Y %H:%M"]
    tests = {
        "time": [("count(*) > 0", "timestamp", "datetime")],
        "text": [
            (share(f"try_strptime({column}::varchar, {formats}) is not null"), "datetime", "datetime"),
            (share(f"regexp_matches({bare}, '{semantics.URL}')"), "url", "url"),
            (share(f"regexp_matches({bare}, '{semantics.IDENTIFIER}')"), "identifier", "identifier"),
            ("count(*) > 0", "free_text", "text"),
        ],
        "boolean": [("count(*) > 0", "boolean", "boolean")],
    }
    for number, name in (("whole", "integer"), ("fraction", "float")):
        tests[number] = [
            (share(f"{column} > epoch(timestamp '2000-01-01') and {column} < epoch(timestamp '2100-01-01')"), "timestamp_seconds", "datetime"),
            (share(f"{column} > epoch_ms(timestamp '2000-01-01') and {column} < epoch_ms(timestamp '2100-01-01')"), "timestamp_milliseconds", "datetime"),
            ("true", name, name),
        ]
    cases = " ".join(f"when {test} then '{semantic}:{data_type}'" for test, semantic, data_type in tests[kind])
    return f"case {cases} end"


def _inference_sql(name: str, source: str, columns: dict[str, str]) -> str:
    each = [
        f"select '{name}' as table_name, '{c}' as column_name, {k} as place, {_kind_sql(c, kind)} as found from (select * from {source} limit {semantics.SAMPLE})"
        for k, (c, kind) in enumerate(columns.items())
    ]
    return f"select table_name, column_name, place, split_part(found, ':', 1) as semantic, split_part(found, ':', 2) as data_type from ({' union all '.join(each)})"


_events = {"event_id": "whole", "ts": "time", "user_id": "whole", "event_type": "text", "value": "fraction", "props": "text"}
_documents = {"doc_id": "whole", "text": "text", "lang": "text", "source": "text", "n_chars": "whole"}
_pages = {"page_id": "whole", "url": "text", "html": "text"}
_probe_columns = {
    "posted_text": "text", "posted_iso": "text", "posted_s": "whole", "posted_ms": "whole", "even": "boolean",
    "handle": "text", "link": "text", "words": "text", "number": "whole", "value": "fraction", "ts": "time",
}
_probe_sql = r"""(select strftime(ts, '%d/%m/%Y %H:%M') as posted_text, strftime(ts, '%Y-%m-%d %H:%M:%S') as posted_iso,
  floor(epoch(ts))::bigint as posted_s, floor(epoch(ts))::bigint * 1000 as posted_ms, user_id % 2 = 0 as even, 'user' || event_id || chr(9) as handle,
  chr(13) || chr(10) || 'https://example.com/' || event_id as link, 'event ' || event_id as words, event_id as number, value, ts from events)"""


def _values(rows: list[tuple]) -> str:
    shown = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


_inputs = [(a.id, i.name, i.data_type) for a in REGISTRY.primaries() for i in a.inputs]
_hints = [(a.id, i.name, h) for a in REGISTRY.primaries() for i in a.inputs for h in i.hints]
_scores = [(e, a, s) for (e, a), s in semantics.SCORES.items()]
_of_customers = "select c_custkey, c_name, c_acctbal, c_mktsegment from customer"

ORACLES = {
    "csv_import": _of_customers,
    "csv_preview": f"{_of_customers} order by c_custkey limit 10",
    "csv_dialect": _of_customers,
    "csv_ragged": """
select case when c_custkey % 13 = 0 and c_custkey >= 200 then null else c_custkey end as key, c_mktsegment as segment,
       case when c_custkey % 11 = 0 then null else c_nationkey::bigint end as nation from customer""",
    "csv_one_timestamp": "select date_trunc('second', ts) as posted, event_type from events",
    "export_formats": """select format, n_nationkey::bigint as n_nationkey, n_name as "Nation Name" from nation, (values ('parquet'), ('csv'), ('json'), ('xlsx')) t(format)""",
    "store_projects": r"""
select trim(regexp_replace(lower(r_name || ' (posts)'), '\W+', '_', 'g'), '_') as id, r_name || ' (posts)' as display_name,
       (select count(*) from region b where b.r_regionkey >= a.r_regionkey) as num_rows from region a
union all select 'once_more' || n, 'Once more', 0 from (values (''), ('_1')) t(n)""",
    "preview_cells": """
with c as (select page_id::varchar as page_id, url, html from pages order by pages.page_id limit 20)
select page_id, case when url is null then '(N/A)' when length(url) <= 20 then url else url[1:20] || '...' end as url,
       case when html is null then '(N/A)' when length(html) <= 20 then html else html[1:20] || '...' end as html from c""",
    "surrogate_ids_of_files": "select event_id, row_number() over (order by event_id >= 10, event_id) as place from events",
    "datetime_conversion": """
select event_id as number, date_trunc('minute', ts) as posted_text, date_trunc('second', ts) as posted_iso, date_trunc('second', ts) as posted_s,
       date_trunc('second', ts) as posted_ms from events""",
    "semantic_inference": f"""select table_name, column_name, semantic, data_type from (
{_inference_sql('events', 'events', _events)} union all {_inference_sql('documents', 'documents', _documents)} union all {_inference_sql('pages', 'pages', _pages)})""",
    "semantic_kinds": f"select table_name, column_name, semantic, data_type from ({_inference_sql('probe', _probe_sql, _probe_columns)})",
    "column_automap": f"""
with col as ({_inference_sql('events', 'events', _events)}),
input(analysis, input, expected) as (values {_values(_inputs)}),
hint(analysis, input, hint) as (values {_values(_hints)}),
score(expected, actual, score) as (values {_values(_scores)}),
hit as (
  select distinct h.analysis, h.input, c.column_name from hint h, col c
  where list_bool_and(list_transform(string_split(h.hint, ' '), lambda w: contains(lower(c.column_name), w)))),
ranked as (
  select i.analysis, i.input, c.column_name as mapped,
         row_number() over (partition by i.analysis, i.input order by s.score + case when h.input is null then 0 else {semantics.HINT_BONUS} end desc, c.place) as nth
  from input i join score s using (expected) join col c on c.data_type = s.actual
  left join hit h on h.analysis = i.analysis and h.input = i.input and h.column_name = c.column_name)
select analysis, input, mapped from input left join (select * from ranked where nth = 1) using (analysis, input)""",
}
