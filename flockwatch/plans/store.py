"""Projects on disk: a catalog, one input table each, outputs as Parquet, exports in other formats."""

from __future__ import annotations

import io
import json
import tempfile
import time
import zipfile
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from xml.sax.saxutils import escape

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slug
from ..operators.rows import renamed
from ..scratch import filesystem

STORAGE_VERSION = 1
#: How long a change of the catalog may take; older locks are left over.
LOCK_SECONDS = 30
XLSX_ROWS = 1_048_576


@dataclass(frozen=True)
class Project:
    id: str
    display_name: str


class VersionError(RuntimeError):
    """The catalog was written by another version."""


class Files:
    """Plain file operations where Spark reads and writes: any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def exists(self, path: str) -> bool:
        at, fs = filesystem(self.spark, path)
        return fs.exists(at)

    def read(self, path: str) -> str:
        at, fs = filesystem(self.spark, path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, new: bool = False) -> None:
        """`new` fails where there is such a file."""
        at, fs = filesystem(self.spark, path)
        stream = fs.create(at, not new)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def make(self, path: str) -> None:
        at, fs = filesystem(self.spark, path)
        fs.mkdirs(at)

    def drop(self, path: str) -> None:
        at, fs = filesystem(self.spark, path)
        fs.delete(at, True)

    def age(self, path: str) -> float:
        at, fs = filesystem(self.spark, path)
        return time.time() - fs.getFileStatus(at).getModificationTime() / 1000

    def move(self, source: str, to: str) -> None:
        """Also from one file system to another; what is there goes."""
        from_, fs = filesystem(self.spark, source)
        at, other = filesystem(self.spark, to)
        other.delete(at, True)
        other.mkdirs(at.getParent())
        jvm = self.spark.sparkContext._jvm
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, from_, other, at, True, self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(from_):
            raise OSError(f"{source} was not moved")

    def names(self, path: str) -> list[str]:
        """What a folder holds, sorted; nothing if there is none."""
        at, fs = filesystem(self.spark, path)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


class Store:
    """A data directory, wherever Spark can write. The catalog is guarded by a lock file for the time of each change."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, str(root).rstrip("/"), Files(spark)
        self.files.make(self.root)
        with self._locked():
            docs = self._read()
            versions = [d["version"] for d in docs if d["class_"] == "version"]
            if versions and versions[0] != STORAGE_VERSION:
                raise VersionError(f"the catalog has version {versions[0]}, not {STORAGE_VERSION}")
            if not versions:
                self._write([*docs, {"class_": "version", "version": STORAGE_VERSION}])

    @contextmanager
    def _locked(self):
        lock = f"{self.root}/db.lock"
        for _ in range(int(LOCK_SECONDS * 20)):
            try:
                self.files.write(lock, "", new=True)
                break
            except Py4JJavaError:  # someone else has it
                with suppress(Py4JJavaError):  # it may be gone by now
                    if self.files.age(lock) > LOCK_SECONDS:  # whoever made it is gone
                        self.files.drop(lock)
                time.sleep(0.05)
        else:
            raise TimeoutError(f"{lock} is held")
        try:
            yield
        finally:
            self.files.drop(lock)

    def _read(self) -> list[dict]:
        path = f"{self.root}/db.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else []

    def _write(self, docs: list[dict]) -> None:
        self.files.write(f"{self.root}/db.json.new", json.dumps(docs))
        self.files.move(f"{self.root}/db.json.new", f"{self.root}/db.json")

    def _project(self, id: str) -> str:
        return f"{self.root}/projects/{id}"

    def create(self, display_name: str, data: DataFrame | str) -> Project:
        """A project of a DataFrame, or of a Parquet path that is moved in."""
        with self._locked():
            docs = self._read()
            taken = {d["id"] for d in docs if d["class_"] == "project"}
            base = id = slug(display_name)
            n = 0
            while id in taken:
                n += 1
                id = f"{base}_{n}"
            self._write([*docs, {"class_": "project", "id": id, "display_name": display_name}])
        into = f"{self._project(id)}/input.parquet"
        if isinstance(data, str):
            self.files.move(data, into)
        else:
            data.write.parquet(into)
        return Project(id, display_name)

    def projects(self) -> list[Project]:
        found = [Project(d["id"], d["display_name"]) for d in self._read() if d["class_"] == "project"]
        return sorted(found, key=lambda p: p.display_name)

    def input(self, id: str, n: int | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self._project(id)}/input.parquet")
        return df if n is None else df.limit(n)

    def row_count(self, id: str) -> int:
        return self.input(id).count()

    def _analysis(self, project: str, analysis: str) -> str:
        return f"{self._project(project)}/analyzers/{analysis}"

    def _outputs(self, project: str, analysis: str, secondary: str | None) -> str:
        at = self._analysis(project, analysis)
        return f"{at}/primary_outputs" if secondary is None else f"{at}/secondary_outputs/{secondary}"

    def save(self, project: str, analysis: str, outputs: dict[str, DataFrame], secondary: str | None = None) -> None:
        for id, df in outputs.items():
            df.write.mode("overwrite").parquet(f"{self._outputs(project, analysis, secondary)}/{id}.parquet")

    def load(self, project: str, analysis: str, output: str, secondary: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self._outputs(project, analysis, secondary)}/{output}.parquet")

    def analyses(self, project: str) -> list[str]:
        """Analyses that have outputs."""
        return [a for a in self.files.names(f"{self._project(project)}/analyzers") if self.outputs(project, a)]

    def secondaries(self, project: str, analysis: str) -> list[str]:
        return self.files.names(f"{self._analysis(project, analysis)}/secondary_outputs")

    def outputs(self, project: str, analysis: str) -> list[tuple[str | None, str]]:
        """(secondary or None, output): those of the primary first."""
        return [
            (s, name.removesuffix(".parquet"))
            for s in (None, *self.secondaries(project, analysis))
            for name in self.files.names(self._outputs(project, analysis, s))
            if name.endswith(".parquet")
        ]

    def export(self, project: str, analysis: str, output: str, extension: str, labels: dict[str, str] | None = None, secondary: str | None = None) -> str:
        """Write an output in another format under its columns' names for readers; returns the path."""
        df = renamed(self.load(project, analysis, output, secondary), labels or {})
        return write_file(df, f"{self._analysis(project, analysis)}/exports/{export_name(output, secondary)}", extension)

    def state_dir(self, project: str, analysis: str, presenter: str) -> str:
        at = f"{self._analysis(project, analysis)}/web_presenters/{presenter}/state"
        self.files.make(at)
        return at


def export_name(output: str, secondary: str | None = None) -> str:
    return output if secondary in (None, output) else f"{secondary}__{output}"


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as comma-joined text, for formats without lists."""
    return df.select(*[F.array_join(F.col(f"`{f.name}`").cast("array<string>"), ",").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_file(df: DataFrame, base: str, extension: str) -> str:
    """parquet, csv, json (an array of rows) or xlsx; ValueError for others.

    Parquet is written by all tasks. The other formats are one file: CSV by one task, JSON
    and XLSX by the driver, which sees a partition at a time.
    """
    path, files = f"{base}.{extension}", Files(df.sparkSession)
    if extension == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif extension == "csv":
        folder = f"{path}.parts"
        _flat(df).coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(folder)
        part = next(n for n in files.names(folder) if n.startswith("part-") and n.endswith(".csv"))
        files.move(f"{folder}/{part}", path)
        files.drop(folder)
    elif extension in ("json", "xlsx"):
        with tempfile.TemporaryDirectory() as own:
            made = f"{own}/made"
            _write_json(df, made) if extension == "json" else _write_xlsx(_flat(df), made)
            files.move(f"file://{made}", path)
    else:
        raise ValueError(f"unsupported format: {extension}")
    return path


def _write_json(df: DataFrame, path: str) -> None:
    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(lines.toLocalIterator()):
            f.write(("," if i else "") + row[0])
        f.write("]")


def _cell(value, place: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{place}"><v>{value!r}</v></c>'
    clean = "".join(c for c in str(value) if c >= " " or c in "\t\n\r")
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _write_xlsx(df: DataFrame, path: str) -> None:
    """A workbook of one sheet; ValueError beyond the format's rows."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as raw:
            f = io.TextIOWrapper(raw, encoding="utf-8")
            f.write(f'{head}<worksheet xmlns="{main}"><sheetData>')
            for r, row in enumerate(_rows(df), 1):
                if r > XLSX_ROWS:
                    raise ValueError(f"a sheet holds at most {XLSX_ROWS} rows")
                f.write(f'<row r="{r}">' + "".join(_cell(v, f"{_letters(k)}{r}") for k, v in enumerate(row)) + "</row>")
            f.write("</sheetData></worksheet>")
            f.flush()


def _rows(df: DataFrame):
    yield tuple(df.columns)
    yield from map(tuple, df.toLocalIterator())
