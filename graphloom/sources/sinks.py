"""Sinks: bundles of tables with a manifest, published by one atomic pointer; spreadsheets of small tables; event logs and reports."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import merge


def _fs(spark: SparkSession, path: str):
    """Spark's own file system for a path, whatever the store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file over another in one step."""
    jvm = spark.sparkContext._jvm
    fs, Path = _fs(spark, target)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(Path(source)), fs.makeQualified(Path(target)), over)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, Path = _fs(spark, path)
    out = fs.create(Path(path), True)
    out.write(bytearray(text.encode()))
    out.close()


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, sha256): equal for equal rows in any order; each row is hashed as JSON, and the hashes are added up."""
    h = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(8)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", *parts), 256).alias("sha256"))


def write_bundle(tables: dict[str, DataFrame], path: str, **notes: str) -> dict[str, dict]:
    """Each table as Parquet under path, and manifest.json with the rows and the digest of each, and notes."""
    found = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        found[name] = table_digest(df.sparkSession.read.parquet(f"{path}/{name}")).first().asDict()
    spark = next(iter(tables.values())).sparkSession
    _write_text(spark, f"{path}/manifest.json", json.dumps({"tables": found, **notes}, sort_keys=True))
    return found


def checked_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that a bundle's manifest names, or an error if one doesn't fit its digest."""
    manifest = json.loads(spark.read.option("wholetext", True).text(f"{path}/manifest.json").first()[0])
    out = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    for name, df in out.items():
        if table_digest(df).first().asDict() != manifest["tables"][name]:
            raise ValueError(f"{name} doesn't fit the manifest of {path}")
    return out


def export_reviewed(drafts: dict[str, DataFrame], formal: dict[str, DataFrame], issues: DataFrame, path: str) -> bool:
    """Whether the gate is passed: drafts and issues are always written; formal tables only if no issue is an error, and those of an earlier export go if one is."""
    spark = issues.sparkSession
    passed = issues.where("severity = 'error'").isEmpty()
    fs, Path = _fs(spark, path)
    if not passed:
        for name in formal:
            fs.delete(Path(f"{path}/{name}"), True)
    write_bundle({**drafts, "quality": issues, **(formal if passed else {})}, path, gate="passed" if passed else "blocked")
    return passed


def read_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def publish(tables: dict[str, DataFrame], root: str, blockers: DataFrame, run_id: str | None = None) -> str:
    """Writes a run beside the others and turns ``current.json`` to it at the end; a failure leaves the pointer. Blockers stop it first."""
    spark = blockers.sparkSession
    first = blockers.limit(5).collect()
    if first:
        raise ValueError("not published: " + ", ".join(f"{r['code']} {r['object_id']}" for r in first))
    run = run_id or uuid.uuid4().hex
    fs, Path = _fs(spark, root)
    staging, final = f"{root}/.staging-{run}", f"{root}/{run}"
    try:
        write_bundle(tables, staging)
        if fs.exists(Path(final)) or not fs.rename(Path(staging), Path(final)):
            raise ValueError(f"run {run} is there already")
    except Exception:
        if fs.exists(Path(staging)):
            fs.rename(Path(staging), Path(f"{root}/.failed-{run}"))
        raise
    _write_text(spark, f"{root}/.current-{run}", json.dumps({"run": run}))
    _replace(spark, f"{root}/.current-{run}", f"{root}/current.json")
    return final


def write_document(doc: dict[str, DataFrame], keys: dict[str, str], path: str, revision: int) -> None:
    """A review document's tables and the baseline of all their fields, under one export id: the document's fingerprint."""
    values = None
    for name, df in doc.items():
        if name in keys:
            v = merge.fields(df.select(*(F.col(c) if t == "string" else (F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string")).alias(c) for c, t in df.dtypes)), name, keys[name], [c for c in df.columns if c != keys[name]])
            values = v if values is None else values.unionByName(v)
    export = merge.fingerprint(values).first()["fingerprint"][:24]
    write_bundle({**doc, "import_baseline": merge.baseline(values, export, revision)}, path)


def column_letters(k: int) -> str:
    letters = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        letters = chr(65 + r) + letters
    return letters


def workbook(sheets: dict[str, tuple[list[str], list[tuple]]], hidden: tuple[str, ...] = ()) -> bytes:
    """A spreadsheet file of small sheets: (headings, rows) by name. Lists and structs are JSON cells."""
    cell = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=lambda x: x.asDict(True)) if not isinstance(v, (int, float)) or isinstance(v, bool) else repr(v)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names))) + "</Types>")
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        state = lambda n: ' state="hidden"' if n in hidden else ""
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}"{state(n)} r:id="r{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        for i, (headings, rows) in enumerate(sheets.values()):
            lines = (f'<row r="{r + 1}">' + "".join(f'<c r="{column_letters(k)}{r + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(cell(v))}</t></is></c>' for k, v in enumerate(row)) + "</row>" for r, row in enumerate([tuple(headings), *rows]))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(lines) + "</sheetData></worksheet>")
    return out.getvalue()


#: Rows of a sheet; a table with more belongs in a bundle.
SHEET_ROWS = 100_000


def write_workbook(tables: dict[str, DataFrame], path: str, hidden: tuple[str, ...] = ()) -> None:
    """Small tables as one spreadsheet; more than SHEET_ROWS rows are an error."""
    sheets = {}
    for name, df in tables.items():
        rows = df.limit(SHEET_ROWS + 1).collect()
        if len(rows) > SHEET_ROWS:
            raise ValueError(f"{name} has more than {SHEET_ROWS} rows")
        sheets[name] = (df.columns, [tuple(r) for r in rows])
    spark = next(iter(tables.values())).sparkSession
    fs, Path = _fs(spark, path)
    part = f"{path}.part-{uuid.uuid4().hex}"
    out = fs.create(Path(part), True)
    out.write(bytearray(workbook(sheets, hidden)))
    out.close()
    _replace(spark, part, path)


def append_events(events: DataFrame, path: str, secrets: tuple[str, ...] = ("message",)) -> None:
    """Appends events as JSON lines, with secrets taken out of their texts."""
    events.withColumns({c: T.redacted(F.col(c)) for c in secrets if c in events.columns}).write.mode("append").json(path)


def quality_markdown(issues: DataFrame, per_rule: int = 20) -> str:
    """A report by severity and rule; each rule with its count and its first objects."""
    order = {"error": 0, "warning": 1, "info": 2}
    place = F.row_number().over(Window.partitionBy("severity", "code").orderBy("object_id"))
    first = issues.select("severity", "code", "object_id").distinct().withColumn("k", place).where(F.col("k") <= per_rule).groupBy("severity", "code").agg(F.array_sort(F.collect_list("object_id")).alias("first"))
    rows = issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n")).join(first, ["severity", "code"]).collect()
    lines = ["# Quality report"]
    for severity in order:
        found = sorted((r for r in rows if r["severity"] == severity), key=lambda r: r["code"])
        lines.append(f"\n## {severity} ({sum(r['n'] for r in found)})")
        lines += [f"{i}. {r['code']} ({r['n']}): {', '.join(r['first'])}" for i, r in enumerate(found, 1)]
    return "\n".join(lines) + "\n"


def layer_mapping_json(layers: DataFrame, edges: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row of JSON: counts by layer and scope, and how many edges lacked an end."""
    by = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))).scalar().alias(c)
    return dropped.agg(F.count(F.lit(1)).alias("dropped")).select(F.to_json(F.struct(by(layers, "layer"), by(edges, "scope"), "dropped")).alias("value"))


def inline_json(text: str) -> str:
    """JSON that may stand in a page's script."""
    return text.replace("</", "<\\/").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
