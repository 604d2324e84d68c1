"""Sources: structured JSON records, PDF and image files, spreadsheets, recorded model payloads."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

RELATION = "struct<source_node_id string, target_node_id string, relation_type string, confidence double, relation_evidence string, review_status string, relation_id string>"
POINT = f"struct<display_name string, node_name string, knowledge_type string, cognitive_level string, review_status string, confidence double, definition string, prerequisites array<string>, relations array<{RELATION}>>"
RECORD = f"source_id string, source_type string, source_path string, subject string, grade string, term string, raw_text string, source_format string, subject_tags array<string>, raw_structure struct<chapters array<struct<chapter string, title string, knowledge_points array<{POINT}>>>>"
NEEDED = ("source_id", "subject", "grade", "term")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Source records of JSON files, each a list of records or an object with ``records``. A record without its identity is an error; other fields have defaults."""
    raw = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("v"))
    rows = raw.select(F.explode(F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{RECORD}>>")).otherwise(F.from_json("v", f"struct<records array<struct<{RECORD}>>>")["records"])).alias("r")).select("r.*")
    missing = None
    for c in NEEDED:
        m = F.coalesce(F.trim(c), F.lit("")) == ""
        missing = m if missing is None else missing | m
    rows = rows.withColumn("source_id", F.when(missing, F.raise_error(F.lit(f"a record lacks one of {', '.join(NEEDED)}"))).otherwise(F.col("source_id")))
    text = [c for c in ("source_type", "source_path", "raw_text", "source_format") if c in rows.columns]
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in text}).withColumn("subject_tags", T.clean_list(F.col("subject_tags")))


def drafts(records: DataFrame) -> DataFrame:
    """Drafts of records: one accepted container for each chapter, one draft for each of its points.

    (source_id, node_id, node_name, display_name, node_type, chapter, parent_id, review_status,
    confidence, prerequisites, relations, position)
    """
    chapters = records.select("source_id", "subject", "grade", "term", F.posexplode("raw_structure.chapters").alias("c_pos", "c"))
    ident = lambda name: T.node_id(F.col("subject"), F.col("grade"), F.col("term"), F.col("c.chapter"), T.slug(name))
    title = F.when(T.trimmed(F.col("c.title")) != "", T.trimmed(F.col("c.title"))).otherwise(T.trimmed(F.col("c.chapter")))
    none, no_relations = F.array().cast("array<string>"), F.array().cast(f"array<{RELATION}>")
    boxes = chapters.select("source_id", ident(title).alias("node_id"), T.slug(title).alias("node_name"), title.alias("display_name"), F.lit("container").alias("node_type"), F.col("c.chapter").alias("chapter"), F.lit("").alias("parent_id"), F.lit("accepted").alias("review_status"), F.lit(1.0).alias("confidence"), none.alias("prerequisites"), no_relations.alias("relations"), (F.col("c_pos") * 1000).alias("position"))
    points = chapters.select("*", ident(title).alias("parent"), F.posexplode("c.knowledge_points").alias("p_pos", "p")).where(T.trimmed(F.col("p.display_name")) != "")
    name = F.when(T.trimmed(F.col("p.node_name")) != "", T.trimmed(F.col("p.node_name"))).otherwise(T.slug(F.col("p.display_name")))
    own = points.select("source_id", ident(name).alias("node_id"), T.slug(name).alias("node_name"), T.trimmed(F.col("p.display_name")).alias("display_name"), T.node_type(F.col("p.knowledge_type")).alias("node_type"), F.col("c.chapter").alias("chapter"), F.col("parent").alias("parent_id"), T.review_status(F.col("p.review_status")).alias("review_status"), F.coalesce("p.confidence", F.lit(0.8)).alias("confidence"), T.clean_list(F.col("p.prerequisites")).alias("prerequisites"), F.coalesce("p.relations", no_relations).alias("relations"), (F.col("c_pos") * 1000 + F.col("p_pos") + 1).alias("position"))
    return boxes.unionByName(own)


def draft_relations(drafts_: DataFrame) -> DataFrame:
    """(source_id, target_id, relation_type, review_status, confidence, ord) of drafts' relations that have a type and an end."""
    r = drafts_.select("node_id", "position", F.posexplode("relations").alias("k", "r"))
    source = F.when(T.trimmed(F.col("r.source_node_id")) != "", T.trimmed(F.col("r.source_node_id"))).otherwise(F.col("node_id"))
    rows = r.select(source.alias("source_id"), T.trimmed(F.col("r.target_node_id")).alias("target_id"), T.relation_type(F.col("r.relation_type")).alias("relation_type"), T.review_status(F.col("r.review_status")).alias("review_status"), F.coalesce("r.confidence", F.lit(0.8)).alias("confidence"), (F.col("position") * 1000 + F.col("k")).alias("ord"))
    return rows.where("target_id <> '' and relation_type <> ''")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, content) of PDF, PNG and JPEG files; any other suffix is an error."""
    f = spark.read.format("binaryFile").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin("pdf", "png"), suffix).when(suffix.isin("jpg", "jpeg"), "jpeg").otherwise(F.raise_error(F.concat(F.lit("not a PDF or image: "), F.col("path"))))
    return f.select("path", kind.alias("kind"), "content")


_STREAM = re.compile(rb"<<((?:[^<>]|<(?!<)|>(?!>)|<<[^<>]*>>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"(?P<one>\((?:\\.|[^\\()])*\))\s*(?:Tj|')|\[(?P<many>(?:\((?:\\.|[^\\()])*\)|[^\]()])*)\]\s*TJ|/\S+\s+(?P<size>[\d.]+)\s+Tf|(?P<dx>-?[\d.]+)\s+(?P<dy>-?[\d.]+)\s+T[dD]\b|(?P<m>(?:-?[\d.]+\s+){6})Tm\b|(?P<begin>\bBT\b)", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
BLOCK = "array<struct<block_id:string,text:string,x:double,y:double,width:double,height:double>>"


def _pdf_text(raw: bytes) -> str:
    plain = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" and m[1] != b"n" else _ESCAPES.get(m[1], m[1]), raw, flags=re.S)
    return plain.decode("utf-16", "replace") if plain[:2] in (b"\xfe\xff", b"\xff\xfe") else plain.decode("latin-1")


def pdf_blocks_of(content: bytes) -> list[tuple[str, str, float, float, float, float]]:
    """(block_id, text, x, y, width, height) of the strings that a PDF's content streams show, those that are compressed too; blank ones are left out.

    Places come from the text operators; a width is that of average letters of the font's size.
    """
    streams = []
    for m in _STREAM.finditer(content):
        try:
            streams.append(zlib.decompress(m[2]) if b"FlateDecode" in m[1] else m[2])
        except zlib.error:  # an encoding that isn't text, or a stream that is cut off
            continue
    out = []
    for body in (_STREAM.sub(b" ", content), *streams):
        x = y = 0.0
        size = 12.0
        for m in _SHOWN.finditer(body):
            if m["begin"]:
                x = y = 0.0
            elif m["size"]:
                size = float(m["size"])
            elif m["dx"]:
                x, y = x + float(m["dx"]), y + float(m["dy"])
            elif m["m"]:
                x, y = (float(v) for v in m["m"].split()[4:6])
            else:
                text = "".join(_pdf_text(t) for t in _STRING.findall(m["one"] if m["one"] is not None else m["many"]))
                if text.strip():
                    out.append((f"native-{len(out) + 1}", text, max(0.0, x), max(0.0, y), len(text) * size / 2, size))
    return out


def pdf_pages(f: DataFrame) -> DataFrame:
    """(path, page_count, text, blocks) of PDF files: pages counted by their objects, text and blocks from the strings that are shown."""

    @F.pandas_udf(BLOCK)
    def blocks(content: pd.Series) -> pd.Series:
        names = ("block_id", "text", "x", "y", "width", "height")
        return content.map(lambda c: [dict(zip(names, b)) for b in pdf_blocks_of(bytes(c))])

    pages = F.size(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(r"/Type\s*/Page(?![s\w])"), F.lit(0)))
    magic = F.when(F.substring("content", 1, 4) == F.lit(b"%PDF"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("not a PDF: "), F.col("path"))))
    found = f.where("kind = 'pdf'").select(magic.alias("path"), F.greatest(pages, F.lit(1)).alias("page_count"), blocks("content").alias("blocks"))
    return found.select("path", "page_count", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("text"), "blocks")


def page_ranges(pdfs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, range_id, first, last) for each of ranges (first, last, label), the list of a request: in bounds, or an error."""
    wanted = ranges.agg(F.sort_array(F.collect_list(F.struct("first", "last", "label")))).scalar()
    r = pdfs.select("path", "page_count", F.explode(wanted).alias("r")).select("path", "page_count", "r.*")
    bad = (F.col("first") < 1) | (F.col("last") < F.col("first")) | (F.col("last") > F.col("page_count"))
    ident = F.concat(F.lit("_p"), F.col("first").cast("string"), F.lit("_p"), F.col("last").cast("string"), F.when(F.col("label") != "", F.concat(F.lit("_"), T.safe_id_part(F.col("label")))).otherwise(""))
    return r.select(F.when(bad, F.raise_error(F.lit("page range out of bounds"))).otherwise(F.col("path")).alias("path"), ident.alias("range_id"), "first", "last")


def jpeg_size(content: bytes) -> tuple[int, int]:
    """Width and height of a JPEG's frame header; zeros without one."""
    at = 2
    while at + 9 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 + size
    return 0, 0


def image_sizes(f: DataFrame) -> DataFrame:
    """(path, kind, width, height, requires_ocr) of images: a PNG's from its header in place, a JPEG's by its markers."""

    @F.pandas_udf("width int, height int")
    def sizes(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([jpeg_size(bytes(c)) for c in content], columns=["width", "height"])

    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    png = f.where("kind = 'png'").select("path", "kind", number(17).alias("width"), number(21).alias("height"))
    jpeg = f.where("kind = 'jpeg'").select("path", "kind", sizes("content").alias("s")).select("path", "kind", "s.*")
    return png.unionByName(jpeg).withColumn("requires_ocr", F.lit(True))


def column_number(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str) -> Iterator[tuple[int, dict[str, str]]]:
    """(row number, cells by heading) of a workbook's sheet; blank rows are left out."""
    book = zipfile.ZipFile(io.BytesIO(content))
    strip = lambda tag: tag.rpartition("}")[2]
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    ids = {e.get("name"): next(v for k, v in e.items() if strip(k) == "id" and k != "id") for e in root.iter() if strip(e.tag) == "sheet"}
    if sheet not in ids:
        return
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter() if e.get("Id")}
    part = targets[ids[sheet]].removeprefix("/xl/").removeprefix("xl/")
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if strip(t.tag) == "t") for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if strip(si.tag) == "si"]
    heading: list[str] | None = None
    for i, row in enumerate(e for e in ElementTree.fromstring(book.read(f"xl/{part}")).iter() if strip(e.tag) == "row"):
        cells: dict[int, str] = {}
        for c in row:
            value = "".join(t.text or "" for t in c.iter() if strip(t.tag) in ("v", "t"))
            cells[column_number(c.get("r", "A"))] = shared[int(value)] if c.get("t") == "s" and value else value
        if heading is None:
            heading = [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]
        elif any(v.strip() for v in cells.values()):
            yield i, {heading[k]: v for k, v in cells.items() if k < len(heading) and heading[k]}


def sheets(files_: DataFrame, sheet: str) -> DataFrame:
    """(path, row, cells) of a sheet of workbooks (path, content), wherever Spark read them from: ``spark.read.format("binaryFile")``."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i, cells) for p, c in zip(f.path, f.content) for i, cells in sheet_rows(bytes(c), sheet)]
            yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    return files_.select("path", "content").mapInPandas(task, "path string, row int, cells map<string,string>")


def typed(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cells as columns of the types given (DDL); nested ones are parsed as JSON, unknown headings ignored, missing ones null."""
    get = lambda c: F.try_element_at("cells", F.lit(c))
    return cells.select(*((F.from_json(get(c), t) if re.match("array|struct|map", t) else get(c).try_cast(t)).alias(c) for c, t in columns.items()))


def with_model(df: DataFrame, client: Callable[[str, str], str], system: str, user: str) -> DataFrame:
    """df with response: what a client answers to the prompts in two columns; a failure is a row's status, not the job's. The client is made once in each task and may be a table of recorded answers."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers = []
            for s, u in zip(f[system], f[user]):
                try:
                    answers.append((client(s, u), "ok"))
                except Exception as e:  # noqa: BLE001  any client's error belongs to its row
                    answers.append((None, str(e)))
            yield f.assign(response=[a for a, _ in answers], status=[b for _, b in answers])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", response string, status string"
    return df.mapInPandas(task, schema)


def staged_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, claims) of recorded answers (batch_id, response): ids are generated where they lack one, nodes without a name and claims without ends are left out."""
    node = "struct<temporary_id string, display_name string, name string, node_type string, chapter string, section string, definition string, confidence string, evidence_refs array<string>, aliases array<string>>"
    claim = "struct<claim_id string, source_temporary_id string, target_temporary_id string, source_mention string, target_mention string, relation_type string, relation_type_candidate string, confidence string, evidence_refs array<string>>"
    v = T.json_payload(F.col("response")).cast("string")
    p = payloads.select("batch_id", F.from_json(v, f"struct<nodes array<{node}>, local_relation_claims array<{claim}>>").alias("p"))
    ident = lambda c, kind: F.coalesce(F.nullif(T.trimmed(F.col(c)), F.lit("")), F.concat(F.col("batch_id").cast("string"), F.lit(f":{kind}:"), (F.col("pos") + 1).cast("string")))
    n = p.select("batch_id", F.posexplode("p.nodes").alias("pos", "n")).select("*", "n.*")
    n = n.select("batch_id", ident("temporary_id", "node").alias("temporary_id"), F.coalesce(F.nullif(T.trimmed(F.col("display_name")), F.lit("")), T.trimmed(F.col("name"))).alias("display_name"), T.node_type(F.col("node_type")).alias("node_type"), T.trimmed(F.col("chapter")).alias("chapter"), T.trimmed(F.col("section")).alias("section"), T.trimmed(F.col("definition")).alias("definition"), T.clamped(F.col("confidence")).alias("confidence"), T.ordered_unique(F.col("aliases")).alias("aliases"), T.ordered_unique(F.col("evidence_refs")).alias("evidence_refs"), F.col("pos").cast("long").alias("ord"))
    c = p.select("batch_id", F.posexplode("p.local_relation_claims").alias("pos", "c")).select("*", "c.*")
    c = c.select("batch_id", ident("claim_id", "claim").alias("claim_id"), *(T.trimmed(F.col(x)).alias(x) for x in ("source_temporary_id", "target_temporary_id", "source_mention", "target_mention")), T.relation_type(F.coalesce("relation_type_candidate", "relation_type")).alias("relation_type"), T.clamped(F.col("confidence")).alias("confidence"), T.ordered_unique(F.col("evidence_refs")).alias("evidence_refs"), F.col("pos").cast("long").alias("ord"))
    return n.where("display_name <> ''"), c.where("(source_temporary_id <> '' or source_mention <> '') and (target_temporary_id <> '' or target_mention <> '')")


def ocr_blocks(results: DataFrame) -> DataFrame:
    """(page_id, block_id, text, confidence, x, y, width, height, reading_order) of OCR answers (page_id, rec_texts, rec_scores, dt_polys); blank texts are left out."""
    z = results.select("page_id", F.posexplode(F.arrays_zip("rec_texts", "rec_scores", "dt_polys")).alias("pos", "z")).where(T.trimmed(F.col("z.rec_texts")) != "")
    axis = lambda i: F.transform("z.dt_polys", lambda p: p[i])
    xs, ys = axis(0), axis(1)
    return z.select("page_id", F.concat(F.lit("ocr-"), (F.col("pos") + 1).cast("string")).alias("block_id"), T.trimmed(F.col("z.rec_texts")).alias("text"), T.clamped(F.col("z.rec_scores")).alias("confidence"), F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"), F.col("pos").alias("reading_order"))


def env_file(path: str) -> dict[str, str]:
    """KEY=VALUE lines without quotes; comments and other lines are ignored."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, equals, value = line.strip().partition("=")
            if equals and key and not key.startswith("#"):
                out[key.strip()] = value.strip().strip("\"'")
    return out


def app_info(path: str, defaults: dict[str, str]) -> dict[str, str]:
    """Texts of a JSON file over defaults; a file that can't be read, or a field of another kind, leaves the default."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
    except (OSError, ValueError):
        return dict(defaults)
    return {k: got[k] if isinstance(got, dict) and isinstance(got.get(k), str) and got[k].strip() else v for k, v in defaults.items()}

