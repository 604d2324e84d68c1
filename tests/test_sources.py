import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.operators import rules
from graphloom.sources import readers, sinks
from graphloom.streaming import events


def test_json_records_become_drafts(spark, tmp_path):
    point = {"display_name": "Sum", "knowledge_type": "rule", "relations": [{"target_node_id": "x", "relation_type": "support", "review_status": "approved"}, {"target_node_id": "", "relation_type": "explains"}]}
    record = {"source_id": "s", "subject": "Math", "grade": "G7", "term": "t1", "raw_structure": {"chapters": [{"chapter": "ch1", "title": "Numbers", "knowledge_points": [point]}]}}
    (tmp_path / "a.json").write_text(json.dumps({"records": [record]}))
    (tmp_path / "b.json").write_text(json.dumps([record | {"source_id": "s2"}]))
    d = readers.drafts(readers.json_records(spark, str(tmp_path)))
    got = sorted((r.source_id, r.node_id, r.node_type, r.parent_id) for r in d.collect())
    assert got[:2] == [("s", "math_g7_t1_ch1_numbers", "container", ""), ("s", "math_g7_t1_ch1_sum", "rule", "math_g7_t1_ch1_numbers")] and len(got) == 4
    assert [tuple(r)[1:4] for r in readers.draft_relations(d.where("source_id = 's'")).collect()] == [("x", "explains", "accepted")]
    (tmp_path / "c.json").write_text(json.dumps([{"source_id": "s"}]))
    with pytest.raises(Exception, match="lacks"):
        readers.json_records(spark, str(tmp_path / "c.json")).collect()


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Pages /Type /Page (Hello \\(1\\)) Tj /Type /Page (World) Tj")
    chunk = struct.pack(">II", 2, 3)
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + chunk + b"\x08\2\0\0\0" + struct.pack(">I", zlib.crc32(b"x")))
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x0b\x08" + struct.pack(">HH", 2, 3) + b"\1\1\x11\0")
    f = readers.files(spark, str(tmp_path))
    (pdf,) = readers.pdf_pages(f).collect()
    assert (pdf.page_count, pdf.text) == (2, "Hello (1)\nWorld")
    assert sorted((r.kind, r.width, r.height) for r in readers.image_sizes(f).collect()) == [("jpeg", 3, 2), ("png", 2, 3)]
    ranges = spark.createDataFrame([(1, 2, "first part")], "first int, last int, label string")
    assert readers.page_ranges(readers.pdf_pages(f), ranges).first().range_id == "_p1_p2_first_part"
    with pytest.raises(Exception, match="bounds"):
        readers.page_ranges(readers.pdf_pages(f), spark.createDataFrame([(1, 3, "")], "first int, last int, label string")).collect()


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 1.5), ("b & <c>", [], 2.0)], "id string, tags array<string>, w double")
    path = str(tmp_path / "w.xlsx")
    sinks.write_workbook({"nodes": df}, path, hidden=("nodes",))
    files = spark.read.format("binaryFile").load(path)
    cells = readers.sheets(files, "nodes")
    got = readers.typed(cells, {"id": "string", "tags": "array<string>", "w": "double", "none": "int"})
    assert sorted(map(tuple, got.collect())) == [("a", ["x", "y"], 1.5, None), ("b & <c>", [], 2.0, None)]
    assert readers.sheets(files, "none").count() == 0


def test_publish_is_all_or_nothing(spark, tmp_path):
    root, t = f"file://{tmp_path}/pub", {"nodes": spark.range(3)}
    none = spark.createDataFrame([], "code string, object_id string")
    sinks.publish(t, root, none, "r1")
    with pytest.raises(ValueError, match="not published"):
        sinks.publish(t, root, spark.createDataFrame([("edge_self_loop", "a")], "code string, object_id string"), "r2")
    with pytest.raises(Exception):
        sinks.publish({"nodes": spark.range(1).select(F.raise_error(F.lit("boom")).cast("int").alias("x"))}, root, none, "r3")
    assert json.loads((tmp_path / "pub/current.json").read_text()) == {"run": "r1"}
    assert json.loads((tmp_path / "pub/r1/manifest.json").read_text())["tables"]["nodes"]["rows"] == 3
    sinks.publish(t, root, none, "r4")
    assert json.loads((tmp_path / "pub/current.json").read_text()) == {"run": "r4"}
    assert sinks.checked_bundle(spark, f"{root}/r1")["nodes"].count() == 3
    spark.range(4).write.mode("overwrite").parquet(f"{root}/r1/nodes")
    with pytest.raises(ValueError, match="manifest"):
        sinks.checked_bundle(spark, f"{root}/r1")
    spark.range(3).write.mode("overwrite").parquet(f"{root}/r1/nodes")
    assert sinks.read_bundle(spark, f"{root}/r1", ["nodes"])["nodes"].count() == 3


def test_reviewed_export_has_a_gate(spark, tmp_path):
    path, drafts, formal = f"file://{tmp_path}/out", {"drafts": spark.range(2)}, {"nodes": spark.range(1)}
    issue = lambda severity: spark.createDataFrame([("edge_self_loop", severity, "a")], "code string, severity string, object_id string")
    assert sinks.export_reviewed(drafts, formal, issue("warning"), path) and (tmp_path / "out/nodes").exists()
    assert not sinks.export_reviewed(drafts, formal, issue("error"), path) and not (tmp_path / "out/nodes").exists()
    assert set(sinks.checked_bundle(spark, path)) == {"drafts", "quality"}


def test_compressed_pdf_blocks(spark, tmp_path):
    body = zlib.compress(b"BT /F1 10 Tf 1 0 0 1 50 700 Tm (Hel\\(lo) Tj 0 -20 Td [(W) -80 (orld)] TJ ( ) Tj ET")
    (tmp_path / "z.pdf").write_bytes(b"%PDF-1.5\n1 0 obj << /Type /Page >> endobj\n2 0 obj << /Length " + str(len(body)).encode() + b" /Filter /FlateDecode >> stream\n" + body + b"\nendstream endobj")
    (page,) = readers.pdf_pages(readers.files(spark, str(tmp_path))).collect()
    assert page.text == "Hel(lo\nWorld" and [(b.block_id, b.x, b.y, b.width, b.height) for b in page.blocks] == [("native-1", 50.0, 700.0, 30.0, 10.0), ("native-2", 50.0, 680.0, 25.0, 10.0)]


def test_recorded_models(spark):
    df = spark.createDataFrame([(1, "s", "ok"), (2, "s", "bad")], "batch_id int, system string, user string")

    def client(system, user):
        if user == "bad":
            raise ValueError("no answer")
        return 'text {"nodes":[{"name":"A","confidence":2},{"name":" "}],"local_relation_claims":[{"source_mention":"A","target_mention":"B","relation_type":"support"}]}'

    got = readers.with_model(df, client, "system", "user")
    assert [r.status for r in got.orderBy("batch_id").collect()] == ["ok", "no answer"]
    nodes, claims = readers.staged_payloads(got)
    assert [(r.temporary_id, r.display_name, r.confidence) for r in nodes.collect()] == [("1:node:1", "A", 1.0)]
    assert [(r.claim_id, r.relation_type) for r in claims.collect()] == [("1:claim:1", "explains")]


def test_ocr_and_reports(spark, tmp_path):
    o = spark.createDataFrame([("p", ["a", " "], [0.9, 0.1], [[[1.0, 2.0], [4.0, 6.0]], [[0.0, 0.0], [1.0, 1.0]]])], "page_id string, rec_texts array<string>, rec_scores array<double>, dt_polys array<array<array<double>>>")
    (b,) = readers.ocr_blocks(o).collect()
    assert (b.block_id, b.x, b.y, b.width, b.height) == ("ocr-1", 1.0, 2.0, 3.0, 4.0)
    issues = rules.issue(spark.createDataFrame([("n1",)], "id string"), "edge_self_loop", "id")
    assert "1. edge_self_loop (1): n1" in sinks.quality_markdown(issues)
    sinks.append_events(spark.createDataFrame([("token=abc secret: x1",)], "message string"), str(tmp_path / "log"))
    assert "x1" not in spark.read.json(str(tmp_path / "log")).first().message
    assert sinks.inline_json('{"a":"</script> "}') == '{"a":"<\\/script>\\u2028"}'
    env = tmp_path / ".env"
    env.write_text("# c\nA='1'\nB = 2\nnothing\n")
    assert readers.env_file(str(env)) == {"A": "1", "B": "2"}
    assert readers.app_info(str(tmp_path / "none"), {"name": "x"}) == {"name": "x"}


def test_stream_of_commands(spark, tmp_path):
    spark.createDataFrame([(1, 1, None), (1, 2, 0), (1, 3, 1), (2, 4, None)], "document_id long, command_id long, expected_revision long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id long, command_id long, expected_revision long").parquet(str(tmp_path / "in"))
    q = events.command_revisions(stream).writeStream.format("memory").queryName("revisions").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from revisions").collect())) == [(1, 1, 1, False), (1, 2, 1, True), (1, 3, 2, False), (2, 4, 1, False)]
