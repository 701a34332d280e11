"""Files, archives, logs and sinks, on files written here."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evidra import sinks, sources
from evidra.operators import budgets, grids
from evidra.sources import files
from tests.conftest import DATA

W, S, R = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def packed(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    return packed(**{"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{p("采购公告")}<w:tbl><w:tr>{cell("产品")}{cell("价格")}</w:tr><w:tr>{cell("支架")}{cell("100")}</w:tr></w:tbl>{p("")}{p("end")}</w:body></w:document>'})


def xlsx():
    book = f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="one" sheetId="1" r:id="a"/><sheet name="two" sheetId="2" r:id="b"/></sheets></workbook>'
    rels = '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>'
    one = f'<worksheet xmlns="{S}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>中选价</t></is></c></row><row><c r="B2"><v>00123</v></c></row></sheetData></worksheet>'
    return packed(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>企业</t><t>名称</t></si></sst>', "xl/worksheets/s1.xml": one, "xl/worksheets/s2.xml": f'<worksheet xmlns="{S}"><sheetData/></worksheet>'})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("files")
    csv = "\ufeff一览表,,\n企业名称,产品名称,中选价\n" + "".join(f"公司{i},\"支架, {i}\",{i}\n" for i in range(200))
    inner = packed(**{"deep.csv": "a,b\n1,2\n", "deeper.zip": packed(x=b"1")})
    for name, data in {
        "t.csv": csv.encode(), "n.docx": docx(), "b.xlsx": xlsx(), "bad.docx": b"no zip", "old.doc": b"x", "p.html": "<title>T</title><script>no()</script><p>正文 &nbsp;x".encode(), "e.txt": b" ",
        "z.zip": packed(**{"a/in.txt": "inside", "../out.txt": "no", "i.zip": inner, **{f"f{k:02}.txt": "x" for k in range(20)}}), "latin.csv": b"caf\xe9,1\n",
    }.items():
        (path / name).write_bytes(data)
    return str(path)


def test_files_by_kind(spark, folder):
    got = {(r["file"], r["entry"], r["sheet"]): r for r in files.read_files(spark, folder).collect()}
    status = {k: r["status"] for k, r in got.items()}
    assert got["t.csv", "", "csv"]["n_rows"] == 202 and got["t.csv", "", "csv"]["rows"][2] == ["公司0", "支架, 0", "0"]
    assert got["n.docx", "", None]["text"] == "采购公告\n产品 | 价格\n支架 | 100\nend" and got["n.docx", "", "table0"]["rows"] == [["产品", "价格"], ["支架", "100"]]
    assert got["b.xlsx", "", "one"]["rows"] == [["企业名称", "", "中选价"], ["", "00123"]] and status["b.xlsx", "", "two"] == "empty"
    assert (status["bad.docx", "", None], status["old.doc", "", None], status["e.txt", "", None]) == ("parse_failed", "unsupported", "empty")
    assert got["p.html", "", None]["text"].startswith("T 正文") and "no()" not in got["p.html", "", None]["text"]
    assert (status["z.zip", "a/in.txt", None], status["z.zip", "../out.txt", None], status["z.zip", "f19.txt", None]) == ("parsed_text", "skipped", "skipped")
    assert got["z.zip", "i.zip!deep.csv", "csv"]["rows"] == [["a", "b"], ["1", "2"]] and status["z.zip", "i.zip!deeper.zip", None] == "unsupported"
    assert got["latin.csv", "", "csv"]["rows"] == [["caf\ufffd", "1"]]


def test_headers_of_files(spark, folder):
    cells = files.cells_of(files.read_files(spark, folder, "*.csv")).withColumn("t", F.col("file"))
    got = {r["t"]: (r["header_row"], r["header"][0]) for r in grids.headers(cells, "t", "row_no", "cells").collect()}
    assert got["t.csv"] == (1, "企业名称")


def test_large_files_are_told_by_size(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "MOST_BYTES", 100)
    assert {r["status"] for r in files.read_files(spark, folder, "t.csv").collect()} == {"too_large"}


def test_event_log_with_damage_and_archives(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "event_type", "value").limit(500)
    path, schema = f"file://{tmp_path}/log", "event_id long, user_id long, event_type string, value double"
    assert sinks.append_events(events, path) == 500 and sinks.append_events(events, path) == 0
    more = spark.createDataFrame([(-1, 1, "view", 1.0), (-1, 1, "view", 1.0)], schema)
    assert sinks.append_events(more, path) == 1
    (tmp_path / "log" / "tail.json").write_text(json.dumps({"event_id": -2, "user_id": 1, "event_type": "x", "value": 0.5}) + "\n{\"event_id\": -3, \"us")
    good, n = sinks.quarantine(spark, path, f"file://{tmp_path}/aside", schema)
    assert n == 1 and good.count() == 502 and good.where("event_id = -2").count() == 1
    assert spark.read.json(f"file://{tmp_path}/aside").first()["line"].startswith('{"event_id": -3')


def test_segments_are_bounded(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts", "user_id")
    total = events.count()
    parts = sinks.segmented(events, ["ts", "event_id"], most_events=300, most_bytes=20_000)
    per = parts.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("event_id", "ts", "user_id"))) + 1).alias("b"), F.min("ts").alias("a"), F.max("ts").alias("z")).orderBy("segment").collect()
    assert sum(r["n"] for r in per) == total and all(r["n"] <= 300 for r in per) and all(r["b"] <= 20_200 for r in per)
    assert all(x["z"] <= y["a"] for x, y in zip(per, per[1:]))
    sinks.write_segments(parts, f"file://{tmp_path}/seg", kept=2)
    assert {r["segment"] for r in spark.read.json(f"file://{tmp_path}/seg").select("segment").distinct().collect()} == {per[-2]["segment"], per[-1]["segment"]}


def test_publish_once(spark, tmp_path):
    path = f"file://{tmp_path}/pub"
    rows = lambda *x: spark.createDataFrame(list(x), "run string, sha string")
    told = lambda df: {r["run"]: r["state"] for r in df.collect()}
    assert told(sinks.publish_once(rows(("a", "1")), path, "run", "sha")) == {"a": "published"}
    assert told(sinks.publish_once(rows(("a", "1"), ("b", "2")), path, "run", "sha")) == {"a": "already", "b": "published"}
    assert told(sinks.publish_once(rows(("a", "9")), path, "run", "sha")) == {"a": "conflict"}
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "1"), ("b", "2")]


def test_artifacts_and_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1,\n "t": "x"}')
    (tmp_path / "b.json").write_text("{no")
    got = {r["file"].rsplit("/", 1)[1]: (r["k"], r["damaged"]) for r in sources.artifacts(spark, f"file://{tmp_path}/*.json", "k int, t string").collect()}
    assert got == {"a.json": (1, False), "b.json": (None, True)}
    row = sources.normalised_rows(spark.sql("select timestamp'2026-01-02 03:04:05' t, cast(null as string) s, cast(null as int) n, 1.5d x")).first()
    assert tuple(row) == ("2026-01-02 03:04:05", "", 0, 1.5)


def test_running_totals_of_any_cut(spark):
    rows = spark.range(500).selectExpr("id % 3 g", "id % 17 r", "id k", "id % 5 + 1 s")
    for slots in (1, 4, 64):
        got = budgets.running_total(rows, "g", "r", ["k"], "s", slots=slots).collect()
        for g in range(3):
            total = 0
            for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["r"], r["k"])):
                total += r["s"]
                assert r["running"] == total
