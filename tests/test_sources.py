import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from riacho.functions import text as T
from riacho.sources import readers, sinks


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives_are_read_by_member_and_tagged(spark, tmp_path):
    head = "CNPJ_CIA;VL_CONTA;EXTRA\n"
    (tmp_path / "a.zip").write_bytes(zipped({"x_DRE_con_1.csv": (head + "1;2,5;é\n").encode("latin-1"), "x_BPP_con_1.csv": "CNPJ_CIA\n9\n", "note.txt": "no"}))
    (tmp_path / "broken.zip").write_bytes(b"PK nonsense")
    members = readers.archive_members(readers.binary_files(spark, str(tmp_path), "*.zip"))
    rows = readers.delimited_members(members, ["CNPJ_CIA", "VL_CONTA", "EXTRA"], tags={"DRE_con": "DRE", "BPP_con": "BPP"})
    got = {(r.table_code, r.CNPJ_CIA, r.VL_CONTA, r.EXTRA) for r in rows.collect()}
    assert got == {("DRE", "1", "2,5", "é"), ("BPP", "9", None, None)}
    one = readers.archive_members(readers.binary_files(spark, str(tmp_path), "a.zip"), largest=True)
    assert [r.member for r in one.collect()] == ["x_DRE_con_1.csv"]


def test_encoding_falls_back(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Nome;Valor\nAção;1\n".encode("latin-1"))
    assert readers.delimited(spark, str(tmp_path / "a.csv")).first().Nome == "Ação"


def test_file_kind_and_docx(spark, tmp_path):
    for name, data in (("a", b"%PDF-1"), ("b", b"\xd0\xcf\x11\xe0x"), ("c", zipped({"word/document.xml": "<w:p>Um &amp; dois</w:p><w:p>três</w:p>"})), ("d", b"text")):
        (tmp_path / name).write_bytes(data)
    files = readers.binary_files(spark, str(tmp_path))
    kinds = {r.path[-1]: r.kind for r in files.select("path", readers.file_kind(F.col("content")).alias("kind")).collect()}
    assert kinds == {"a": "pdf", "b": "doc", "c": "docx", "d": "unknown"}
    text = readers.docx_text(files.filter("endswith(path, 'c')")).select(T.strip_tags(F.col("xml")).alias("t")).first().t
    assert text == "Um & dois\n\ntrês"


def test_legacy_word_pieces():
    stream = bytearray(2048)
    struct.pack_into("<H", stream, 0, 0xA5EC)
    stream[1024:1029] = "Ação ".encode("cp1252")
    stream[1100:1106] = "fim".encode("utf-16-le")
    pieces = struct.pack("<3I", 0, 5, 8) + struct.pack("<HIH", 0, (1024 * 2) | 0x40000000, 0) + struct.pack("<HIH", 0, 1100, 0)
    table = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", stream, 0x1A2, 0, len(table))
    assert readers.legacy_word_text(bytes(stream), table) == "Ação fim"
    assert readers.legacy_word_text(b"\0" * 600, table) is None


def test_json_lines_skip_broken_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{bad\n{"id": 2}\n', encoding="utf-8")
    (tmp_path / "out/b.jsonl").write_text('{"id": 3}\n')
    rows = readers.json_lines(spark, str(tmp_path), "id int, t string", exclude="/out/")
    assert sorted((r.id, r.t) for r in rows.collect()) == [(1, "x"), (2, None)]


def test_frames_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc')], "id int, t string")
    assert readers.frame(spark, sinks.write_table(df, str(tmp_path / "x"))).count() == 1
    assert readers.frame(spark, sinks.write_table(df, str(tmp_path / "y.csv"))).first().id == "1"
    with pytest.raises(ValueError):
        readers.frame(spark, "z.xml")
    with pytest.raises(ValueError):
        readers.require(df, "id", "label")


def test_ledger_tsv_logs_lists(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"Data": {"0": "01/02/2020", "1": None}, "Valor": {"0": 1.5, "1": 2}}))
    rows = {r.row_id: (r.Data, r.Valor) for r in readers.ledger(spark, str(tmp_path / "l.json")).collect()}
    assert rows == {"0": ("01/02/2020", "1.5"), "1": (None, "2")}
    (tmp_path / "t.tsv").write_text("config\ttps\nA\t1.5\nB\tn/a\n")
    assert [r.tps for r in readers.tsv(spark, str(tmp_path / "t.tsv"), ["tps"]).orderBy("config").collect()] == [1.5, None]
    (tmp_path / "run").mkdir()
    (tmp_path / "run/trainer_state.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": 2.0}, {"step": 2, "eval_loss": 1.0}]}))
    assert readers.trainer_logs(spark, str(tmp_path / "run")).count() == 2
    (tmp_path / "e.txt").write_text("# all\n\n http://a \nhttp://b\n")
    assert sorted(r.endpoint for r in readers.endpoints(spark, str(tmp_path / "e.txt")).collect()) == ["http://a", "http://b"]
    (tmp_path / "r.json").write_text('[{"data": "02/01/2020", "valor": "4.5"}, {"data": "x", "valor": "1"}]')
    assert [(str(r.date), r.rate) for r in readers.rates(spark, str(tmp_path / "r.json")).collect()] == [("2020-01-02", 4.5)]
    (tmp_path / "c.yaml").write_text("chunk: 10\n")
    assert readers.load_config(str(tmp_path / "c.yaml")) == {"chunk": 10}


def test_price_history(spark):
    df = spark.createDataFrame([("A", [("02/01/2020", 1.0), ("bad", 2.0)])], "TICKER string, history array<struct<DATA string, PRECO double>>")
    assert [(str(r.date), r.price, r.pos) for r in readers.price_history(df).orderBy("pos").collect()] == [("2020-01-02", 1.0, 0), ("None", 2.0, 1)]


def test_sinks_resume_and_keep_order(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, type string")
    for _ in range(2):
        sinks.append_missing(df, str(tmp_path / "o"), "id")
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    sinks.write_ordered(df, str(tmp_path / "s"), F.desc("id"))
    assert [r.id for r in spark.read.json(str(tmp_path / "s")).collect()][:1]
    sinks.write_json(df, str(tmp_path / "j"), ["type"])
    sinks.write_manifest(df, str(tmp_path / "m"))
    sinks.append_metrics(df, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == spark.read.json(str(tmp_path / "j")).count() == spark.read.json(str(tmp_path / "m")).count() == 2
