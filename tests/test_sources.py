import hashlib
import zipfile

import numpy as np
import pytest
from weftspark.sources import binary, sinks, tables


def test_tsv(spark, tmp_path):
    (tmp_path / "e.tsv").write_bytes("﻿onset\ttrial_type\n1.0\tgo\n2.0\t\n3.0\tn/a\n".encode())
    got = tables.indexed_tsv(spark, str(tmp_path / "e.tsv")).orderBy("event_index").collect()
    assert [(r["onset"], r["trial_type"], r["event_index"]) for r in got] == [("1.0", "go", 0), ("2.0", "", 1), ("3.0", "n/a", 2)]


def test_sidecars(spark, tmp_path):
    (tmp_path / "a_eeg.json").write_text('{"TaskName": "read", "SamplingFrequency": 256, "Other": 1}')
    (tmp_path / "b_eeg.json").write_text("not json")
    got = {r["path"].rsplit("/", 1)[1]: r for r in tables.sidecars(spark, str(tmp_path)).collect()}
    assert got["a_eeg.json"]["TaskName"] == "read" and got["a_eeg.json"]["SamplingFrequency"] == "256" and got["a_eeg.json"]["error"] is None
    assert got["b_eeg.json"]["error"] == "not json"


def test_inventory(spark, tmp_path):
    (tmp_path / "sub-01").mkdir()
    (tmp_path / "sub-01" / "x.TSV").write_text("a")
    (tmp_path / "sub-01" / "y.eeg").write_bytes(b"123")
    got = tables.inventory(spark, str(tmp_path))
    assert {(r["extension"], r["size_bytes"], r["is_signal"], bool(r["sha256"])) for r in got.collect()} == {(".tsv", 1, False, True), (".eeg", 3, True, False)}
    assert [r["subject"] for r in tables.subjects(got).collect()] == ["sub-01"]


def test_npy(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [(r["row_index"], r["values"]) for r in binary.npy(spark, str(tmp_path)).orderBy("row_index").collect()] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si><si><t>row one</t></si></sst>")
        cells = '<c r="A1" t="s"><v>0</v></c><c r="A2"><v>1</v></c><c r="B2"><v>9</v></c><c r="A3" t="s"><v>1</v></c><c r="A4"/><c r="A5"><v>3.5</v></c><c r="A6" t="b"><v>1</v></c>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row>{cells}</row></sheetData></worksheet>")
    got = [(r["excel_row"], r["value"], r["value_kind"]) for r in binary.workbook(spark, str(tmp_path)).orderBy("excel_row").collect()]
    assert got == [(2, "1", "int"), (3, "row one", "str"), (5, "3.5", "float"), (6, "true", "bool")]


def test_brainvision(spark, tmp_path):
    (tmp_path / "r.vhdr").write_text("Brain Vision Data Exchange Header File Version 1.0\n; text\n[Common Infos]\nDataFile=r.eeg\nDataOrientation=MULTIPLEXED\nNumberOfChannels=2\nSamplingInterval=3906.25\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=Fz,,0.5,uV\nCh2=Cz,,,uV\n")
    np.arange(12, dtype="<i2").tofile(tmp_path / "r.eeg")
    blocks = binary.brainvision(spark, str(tmp_path), 4)
    assert sorted((r["block"], r["start_sample"], r["rate"], len(r["data"])) for r in blocks.collect()) == [(0, 0, 256.0, 4), (1, 4, 256.0, 2)]
    got = {(r["sample"], r["channel"]): r["value"] for r in binary.as_signal(blocks).collect()}
    assert got[(5, 0)] == 5.0 and got[(5, 1)] == 11.0 and len(got) == 12


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 0.5), ("a", "a", 1.0), ("b", "a", 0.5), ("b", "b", 1.0)], "x string, y string, rho double")
    assert [tuple(r) for r in sinks.matrix(df, "x", "y", "rho", ["a", "b"]).collect()] == [("a", "1.00000000", "0.50000000"), ("b", "0.50000000", "1.00000000")]
    sinks.csv(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="exist"):
        sinks.csv(df, str(tmp_path / "o"))
    assert tables.csv(spark, str(tmp_path / "o")).count() == 4
    assert '"é"' in sinks.summary_json(spark.createDataFrame([("é", {"s": 1.0})], "name string, by map<string,double>"))
    assert sinks.markdown(df, "T", "rho", 1).count("|") == 12


def test_inventory_reads_only_what_it_hashes(spark, tmp_path):
    (tmp_path / "a.Json").write_text("{}")
    (tmp_path / "b.eeg").write_bytes(b"x" * 10)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "c.txt").write_text("no")
    got = tables.inventory(spark, str(tmp_path))
    assert {(r["extension"], bool(r["sha256"])) for r in got.collect()} == {(".json", True), (".eeg", False)}
    assert {bool(r["sha256"]) for r in tables.inventory(spark, str(tmp_path), hash_all=True).collect()} == {True}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("content") == plan.split("LeftOuter", 1)[1].count("content")  # the listing has no content


def test_slices_of_a_recording(spark, tmp_path):
    head = "Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nDataFile={0}.eeg\nDataOrientation={1}\nNumberOfChannels=2\nSamplingInterval=3906.25\n[Binary Infos]\nBinaryFormat=IEEE_FLOAT_32\n[Channel Infos]\nCh1=Fz,,0.5,uV\nCh2=Cz,,,uV\n"
    x = np.arange(40, dtype="<f4").reshape(20, 2)
    for name, order, data in (("m", "MULTIPLEXED", x), ("v", "VECTORIZED", x.T)):
        (tmp_path / f"{name}.vhdr").write_text(head.format(name, order))
        np.ascontiguousarray(data).tofile(tmp_path / f"{name}.eeg")
    assert {(r["rate"], tuple(r["channels"])) for r in binary.headers(spark, str(tmp_path)).collect()} == {(256.0, ("Fz", "Cz"))}
    for start, stop in ((0, None), (3, 11), (8, 9), (25, None)):
        got = binary.as_signal(binary.brainvision(spark, str(tmp_path), 4, start, stop)).collect()
        want = [(s, c, float(x[s, c] * (0.5, 1)[c])) for s in range(start, min(20, stop or 20)) for c in range(2)]
        for stem in "mv":
            assert sorted((r["sample"], r["channel"], r["value"]) for r in got if r["stem"].endswith(stem)) == want


def test_lenient_tables(spark, tmp_path):
    assert tables.lenient_tsv(spark, str(tmp_path / "none.tsv"), ["a", "b"]).count() == 0
    (tmp_path / "e.tsv").write_bytes(b"a\tb\n1\t\xff\n")
    assert tables.lenient_tsv(spark, str(tmp_path / "e.tsv"), ["a"]).first()["a"] == "1"
    assert tables.lenient_tsv(spark, str(tmp_path / "e.tsv"), ["c"]).columns == ["c"]


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), -1.0], f"é{i}") for i in range(20)], "row long, v array<double>, t string")
    parts = sorted(tuple(r) for r in sinks.npy(df, str(tmp_path / "m"), "row", "v", 3).collect())
    files = sorted((tmp_path / "m").glob("*.npy"))
    assert len(files) == len(parts) and sum(p[2] for p in parts) == 20
    assert np.concatenate([np.load(x) for x in files]).tolist() == [[float(i), -1.0] for i in range(20)]
    sinks.texts_json(df, str(tmp_path / "t"), "row", "t")
    assert {r["t"] for r in spark.read.json(str(tmp_path / "t")).collect()} == {f"é{i}" for i in range(20)}
    sinks.csv(df.select("row", "t"), str(tmp_path / "c"), bom=True)
    assert next((tmp_path / "c").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbfrow,t")
    text = sinks.report("R", df.selectExpr("count(*) as files"), spark.createDataFrame([("ok", "true")], "check string, value string"), {"First": (df.select("row", "t"), "row")}, 5)
    assert "- files: 20" in text and "- ok: true" in text and text.count("| é") == 5


@pytest.mark.parametrize("split", ["40", "97", "1000", "100000"])
def test_rows_are_numbered_wherever_files_are_split(spark, tmp_path, split):
    rng = np.random.default_rng(3)
    want = {}
    for k, n in enumerate((500, 1, 0, 37)):
        rows = [b"\t".join((str(i).encode(), b"" if i % 7 == 0 else bytes(rng.choice([0x61, 0xFF, 0xC3, 0xE6, 0x20], int(rng.integers(1, 20))).astype(np.uint8).tolist()) + b"x")) for i in range(n)]
        (tmp_path / f"{k}.tsv").write_bytes((b"\xef\xbb\xbf" if k % 2 == 0 else b"") + b"\n".join([b"onset\tvalue", *rows]) + b"\n" * (k % 2))
        want |= {(f"{k}.tsv", i): str(i) for i in range(n)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = tables.indexed_tsv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r["path"].rsplit("/", 1)[1], r["event_index"]): r["onset"] for r in got} == want and len(got) == len(want)


def test_files_of_any_size_are_hashed(spark, tmp_path):
    """Three sparse gigabytes, a block at a time."""
    with open(tmp_path / "large one.bdf", "wb") as f:
        f.truncate(3 << 30)
    (tmp_path / "small.bdf").write_bytes(b"abc")
    zeros, block = hashlib.sha256(), bytes(1 << 24)
    for _ in range(192):
        zeros.update(block)
    got = {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["size_bytes"], r["sha256"]) for r in tables.inventory(spark, str(tmp_path), hash_all=True).collect()}
    assert got == {"large one.bdf": (3 << 30, zeros.hexdigest()), "small.bdf": (3, hashlib.sha256(b"abc").hexdigest())}


def test_matrices_by_ranges(spark, tmp_path):
    x = np.arange(2 * 3 * 50, dtype=np.int16).reshape(50, 3, 2)
    np.save(tmp_path / "c.npy", x)
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    np.save(tmp_path / "one.npy", np.arange(5.0))
    np.save(tmp_path / "none.npy", np.zeros((0, 4)))
    got = {(r["path"].rsplit("/", 1)[1], r["row_index"]): r["values"] for r in binary.npy(spark, str(tmp_path), block=64).collect()}
    flat = x.reshape(50, -1).tolist()
    assert got == {(n, i): flat[i] for n in ("c.npy", "f.npy") for i in range(50)} | {("one.npy", i): [float(i)] for i in range(5)}
    assert sorted(r["row_index"] for r in binary.npy(spark, str(tmp_path), "c.npy", 7, 12).collect()) == [7, 8, 9, 10, 11]


def test_a_slice_of_a_matrix_over_two_gigabytes(spark, tmp_path):
    n, width = 40_000, 8_192
    with open(tmp_path / "large.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (n, width)})
        at = f.tell()
        f.seek(at + (n - 2) * width * 8)
        f.write(np.full(2 * width, 7.0).tobytes())
    got = binary.npy(spark, str(tmp_path), start=n - 3).orderBy("row_index").collect()
    assert [(r["row_index"], len(r["values"]), sum(r["values"])) for r in got] == [(n - 3, width, 0.0), (n - 2, width, 7.0 * width), (n - 1, width, 7.0 * width)]


def test_objects_are_refused(spark, tmp_path):
    np.save(tmp_path / "o.npy", np.array([{"a": 1}], object), allow_pickle=True)
    with pytest.raises(Exception, match="matrix of numbers"):
        binary.npy(spark, str(tmp_path)).collect()
