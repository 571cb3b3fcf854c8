import hashlib
import io
import zipfile

import pytest

from voltrace import config
from voltrace.operators import reports
from voltrace.sources import readers, sinks, staging
from voltrace.streaming.incremental import build_pending


def workbook() -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = (
        f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="AB2"><v>4.5</v></c></row></sheetData></worksheet>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Other" r:id="r1"/><sheet name="Ratings" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="none.xml"/><Relationship Id="r2" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>call_id</t></si><si><r><t>to</t></r><r><t>ne</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", sheet)
    return out.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    found = readers.read_workbook(spark, f"{tmp_path}/a.xlsx", "Ratings").orderBy("row_no").collect()
    assert found[0]["cells"] == ["call_id", "", "tone"] and found[1]["cells"][0] == "x" and found[1]["cells"][27] == "4.5"
    with pytest.raises(ValueError):
        list(readers.workbook_rows(workbook(), "Missing"))


def test_csv_keeps_the_na_marker(spark, tmp_path):
    (tmp_path / "a.csv").write_text("call_id,tone\n01,NA\n02,\n")
    found = readers.read_csv(spark, f"{tmp_path}/a.csv", ["call_id", "tone"]).collect()
    assert [tuple(r) for r in found] == [("01", "NA"), ("02", "")]
    with pytest.raises(ValueError):
        readers.read_csv(spark, f"{tmp_path}/a.csv", ["other"])
    assert readers.read_documented(spark, f"{tmp_path}/none.csv").collect() == []


def test_json_and_folders(spark, tmp_path):
    (tmp_path / "y.json").write_text('{"7": {"input": "a", "label": 1}, "8": {"input": "b"}}')
    found = {r["id"]: (r["input"], r["label"]) for r in readers.read_json_records(spark, f"{tmp_path}/y.json", "input string, label int").collect()}
    assert found == {"7": ("a", 1), "8": ("b", None)}
    for name, lines in (("20200102_ABC", "one\n\n two \n"), ("20201399_BAD", "x\n"), ("odd", "x\n")):
        folder = tmp_path / "corpus" / name
        folder.mkdir(parents=True)
        (folder / "text.txt").write_text(lines)
        (folder / "features.csv").write_text("a,len\n1,2.5\n2,none\n3,1\n")
    rows = readers.read_folder_texts(spark, f"{tmp_path}/corpus").orderBy("line_no").collect()
    assert [(str(r["date"]), r["ticker"], r["sentence"]) for r in rows] == [("2020-01-02", "ABC", "one"), ("2020-01-02", "ABC", "two")]
    sums = readers.read_folder_numbers(spark, f"{tmp_path}/corpus", "len").collect()
    assert [(r["ticker"], r["n_rows"], r["total"]) for r in sums] == [("ABC", 3, 3.5)]


def test_manifests_find_changes(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for n in "abc":
        (root / n).write_bytes(n.encode())
    from pyspark.sql import functions as F

    files = readers.list_files(spark, f"{root}")
    assert {r["sha256"] for r in files.collect()} == {hashlib.sha256(n.encode()).hexdigest() for n in "abc"}
    listed = staging.stage(sinks.build_manifest(files, F.lit("u"), "none", "2020-01-01"), "manifest")
    assert sinks.verify_manifest(listed, f"{root}").collect() == []
    (root / "a").write_bytes(b"other")
    (root / "b").unlink()
    assert sorted((r["path"][-1], r["problem"]) for r in sinks.verify_manifest(listed, f"{root}").collect()) == [("a", "checksum_mismatch"), ("b", "missing")]


def test_tables_and_runs(spark, tmp_path):
    df = spark.createDataFrame([(3, "b", float("nan")), (1, "a", 2.0)], "id long, t string, x double")
    sinks.write_table(df, f"{tmp_path}/t", ["id"], id_column="id", files=1)
    got = readers.read_table(spark, f"{tmp_path}/t")
    assert [tuple(r) for r in got.collect()] == [("1", "a", 2.0), ("3", "b", None)]
    assert [r["id"] for r in readers.first_keys(got, "id", 1).collect()] == ["1"]
    bars = spark.createDataFrame([("A", "2020-01-01", 1.0, 1.0, 1.0, 1.0, None), ("A", "2020-01-02", None, 1.0, 1.0, 1.0, 5)], "ticker string, date string, open double, high double, low double, close double, volume long")
    sinks.write_prices(readers.clean_bars(bars), f"{tmp_path}/p")
    assert [(r["ticker"], r["volume"]) for r in readers.read_prices(spark, f"{tmp_path}/p", ["A"]).collect()] == [("A", 0)]
    sinks.write_run(df, df, f"{tmp_path}/run")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_run(df, df, f"{tmp_path}/run")
    with pytest.raises(ValueError):
        sinks.write_run(df.where("false"), df, f"{tmp_path}/run2")
    merged = sinks.merge_sources(spark.createDataFrame([("A", "x"), ("B", "x")], "ticker string, source string"), spark.createDataFrame([("B", "y"), ("C", "y")], "ticker string, source string"))
    assert {r["ticker"]: r["source"] for r in merged.collect()} == {"A": "x", "B": "y", "C": "y"}


def test_reports(spark):
    cells = spark.createDataFrame([("har_x", 3, 0.5, 0.01), ("har_x", 7, -0.2, 0.5), ("b", 3, None, None)], "model string, horizon int, r2_oos double, p double")
    grid = reports.report_grid(cells, ["model"], (3, 7), p="p")
    assert {tuple(r) for r in grid.collect()} == {("har_x", "0.500*", "-0.200"), ("b", "—", "—")}
    assert "| har_x | 0.500* | -0.200 |" in reports.render_markdown(grid, "T") and r"har\_x & 0.500* & -0.200 \\" in reports.render_latex(grid, "a & b")
    from pyspark.sql import functions as F

    labels = cells.select(reports.suffix_label(F.col("model"), {"x": "short", "r_x": "long"}).alias("l")).collect()
    assert [r["l"] for r in labels] == ["long", "long", "b"]


def test_resumed_builds_do_each_key_once(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "id long, x double"
    build = lambda df: df.selectExpr("id", "x * 2 AS y")
    for part in ([(1, 1.0), (2, 2.0)], [(2, 9.0), (3, 3.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        build_pending(spark, source, schema, f"{tmp_path}/out", "id", build, f"{tmp_path}/ck")
    assert sorted((r["id"], r["y"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 2.0), (2, 4.0), (3, 6.0)]


def test_configurations():
    c = config.load_config('{"name": "a", "dataset": "d", "target": {"horizons": [3, 30]}}')
    assert c.target.horizons == (3, 30) and config.config_hash(c) == config.config_hash(config.load_config('{"dataset": "d", "name": "a", "target": {"horizons": [3, 30]}}'))
    for bad in ('{"name": "a"}', '{"name": "a", "dataset": "d", "extra": 1}', '{"name": "a", "dataset": "d", "split": {"embargo": 5}}', '{"name": "a", "dataset": "d", "target": {"kind": "z"}}', "[1]"):
        with pytest.raises(config.ConfigError):
            config.load_config(bad)
