import http.server
import io
import os
import tarfile
import threading
import wave
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from voltrace.functions import prompts
from voltrace.operators import cohorts, forecasts, reports
from voltrace.operators.returns import n_day_volatility
from voltrace.sources import archives


def test_ewma_of_a_long_series_follows_the_recursion(spark):
    import random

    rng = random.Random(5)
    rets = [0.0 if 3000 < i < 6500 else rng.gauss(0, 0.02) for i in range(30_000)]
    frame = spark.createDataFrame([("A", i, r) for i, r in enumerate(rets)], "ticker string, i int, ret double")
    frame = frame.select("ticker", F.date_add(F.lit("1900-01-01").cast("date"), F.col("i")).alias("date"), "ret")
    found = [r["ewma_var"] for r in forecasts.ewma(frame).orderBy("date").collect()]
    assert len(found) == 30_000 and all(x == x and x is not None for x in found)
    for n in (1, 2, 50, 999, 1100, 2999, 3500, 20_001, 30_000):
        mean = sum(rets[:n]) / n
        s = sum((r - mean) ** 2 for r in rets[:n]) / n
        for r in rets[:n]:
            s = 0.94 * s + 0.06 * r * r
        assert found[n - 1] == pytest.approx(s, rel=1e-9, abs=1e-300)


def test_reasons_come_in_order(spark):
    rows = [(1, False, "", "x", None), (2, True, " ", "x", None), (3, True, "A", "x", None), (4, True, "A", "earnings", None), (5, True, "A", "earnings", "2020-01-01"), (6, None, "A", None, "")]
    found = cohorts.classified_calls(spark.createDataFrame(rows, "call_id int, parsed boolean, ticker string, call_type string, call_date string"))
    assert [(r["reason"], r["status"]) for r in found.orderBy("call_id").collect()] == [
        ("empty_transcript", "excluded"), ("unresolved_ticker", "excluded"), ("non_earnings", "excluded"), ("no_date", "excluded"), ("", "ok"), ("empty_transcript", "excluded"),
    ]


def test_ratings_with_a_problem_stop_the_reader(spark):
    kind = "call_id string, section string, field string, value string"
    good = spark.createDataFrame([("a", "qa", "hedging_intensity", "4"), ("a", "prepared_remarks", "analyst_tone", "NA"), ("a", "qa", "surprise_mentions", "20")], kind)
    assert cohorts.valid_values(good).count() == 3
    for section, field, value in (("qa", "hedging_intensity", "5"), ("qa", "guidance_direction", "up"), ("qa", "analyst_tone", None), ("prepared_remarks", "analyst_tone", "2"), ("intro", "analyst_tone", "2")):
        with pytest.raises(Exception, match=field):
            cohorts.valid_values(spark.createDataFrame([("a", section, field, value)], kind)).collect()


def test_samples_stay_in_train_and_pools_fall_back(spark):
    ids = spark.range(100).withColumnRenamed("id", "call_id")
    train = ids.where("call_id < 40")
    one = {r[0] for r in cohorts.train_sample(train, ids.where("call_id >= 10"), 12, 3).collect()}
    assert len(one) == 12 and all(10 <= i < 40 for i in one)
    assert one == {r[0] for r in cohorts.train_sample(train.repartition(7), ids.where("call_id >= 10"), 12, 3).collect()}
    with pytest.raises(ValueError):
        cohorts.train_sample(train, ids.where("call_id >= 35"), 12, 3)
    assert cohorts.in_pool(ids, train).count() == 40
    assert cohorts.in_pool(ids, ids.where("call_id > 1000")).count() == 100 == cohorts.in_pool(ids, None).count()


def test_each_text_is_encoded_once(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, None)], "i int, text string")
    calls = spark.sparkContext.accumulator(0)

    def encode(some):
        calls.add(len(some))
        return [[len(t), 1] for t in some]

    found, new = cohorts.encode_once(texts, "m", encode)
    assert {r["i"]: r["vector"] for r in found.collect()} == {1: [1, 1], 2: [1, 1], 3: [2, 1], 4: None} and new.count() == 2 == calls.value
    again, newer = cohorts.encode_once(texts, "m", encode, new)
    assert newer.count() == 0 and again.where("vector IS NULL").count() == 1 and calls.value == 2


def test_views_rows_and_escapes(spark):
    views = reports.view_specs(spark, metric=("a", "b"), split=("x", "y"))
    assert [tuple(r) for r in views.orderBy("view").collect()] == [(0, "a", "x"), (1, "a", "y"), (2, "b", "x"), (3, "b", "y")]
    row = reports.result_rows(spark.createDataFrame([("v", 3, 0.5)], "target string, horizon int, mse double"), dataset="d", model="m").first()
    assert (row["dataset"], row["model"], row["mse"], row["seed_std"]) == ("d", "m", 0.5, None) and list(row.asDict()) == list(reports.RESULT_COLUMNS)
    assert reports.tex_escaped("a\\b_{%}") == r"a\textbackslash{}b\_\{\%\}"


def test_n_day_volatility_has_no_zero_for_missing(spark):
    rets = spark.createDataFrame([("A", f"2020-01-{d:02d}", r) for d, r in enumerate([0.1, 0.2, 0.2, 0.2, -0.1], 1)], "ticker string, date string, ret double")
    found = {r["date"]: (r["log_std"], r["log_last"]) for r in n_day_volatility(rets, (2,)).collect()}
    assert found["2020-01-01"] == (None, None) == found["2020-01-04"] and found["2020-01-03"][1] == pytest.approx(-2.302585, abs=1e-5)


def test_prompts(spark):
    row = spark.range(1).select(prompts.model_slug(F.lit("org/a:b")).alias("s"), prompts.section_prompt(F.lit("qa"), F.lit("text"), {"qa": {"tone": "0 to 4"}}).alias("p")).first()
    assert row["s"] == "org__a_b" and row["p"] == "Section: qa\n- tone: 0 to 4\n\nText:\ntext"
    assert prompts.context_extension(65536, 32768)["factor"] == 2.0
    with pytest.raises(ValueError):
        prompts.context_extension(100, 100)


def test_archives_are_unpacked_once_and_whole(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("root/x.txt", "1")
        z.writestr("root/sub/y.txt", "2")
    assert archives.extract(tmp_path / "a.zip", tmp_path / "a") and (tmp_path / "a" / "sub" / "y.txt").read_text() == "2"
    assert not archives.extract(tmp_path / "a.zip", tmp_path / "a")
    with tarfile.open(tmp_path / "b.tgz", "w:gz") as t:
        for name in ("p.txt", "q.txt"):
            info = tarfile.TarInfo(name)
            info.size = 1
            t.addfile(info, io.BytesIO(b"z"))
    assert archives.extract(tmp_path / "b.tgz", tmp_path / "b") and sorted(os.listdir(tmp_path / "b")) == ["p.txt", "q.txt"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.txt", "1")
    with pytest.raises(ValueError):
        archives.extract(tmp_path / "bad.zip", tmp_path / "bad")
    assert not (tmp_path / "bad").exists()


def test_downloads_and_price_files(spark, tmp_path):
    (tmp_path / "A.csv").write_text("close,date,adjClose,volume\n10,2020-01-02T00:00:00,5,100\n11,2020-01-03,,\n,2020-01-04,,7\n12,,6,7\n")
    (tmp_path / "B.csv").write_text("date,close\n")
    handler = type("H", (http.server.SimpleHTTPRequestHandler,), {"__init__": lambda self, *a: http.server.SimpleHTTPRequestHandler.__init__(self, *a, directory=str(tmp_path)), "log_message": lambda *a: None})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    place = f"http://127.0.0.1:{server.server_port}"
    assert archives.download(f"{place}/A.csv", tmp_path / "got" / "A.csv") and not archives.download(f"{place}/A.csv", tmp_path / "got" / "A.csv")
    with pytest.raises(OSError):
        archives.download(f"{place}/none.csv", tmp_path / "got" / "none.csv")
    assert os.listdir(tmp_path / "got") == ["A.csv"]
    found = archives.fetch_prices(spark, ["A", "B"], lambda t: f"{place}/{t}.csv").orderBy("date").collect()
    server.shutdown()
    assert [(r["ticker"], str(r["date"]), r["open"], r["close"], r["volume"]) for r in found] == [("A", "2020-01-02", 5.0, 5.0, 100), ("A", "2020-01-03", 11.0, 11.0, 0)]
    assert archives.closes(archives.price_rows(spark.createDataFrame([("A", None), ("B", "")], "ticker string, text string"))).columns == ["ticker", "date", "close"]


def test_secrets_inventories_and_spot_checks(spark, tmp_path, monkeypatch):
    (tmp_path / "env").write_text("# X=1\nOTHER=2\nX_KEY = 'abc'\n")
    assert archives.read_secret("X_KEY", tmp_path / "env") == "abc" and archives.read_secret("NONE", tmp_path / "env") is None
    monkeypatch.setenv("X_KEY", " own ")
    assert archives.read_secret("X_KEY", tmp_path / "missing") == "own"
    files = spark.createDataFrame([("r/a/text.txt",), ("r/a/features.csv",), ("r/b/text.txt",), ("r/c/x",)], "path string")
    assert tuple(archives.folder_counts(files).first()) == (3, 2, 1)
    assert archives.spot_check(tmp_path, 3, 0) == [f"no .wav files found under {tmp_path}"]
    for name, cut in (("good", None), ("cut", 60)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(b"\0\1" * 500)
        raw = (tmp_path / f"{name}.wav").read_bytes()
        (tmp_path / f"{name}.wav").write_bytes(raw[:cut])
    problems = archives.spot_check(tmp_path, 5, 0)
    assert len(problems) == 1 and problems[0].startswith("cut.wav")


def test_pdf_facts(spark):
    body = zlib.compress(b"BT (Third quarter) Tj (call \\(2020\\)) Tj ET")
    raw = b"%PDF-1.4\n1 0 obj << /Title (Results) /CreationDate (D:20200131120000Z) >>\nstream\n" + body + b"\nendstream\n"
    found = archives.pdf_table(spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(b"x")), ("c", None)], "path string, content binary")).orderBy("path").collect()
    assert (found[0]["title"], str(found[0]["created"]), found[0]["first_text"]) == ("Results", "2020-01-31", "Third quarter call (2020)")
    assert tuple(found[1])[1:] == (None, None, None) == tuple(found[2])[1:]
