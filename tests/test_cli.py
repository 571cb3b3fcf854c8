import os

import pytest

from voltrace.__main__ import VERBS, main
from voltrace.plans import catalog

SF = "/root/testdata/sf0.001"


def test_verbs_name_known_queries(capsys):
    assert {n for names in VERBS.values() for n in names} <= set(catalog.QUERIES)
    assert main(["list"]) == 0 and "metric_grid" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nothing", "like", "this"])


def test_a_verb_writes_its_results(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert main(["prices", "coverage", "--tables", SF, "--out", str(tmp_path)], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/coverage_summary").count() == 1
    assert main(["run", "session_calendar", "--tables", SF], spark) == 0
