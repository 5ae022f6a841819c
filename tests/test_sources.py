import json

import pytest

from helpers import dimension, quotes, series
from quotelens import schema as S
from quotelens.sources import readers, sinks


def test_csv_round_trip_with_bad_cells(spark, tmp_path):
    header = ",".join(f.name for f in S.QUOTES.fields)
    good = "q1,P1,AAA|BBB,worst_of,1.0,0.6,6.0,1M,0.25,1000,C,T,2021-01-01,yes,2021-01-02,2022-01-02,12.5"
    bad = "q2,P1,AAA,single,x,0.6,6,1M,inf,1000,C,T,2021-13-01,No,2021-01-02 00:00:00,2022-01-02,"
    path = tmp_path / "quotes.csv"
    path.write_text(f"{header}\n{good}\n{bad}\n", encoding="utf-8")
    rows = {r["rfq_id"]: r for r in readers.read_quotes(spark, str(path)).collect()}
    assert rows["q1"]["no_call_period_months"] == 6 and rows["q1"]["executed"] is True and rows["q1"]["avg_duration_months"] == 12.5
    assert rows["q2"]["autocall_barrier_pct"] is None and rows["q2"]["quoted_implied_vol"] is None
    assert rows["q2"]["requested_date"] is None and str(rows["q2"]["start_date"]) == "2021-01-02" and rows["q2"]["executed"] is False
    path.write_text(f"{header}\n{good.replace('yes', 'maybe')}\n", encoding="utf-8")
    with pytest.raises(ValueError, match="maybe"):
        readers.read_quotes(spark, str(path))


def test_requests_from_json_and_csv_keep_order(spark, tmp_path):
    base = {f.name: None for f in S.REQUEST.fields} | {"product_type": "P1", "underlyings": "AAA", "notional_credits": 5, "requested_date": "2024-01-01"}
    listed = [{**base, "underlyings": name} for name in ("CCC", "AAA", "BBB")]
    (tmp_path / "batch.json").write_text(json.dumps(listed))
    got = readers.read_requests(spark, str(tmp_path / "batch.json")).orderBy("request_ord").collect()
    assert [r["underlyings"] for r in got] == ["CCC", "AAA", "BBB"] and got[0]["notional_credits"] == 5.0
    (tmp_path / "one.json").write_text(json.dumps(listed[0]))
    assert readers.read_requests(spark, str(tmp_path / "one.json")).count() == 1


def test_discovery_skips_empty_and_one_column_files(spark, tmp_path):
    kept = {"quotes.csv": "rfq_id,product\n17,P4\n", "members.csv": "name,sector,weight\nAAA,energy,0.2\nBBB,banks,0.8\n"}
    skipped = {"ids.csv": "rfq_id\n17\n18\n", "blank.csv": "", "readme.md": "# tables\n"}
    for name, content in {**kept, **skipped}.items():
        (tmp_path / name).write_text(content)
    assert sorted(readers.discover_tables(spark, str(tmp_path))) == ["members", "quotes"]


def test_prediction_store_checks(spark, tmp_path):
    stored = spark.createDataFrame([("m", "A", 1.0, 2.0), ("m", "B", 1.0, 2.0), ("n", "A", 1.0, 1.0)], "model_name string, rfq_id string, actual double, prediction double")
    sinks.write_predictions(stored, str(tmp_path / "store"))
    back = sinks.read_predictions(spark, str(tmp_path / "store"))
    expected = spark.createDataFrame([("A",), ("B",)], "rfq_id string")
    sinks.check_predictions(back, expected, ["m"])
    for models in (["n"], ["absent"]):
        with pytest.raises(ValueError):
            sinks.check_predictions(back, expected, models)


def test_fingerprint_ignores_order_but_not_duplicates(spark, tmp_path):
    frame = quotes(spark, {}, {"product_type": "P2"})
    first = sinks.table_fingerprint(frame, "q").head()["fingerprint"]
    assert sinks.table_fingerprint(frame.repartition(5), "q").head()["fingerprint"] == first
    assert sinks.table_fingerprint(frame.union(frame), "q").head()["fingerprint"] != first
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert sinks.file_fingerprints(spark, str(tmp_path)).head()["sha256"].startswith("ba7816bf")
