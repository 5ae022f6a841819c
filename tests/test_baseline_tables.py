import re

from pyspark.sql import functions as F

from quotelens.operators import baselines
from quotelens.operators.ordered import exact_quantiles, null_safe_join


def test_medians_by_combination_are_those_by_row(spark):
    """distinct keys are looked up once, not every row once per model; repeated and missing ids and keys stay."""
    rows = [(None if i == 5 else i // 2, None if i % 9 == 0 else f"p{i % 4}", f"f{i % 3}", "s" if i % 2 else "w", None if i % 10 == 0 else float(i * i % 37)) for i in range(80)]
    frame = spark.createDataFrame(rows, "rfq_id bigint, a string, b string, segment string, target double")
    train, others = frame.where("rfq_id < 25"), frame.where("rfq_id is null or rfq_id >= 25").unionByName(spark.createDataFrame([(99, "new", None, "s", 1.0)], frame.schema))
    sets = {"by_a": ("a",), "by_a_b": ("a", "b")}
    got = baselines.group_medians(train, others, sets, "target", ["segment"])
    overall = exact_quantiles(train, [], "target", {"m": 0.5}).head()["m"]
    for name, keys in sets.items():
        table = exact_quantiles(train, keys, "target", {"m": 0.5})
        wanted = null_safe_join(others, table, keys, "left").select("segment", "rfq_id", "target", F.coalesce("m", F.lit(overall)))
        found = got.where(F.col("model_name") == name).select("segment", "rfq_id", "actual", "prediction")
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, wanted.collect())))
    assert re.search(r"Aggregate \[a#\d+, b#\d+\]", got._jdf.queryExecution().optimizedPlan().toString())
