import hashlib
from collections import defaultdict

import pytest
from llm_helpers import empty, frame

from quotelens.llm import sharding


def brute(rows, limit):
    """Split buckets from the root, one bit at a time."""
    bits = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest()[:10], 16))[2:].zfill(40) for i, _ in rows}
    out, todo = {}, [("", [(i, len((t or "").encode())) for i, t in rows])]
    while todo:
        prefix, held = todo.pop()
        total = sum(n for _, n in held)
        if total <= limit:
            out |= {i: (prefix, total) for i, _ in held}
        else:
            todo += [(prefix + b, part) for b in "01" if (part := [x for x in held if bits[x[0]].startswith(prefix + b)])]
    return out


@pytest.mark.parametrize("limit", [60, 400, 10_000])
def test_only_oversized_buckets_split(spark, limit):
    rows = [(i, "x" * (i % 40)) for i in range(300)] + [(1000, None), (1001, "é" * 20)]
    found = sharding.assign_shards(frame(spark, rows, clash=("shard", "depth")), limit).collect()
    assert {r.doc_id: (r.shard, r.shard_bytes) for r in found} == brute(rows, limit)
    assert all(len(r.shard) == r.depth and not r.oversized for r in found)


def test_equal_keys_null_keys_and_large_rows(spark):
    rows = [(7, "same")] * 50 + [(None, "null one")] * 9 + [(None, None), (8, "y" * 500), (8, "y" * 500), (9, "z")]
    found = sharding.assign_shards(frame(spark, rows), 20).collect()
    assert len(found) == len(rows)
    size = defaultdict(int)
    for r in found:
        size[r.shard] += r.n_bytes
        assert r.oversized == (r.n_bytes > 20)
    assert all(size[r.shard] == r.shard_bytes and (r.shard_bytes <= 20 or r.oversized) for r in found)
    assert sharding.assign_shards(empty(spark)).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = frame(spark, [(i, "x" * 10) for i in range(100)])
    sharding.write_shards(docs, str(tmp_path / "out"), limit=200)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.groupBy("shard").sum("n_bytes").where("`sum(n_bytes)` > 200").isEmpty()


def test_columns_with_names_of_working_columns_are_kept(spark):
    names = ("_hash", "_bytes", "_cell", "_prefix", "_place", "_n", "_leaf")
    rows = [(i, "x" * (i % 40)) for i in range(100)] + [(5, "same")] * 30 + [(200, "y" * 900)]
    found = sharding.assign_shards(frame(spark, rows, clash=names), 60)
    assert found.columns[5:12] == list(names)
    got = found.collect()
    assert len(got) == len(rows) and all(r[n] == "x" for r in got for n in names)
