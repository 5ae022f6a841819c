import hashlib

from quotelens.llm import warc
from quotelens.llm.common import scratch_folder

PAGES = "page_id long, url string, html string"


def archive(spark, rows, **limits):
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS digest", "'y' AS payload")
    folder = scratch_folder(spark)
    folder = folder if "://" in folder else f"file://{folder}"
    index = warc.write_archives(warc.capture(pages), folder, **{k: v for k, v in limits.items() if k == "file_bytes"})
    return index, folder


def test_round_trip(spark):
    same, short = "<p>" + "s" * 120, "tiny"
    rows = [(5, "http://a/\r\nX: 1", same), (3, None, same), (9, "http://b", same), (1, "u", short), (2, "u", short), (4, "v", None), (6, "v", ""), (7, "w", "é👍" * 40), (None, "n", same), (9, "http://b", same)]
    index, folder = archive(spark, rows, file_bytes=300)
    assert index.select("file").distinct().count() > 1
    found = warc.read_records(index, folder, gap=10, range_bytes=500).collect()
    assert len(found) == len(rows)
    for r in found:
        html = [(h or "").encode() for i, _, h in rows if str(i) == r.record_id or r.record_id == "null" and i is None][0]
        assert r.payload_bytes == len(html) and r.payload_digest == hashlib.sha256(html).hexdigest()
    kinds = {r.record_id: (r.record_type, r.refers_to) for r in found}
    assert kinds["3"] == ("response", None) and kinds["5"] == ("revisit", "3") and kinds["9"] == ("revisit", "3")
    assert all(kinds[k] == ("response", None) for k in ("1", "2", "4", "6", "7", "null"))


def test_a_selection_is_read_alone(spark):
    index, folder = archive(spark, [(i, f"u{i}", f"page {i} " * 30) for i in range(60)])
    chosen = index.where("url in ('u3', 'u40', 'u59')")
    assert sorted(r.record_id for r in warc.read_records(chosen, folder).collect()) == ["3", "40", "59"]


def test_records_parse_and_damage_is_seen():
    whole = warc.record("1", "u", b"body\r\n\r\nmore", "d", None)
    fields, body = warc.parse(whole)
    assert body == b"body\r\n\r\nmore" and fields["WARC-Type"] == "response"
    try:
        warc.parse(whole[:-5])
    except ValueError:
        pass
    else:
        raise AssertionError("a short record went through")


def test_empty_table(spark):
    index, folder = archive(spark, [])
    assert index.count() == 0 and warc.read_records(index, folder).count() == 0
