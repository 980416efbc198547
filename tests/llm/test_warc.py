import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from careloom.llm import warc

PAGES = [
    (1, "http://a.org/x", "<p>same</p>"), (2, "http://b.org/y", "<p>same</p>"), (3, None, "<p>other\r\n\r\n</p>"), (4, "http://c/\nInjected: 1", None),
    (5, "u", ""), (6, "é", "ü" * 70000), (None, "n", "<p>same</p>"), (2, "http://b.org/y", "<p>same</p>"), (7, "only", "WARC/1.1\r\n\r\n"),
]


def archived(spark, least=0, pages=PAGES):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    folder = warc.archive_folder(spark)
    index = warc.write_archives(warc.with_revisits(df, least_bytes=least), folder)
    return folder, index, warc.read_records(index, folder)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    _, index, read = archived(spark)
    got = read.collect()
    assert len(got) == len(PAGES) and all(r["intact"] for r in got)
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((p or -1, len((h or "").encode()), digest(h)) for p, _, h in PAGES)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert (1, "revisit", 2) in kinds and (2, "response", None) in kinds and (None, "revisit", 2) in kinds
    assert (4, "revisit", 5) in kinds and (5, "response", None) in kinds  # a null payload is an empty one
    full = {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert full[3] == b"<p>other\r\n\r\n</p>" and full[6] == ("ü" * 70000).encode()


def test_least_size_of_revisits(spark):
    got = archived(spark, least=1)[2].collect()
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] == 0)


def test_members_stand_where_the_index_says(spark, tmp_path):
    folder, index, _ = archived(spark)
    for r in index.collect():
        store, path = warc.file_system(f"{folder}/archives/{r['file']}")
        with store.open_input_file(path) as f:
            raw = gzip.decompress(f.read_at(r["length"], r["offset"]))
        fields, _ = warc.parse(raw)
        assert fields["WARC-Payload-Digest"] == f"sha1:{r['payload_digest']}" and fields["WARC-Type"] == r["record_type"]
        assert "Injected" not in fields


def test_revisits_name_their_response(spark):
    folder, index, _ = archived(spark)
    read, fields = {}, []
    for r in index.collect():
        store, path = warc.file_system(f"{folder}/archives/{r['file']}")
        with store.open_input_file(path) as f:
            fields.append(warc.parse(gzip.decompress(f.read_at(r["length"], r["offset"])))[0])
        read[fields[-1]["WARC-Record-ID"]] = fields[-1]
    revisits = [f for f in fields if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 3
    for f in revisits:
        other = read[f["WARC-Refers-To"]]
        assert other["WARC-Type"] == "response" and other["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
        assert (other["WARC-Target-URI"], other["WARC-Date"], other["Page-ID"]) == (f["WARC-Refers-To-Target-URI"], f["WARC-Refers-To-Date"], f["Page-Refers-To"])
    again, index, _ = archived(spark)
    assert index.count() == len(PAGES) and len(read) == len(PAGES) - 1  # a row that repeats another has its id


def test_selected_records_only(spark):
    folder, index, _ = archived(spark)
    got = warc.read_records(index.filter("page_id in (3, 6)"), folder).collect()
    assert sorted(r["page_id"] for r in got) == [3, 6]


def test_coalesced_ranges():
    import pandas as pd

    far = warc.GAP_BYTES + 1
    records = pd.DataFrame({"offset": [0, 10, 30 + far, 40 + far], "length": [10, 20, 10, 10]})
    assert [len(x) for x in warc.coalesced(records)] == [2, 2]


def test_empty_table(spark):
    assert archived(spark, pages=[])[2].count() == 0
