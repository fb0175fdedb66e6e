import hashlib

from pyspark.sql import functions as F

from volspark.llm import warc

BIG = "z" * 150
ROWS = [(3, "http://a.org/x", BIG), (1, "http://b.org/y", BIG), (2, None, BIG), (4, "http://a.org/x", "short"), (5, "http://a.org/x", "short"), (6, "no scheme", None), (7, "https://É.com/ä?q", "é" * 60), (8, "http://h.org/\nX: 1", "\r\n\r\nWARC/1.1"), (9, "", "")]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, offset string, record string")


def test_round_trip(spark):
    p = _pages(spark, ROWS)
    captures = warc.write_archives(p, archive_bytes=300)
    assert captures.select("file").distinct().count() > 1
    index = warc.build_index(captures, block_rows=2, part_rows=4)
    found = warc.lookup(index, captures.select("url_key", "page_id", "record"))
    rows = {int(r["record"]): r for r in warc.read_records(found).collect()}
    assert set(rows) == {r[0] for r in ROWS}
    for i, _, html in ROWS:
        raw = (html or "").encode()
        r = rows[i]
        assert r["payload_bytes"] == len(raw) and r["digest"] == hashlib.sha256(raw).hexdigest()
        if i in (2, 3):
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("revisit", "1", b"")
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, raw)


def test_lookup_of_absent_keys(spark):
    captures = warc.write_archives(_pages(spark, ROWS))
    index = warc.build_index(captures, block_rows=2)
    wanted = spark.createDataFrame([("aaa", 1, "1"), ("org,b)/y", 1, "1"), ("zzz", 1, "1"), ("org,b)/y", 2, "1")], "url_key string, page_id long, record string")
    assert [r["record"] for r in warc.lookup(index, wanted).collect()] == ["1"]


def test_empty_table(spark):
    captures = warc.write_archives(_pages(spark, ROWS).limit(0))
    index = warc.build_index(captures)
    assert warc.read_records(warc.lookup(index, captures.select("url_key", "page_id", "record"))).count() == 0


def test_null_and_repeated_ids(spark):
    captures = warc.write_archives(_pages(spark, [(None, "http://a.org", BIG), (5, "http://a.org", "x"), (5, "http://a.org", "x")]))
    index = warc.build_index(captures)
    assert warc.read_records(warc.lookup(index, captures.select("url_key", "page_id", "record"))).count() == 3


def test_surt(spark):
    d = spark.createDataFrame([("http://a.Example.org/x?y#z",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in d.select(warc.surt(F.col("u"))).collect()] == ["org,example,a)/x?y#z", "nothing", ""]


def test_repeated_id_with_two_payloads(spark):
    other = "y" * 160
    captures = warc.write_archives(_pages(spark, [(5, "http://a.org", BIG), (5, "http://a.org", other), (6, "http://a.org", other), (7, "http://a.org", None)]))
    assert captures.select("record").distinct().count() == 4
    index = warc.build_index(captures, block_rows=2)
    rows = warc.read_records(warc.lookup(index, captures.select("url_key", "page_id", "record"))).collect()
    want = [(5, hashlib.sha256(t.encode()).hexdigest(), len(t), "response", None) for t in (BIG, other)]
    want += [(6, want[1][1], 160, "revisit", "5"), (7, hashlib.sha256(b"").hexdigest(), 0, "response", None)]
    assert sorted((r["page_id"], r["digest"], r["payload_bytes"], r["record_type"], r["refers_to"] or "") for r in rows) == sorted((*w[:4], w[4] or "") for w in want)


def test_equal_rows_have_one_response(spark):
    rows = [(5, "http://a.org", BIG)] * 3 + [(5, None, BIG), (6, "http://b.org", BIG), (-7, "http://c.org", "y" * 120), (-7, "http://d.org", "y" * 120), (8, "http://e.org", "s"), (8, "http://e.org", "s"), (None, "x", BIG)]
    captures = warc.write_archives(_pages(spark, rows))
    back = warc.read_records(warc.lookup(warc.build_index(captures), captures.select("url_key", "page_id", "record"))).collect()
    assert len(back) == len({r["record"] for r in back}) == len(rows)
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in back)
    assert got == sorted([("5", "response", "None", 150), *[("5", "revisit", "5", 150)] * 3, ("6", "revisit", "5", 150), ("-7", "response", "None", 120), ("-7", "revisit", "-7", 120), *[("8", "response", "None", 1)] * 2, ("None", "revisit", "5", 150)])
    assert sorted(len(r["payload"]) for r in back) == [0, 0, 0, 0, 0, 0, 1, 1, 120, 150]


def test_rows_without_an_id_revisit_the_least_id(spark):
    rows = [(3, "http://a.org", BIG), (None, "http://b.org", BIG), (5, "http://c.org", BIG), (None, "x", "y" * 120), (None, "x", "y" * 120)]
    captures = warc.write_archives(_pages(spark, rows))
    back = warc.read_records(warc.lookup(warc.build_index(captures), captures.select("url_key", "page_id", "record"))).collect()
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in back)
    # of the second payload no row has an id to refer to
    assert got == sorted([("3", "response", "None", 150), ("None", "revisit", "3", 150), ("5", "revisit", "3", 150), *[("None", "response", "None", 120)] * 2])


def test_a_page_of_many_megabytes(spark):
    big = "ä<p>" * 2_000_000
    captures = warc.write_archives(_pages(spark, [(1, "http://a.org", big), (2, "http://b.org", big), (3, "http://c.org", "s")]))
    back = {r["page_id"]: r for r in warc.read_records(warc.lookup(warc.build_index(captures), captures.select("url_key", "page_id", "record"))).collect()}
    assert back[1]["payload_bytes"] == back[2]["payload_bytes"] == len(big.encode()) and bytes(back[1]["payload"]) == big.encode()
    assert back[2]["refers_to"] == "1" and back[2]["digest"] == hashlib.sha256(big.encode()).hexdigest()
