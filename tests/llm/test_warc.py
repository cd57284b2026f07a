import duckdb

from tessera.llm import warc

SCHEMA = "record_id bigint, url string, ts bigint, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>, u string, span bigint"


def run(spark, rows, **more):
    return {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, SCHEMA), **more).collect()}


def test_latest_earlier_response_and_headers(spark):
    rows = [
        (1, "http://www.A.example/x/?b=2&a=1&utm_source=q#f", 100, "response", 200, '"1"', None, None, {"ETag": '"1"', "Content-Type": "text/html", "Cache-Control": "no"}, "clash", 0),
        (2, "https://a.example:443/x?a=1&b=2", 200, "response", 200, '"2"', "monday", "d", {"Content-Length": "5", "Vary": "x"}, "clash", 0),
        (3, "http://a.example/x?b=2&a=1", 300, "revisit", 304, 'W/"2"', None, None, {"content-length": "0", "vary": "y", "Date": "now"}, None, None),
        (4, "http://a.example/x?a=1&b=2", 150, "revisit", 304, '"2"', None, None, None, None, None),
        (5, "http://a.example/x?a=1&b=2", 90, "revisit", 304, '"1"', None, None, {"Date": "d"}, None, None),
        (6, "http://a.example/x?a=1&b=2", 400, "revisit", 304, None, "tuesday", "d", None, None, None),
        (7, "http://a.example/x?a=1&b=2", 500, "revisit", 304, None, None, None, None, None, None),
        (8, None, 500, "revisit", 304, None, None, None, None, None, None),
        (9, "http://a.example/x?a=1&b=2", None, "revisit", 304, None, None, None, None, None, None),
        (10, "http://a.example/x?a=1&b=2", 450, "response", 404, '"9"', None, None, None, None, None),
    ]
    for parts in (1, 3, 50):
        out = run(spark, rows, parts=parts)
        assert (out[3].outcome, out[3].original_id) == ("resolved", 2)
        assert out[3].headers == {"content-length": "5", "vary": "y", "date": "now"}
        assert (out[4].outcome, out[4].original_id) == ("mismatch", 1)
        assert (out[5].outcome, out[5].original_id, out[5].headers) == ("no_original", None, {"date": "d"})
        assert out[6].outcome == "mismatch" and out[7].outcome == "unverified" and out[7].original_id == 2
        assert out[8].outcome == out[9].outcome == "no_original"
        assert len(out) == 7


def test_ties_repeats_and_empty(spark):
    rows = [(2, "http://a/x", 5, "response", 200, None, None, None, None, None, None), (3, "http://a/x", 5, "revisit", 304, None, None, None, None, None, None), (1, "http://a/x", 5, "revisit", 304, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows + [rows[1]], SCHEMA)
    out = sorted((r.record_id, r.outcome) for r in warc.resolve(frame).collect())
    assert out == [(1, "no_original"), (3, "unverified"), (3, "unverified")]
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_header_names_and_ports(spark):
    rows = [
        (1, "https://a/x", 5, "response", 200, None, None, "d", {"Date": "one", "date": "two", "Vary": None, "X": "y"}, None, None),
        (2, "HTTPS://A:443/x", 6, "revisit", 304, None, None, "d", {"DATE": "three", "Date": "four"}, None, None),
        (3, "http://a:443/x", 7, "revisit", 304, None, None, None, {}, None, None),
        (4, "https://a:80/x", 8, "revisit", 304, None, None, None, None, None, None),
        (5, "http://a:80/x", 9, "revisit", 304, None, None, None, None, None, None),
    ]
    out = run(spark, rows)
    assert out[2].outcome == "resolved" and out[2].headers == {"date": "four", "vary": None, "x": "y"}
    assert [out[k].canonical_url for k in (3, 4, 5)] == ["a:443/x", "a:80/x", "a/x"]
    assert [out[k].original_id for k in (3, 4, 5)] == [None, None, 1] and out[5].headers["date"] == "two"


def test_crowded_url(spark):
    """Many captures of one URL in one second are dealt out, and resolved as brute force does."""
    rows = [(k, "http://hot/", 100 + k // 500, "response" if k % 37 == 5 else "revisit", 200, str(k), None, None, None, None, None) for k in range(2000)]
    out = run(spark, rows, parts=16)
    last = None
    for k in range(2000):
        if k % 37 == 5:
            last = k
        else:
            assert out[k].original_id == last


def test_every_outcome_and_sql(spark):
    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{d}/pages.parquet')")
    own = warc.op1_warc(spark, d)
    expected = sorted(db.execute(f"SELECT {', '.join(own.columns)} FROM ({warc.OP1_SQL})").fetchall())
    assert sorted(tuple(r) for r in own.collect()) == expected
    assert {r[3] for r in expected} == {"resolved", "mismatch", "unverified", "no_original"}
    assert len({r[4] for r in expected if r[4] is not None}) > 1.5 * len({r[1] for r in expected})
