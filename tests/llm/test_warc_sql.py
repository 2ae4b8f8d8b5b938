import duckdb


def test_sql_says_the_same_of_repeated_rows_and_null_ids(spark):
    from turnframe.llm.warc import OP6_SQL, op6_warc

    rows = [(2, "u", "same"), (2, "u", "same"), (1, "v", "same"), (None, "w", "x"), (None, "w", "x"), (None, "w", "same"), (5, None, None), (6, "z", ""), (7, "z", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted((tuple(r[c] for c in columns) for r in op6_warc(df).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = sorted((tuple(r) for r in con.sql(OP6_SQL).select(*columns).fetchall()), key=repr)
    assert got == want
    assert sum(r[3] == "response" for r in got) == 4
