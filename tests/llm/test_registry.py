import duckdb

from folioquery.llm import registry

SF = "/root/testdata/sf0.001"


def test_queries_are_numbered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) == {"op3_chat_format", "op10_url_filter", "op13_exact_dedup"}


def test_queries_equal_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in registry.oracle_sql().items():
        out = registry.queries()[name](spark, SF)
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(out.columns)
        assert sorted(tuple(r) for r in out.select(*names).collect()) == sorted(got.fetchall())
