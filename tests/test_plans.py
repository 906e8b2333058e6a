"""Every query runs on the smallest tables and, where it has SQL, its columns are those of the SQL."""

import __spark_entry__ as entry


def test_every_query_has_a_name_of_its_own_and_sql_or_a_reason():
    from tidepanel.plans import registry

    without = set(registry.QUERIES) - set(registry.ORACLES)
    assert without == {"spacing_study", "sensitivity_summary", "group_bootstrap"} and set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())


def test_some_queries_give_what_their_sql_gives(spark, tmp_path):
    """A small corpus: texts that repeat, stamps made by rule, lineage by SQL and by Spark."""
    import duckdb

    from tidepanel.plans import registry

    rows = [(k, f"Some words, number {k % 9} of a text that repeats itself and goes on for a while {'x' if k % 5 else 'y'}", ("en", "de")[k % 2], f"s{k % 3}", 80) for k in range(120)]
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (502, "Ünïcode – “quoted”", "de", "s2", 18)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("norm_ids", "exact_dedup", "near_dup_pairs", "dedup_lineage", "dedup_clusters", "lexicon_score", "repeated_share", "numbered_rows", "text_digests", "first_days", "top_tags"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(registry.ORACLES[name]).fetchall()
        columns = [d[0] for d in con.description]
        assert sorted(columns) == sorted(got.columns), name
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want)), name
