import __spark_entry__ as entry


def test_sql_is_text_of_registered_queries():
    have = entry.queries()
    for name, sql in entry.oracle_sql().items():
        assert name in have and isinstance(sql, str), name
