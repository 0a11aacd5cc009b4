import __spark_entry__ as E


def test_names_match():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and "compare_full" in q
