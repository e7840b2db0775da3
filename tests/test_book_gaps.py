"""book_once and duplicate_fills against their SQL where deliveries lack a symbol, a quantity or a number."""
import duckdb
import pandas as pd

from tickloom.plans import ORACLES, QUERIES


def test_books_equal_their_sql_where_values_are_missing(spark, tmp_path):
    rows = [(1, 1, None, 4.0), (1, 2, 7, 5.0), (2, 1, 8, None), (2, 2, 9, 6.0), (3, None, 5, 1.0), (3, 1, 6, 2.0), (4, None, 5, 3.0), (None, 1, 4, 9.0), (50001, 1, 3, 8.0),
            (5, 1, None, 2.0), (6, 1, 2, None), (50006, 1, 2, None)]
    d = pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"])
    d = d.assign(l_partkey=1, l_extendedprice=1.0, l_discount=0.0, l_tax=0.0, l_returnflag=["N", "R", None] * 4, l_linestatus="O", l_shipdate=pd.Timestamp("1996-01-01"))
    d.astype({"l_orderkey": "Int64", "l_suppkey": "Int64", "l_linenumber": "Int32", "l_shipdate": "datetime64[us]"}).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    key = lambda r: [(x is None, x) for x in r]
    for name in ("book_once", "duplicate_fills"):
        want = sorted(con.execute(ORACLES[name]).fetchall(), key=key)
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=key) == want, name
    con.close()
