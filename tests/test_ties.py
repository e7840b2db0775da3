"""Rows that the SQL's order leaves equal come in one order, whatever the layout of the files."""
import pandas as pd

from tickloom.plans import QUERIES


def test_book_once_takes_the_first_row_of_the_files(spark, tmp_path):
    (tmp_path / "lineitem.parquet").mkdir()
    row = lambda supplier, qty: {"l_orderkey": 1, "l_partkey": 1, "l_suppkey": supplier, "l_linenumber": 1, "l_quantity": qty, "l_extendedprice": 1.0, "l_discount": 0.0,
                                 "l_tax": 0.0, "l_returnflag": "N", "l_linestatus": "O", "l_shipdate": pd.Timestamp("1996-01-01")}
    out = lambda name, rows: pd.DataFrame(rows).astype({"l_linenumber": "int32", "l_shipdate": "datetime64[us]"}).to_parquet(tmp_path / "lineitem.parquet" / name)
    out("a.parquet", [row(5, 7.0), row(6, 8.0)])
    out("b.parquet", [row(9, float(q)) for q in range(10, 9000)])                   # the larger file is read first
    got = QUERIES["book_once"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(5, 7.0)]


def test_brief_lines_orders_equal_alerts_by_event(spark, tmp_path):
    n = 200
    d = pd.DataFrame({"event_id": range(n - 1, -1, -1), "ts": pd.Timestamp("2024-01-01 10:00"), "user_id": 1, "event_type": "a", "value": [50.5 if i % 2 else 49.5 for i in range(n - 1, -1, -1)], "props": "{}"})
    d.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    got = QUERIES["brief_lines"](spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.line for r in got] == ["a +0.50 {}" if i % 2 else "a -0.50 {}" for i in range(n)]
