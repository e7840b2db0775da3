"""brief_lines against its SQL where values are missing, not finite or halfway between two hundredths."""
import duckdb
import pandas as pd

from tickloom.plans import ORACLES, QUERIES


def test_brief_lines_equal_their_sql_on_odd_values(spark, tmp_path):
    value = [50.125, 50.375, 51.005, 48.985, 47.325, 50.0, 49.999, None, float("inf"), float("-inf"), 170.5, 30.25, 30.25, 30.25, None]
    kind = ["a", "b", "a", "a", "b", "c", "c", "a", "b", "b", None, None, "a", "a", None]
    props = ["{}", "{}", "p", "q", "r", "{}", "{}", "{}", "{}", "{}", "z", "z", None, "y", "{}"]
    d = pd.DataFrame({"event_id": range(15), "ts": pd.Timestamp("2024-01-01 10:00"), "user_id": 1, "event_type": kind, "value": value, "props": props})
    d.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    con.execute("CREATE VIEW given AS " + ORACLES["brief_lines"])
    want = con.execute("SELECT line_no, line FROM given ORDER BY 1").fetchall()
    got = QUERIES["brief_lines"](spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == want
    con.close()
    nan = spark.createDataFrame([(1, "a", float("nan"), "{}")], "d int, t string, s double, h string")
    from tickloom.operators.text import brief_lines
    assert brief_lines(nan, "d", "t", "s", "h").collect()[0].line == "a +nan {}"
