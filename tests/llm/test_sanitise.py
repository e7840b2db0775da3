"""Base spans against plain patterns, and added spans against the registered SQL and planted names."""
import hashlib
import random
import re

import duckdb
import pytest
from conftest import SCHEMA, collected
from pyspark.sql import functions as F

from tickloom.llm import sanitise

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TRICKY = ["a@b.c_d@e.f", "a@b.c.@d.e", "x@y@b.co", "x@@b.c", "a@b", "éabc@x.yz", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 0255.1.1.001", "4465758382889437 4465-7583-8288-9437 4465 7583 8288 9437x",
          "44657583828894374465758382889437", "4465758382889437 1", "+1 (743) 555-3824 then +12 3", "+1 (743) 555-3824 8.196.197.208", "++49 30 1234567-", "9" * 5000, "a." * 4000, "a@" + "b." * 4000 + "c",
          "7 - 8", "4465758382889437  4465758382889437", "12345678901234567890", "+" * 50, "é" * 300 + "z@q.de" + "ß" * 300, "1 2 3 4 5 6 7 8 9 0 1 2 3 4"]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_by_hand(t):
    ok = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": lambda v: 13 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v)),
          "phone": lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t) if ok[k](m[0])]


def checked(got, docs):
    want = []
    for d in docs:
        own = base_by_hand(d[1] or "")
        want.append((d[0], *[sum(k == n for k, *_ in own) for n in PLAIN], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own).encode()).hexdigest()))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted([tuple(r[:6]) for r in got], key=key) == sorted(want, key=key)


def noise(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé .,") for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """A person named beside a number in five texts of their own, and one name that also stands elsewhere."""
    rng = random.Random(9)
    out = [(1000 + i, noise(rng, 40) + f" Quimbly Smithers, the zorbian. Call +1 (743) 555-3824 for Quimbly. " + noise(rng, 40), "en", "s", 0, "x", "y", "z") for i in range(5)]
    out += [(1100 + i, noise(rng, 30) + " smithers zorbit " + noise(rng, 30), "en", "s", 0, "x", "y", "z") for i in range(60)]
    out += [(1200, "quimbly alone, mail quimbly@x.org", "en", "s", 0, "x", "y", "z")]
    copy = noise(rng, 50) + " uniquename someone@mail.org uniquename " + noise(rng, 20)
    return out + [(1300 + i, copy, "en", "s", 0, "x", "y", "z") for i in range(8)]


def test_base_spans_against_plain_patterns(spark, rows, docs):
    rng = random.Random(4)
    more = [(500 + i, t, "en", "s", 0, "x", "y", "z") for i, t in enumerate(TRICKY)]
    more += [(600 + i, "".join(rng.choice("019.@+- ()a_é") for _ in range(rng.randint(1, 200))), "en", "s", 0, "x", "y", "z") for i in range(300)]
    d = docs.unionByName(spark.createDataFrame(more, SCHEMA)).withColumn("spans", F.lit("clash")).withColumn("key", F.lit(1))
    checked(collected(sanitise.query(d)), [*rows, *more])


def test_terms_that_tell_an_entity(spark, rows, docs, planted):
    d = docs.unionByName(spark.createDataFrame(planted, SCHEMA))
    got = collected(sanitise.query(d))
    checked(got, [*rows, *planted])
    con = duckdb.connect()
    documents = d.toPandas()                                            # noqa: F841  (read by name in the SQL)
    want = [tuple(r) for r in con.execute(sanitise.oracle()).fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    spans = {r[0]: r[6] for r in got}
    text = {r[0]: r[1] for r in planted}
    told = {text[i][int(s):int(e)].lower(): k for i in (1000, 1200) for k, s, e in (x.split(":") for x in spans[i].split(",")) if k in sanitise.ADDED}
    assert told["quimbly"] == "removed" and told["zorbian"] == "generalised" and "smithers" not in told
    assert spans[1200].startswith("email:") and spans[1200].count("removed") == 1          # inside an address nothing is added
    assert all("removed" not in spans[1300 + i] and "generalised" not in spans[1300 + i] for i in range(8))      # copies are one surrounding
    assert all(spans[1100 + i] == "" for i in range(60))


def test_redacted_text(spark, planted):
    out = {r.doc_id: r.text for r in sanitise.redacted(spark.createDataFrame(planted, SCHEMA)).collect()}
    assert "[PHONE]" in out[1000] and "555" not in out[1000] and "uimbly" not in out[1000] and "zor*" in out[1000] and "Smithers" in out[1000]
    assert out[1200].endswith("mail [EMAIL]")


def test_running_sums_of_long_arrays(spark):
    r = spark.range(1).select(F.sequence(F.lit(1), F.lit(2000)).alias("a")).select(sanitise.prefix_sums(F.col("a")).alias("s")).first()
    assert r.s == [i * (i + 1) // 2 for i in range(1, 2001)]


def test_empty_table(empty):
    assert sanitise.query(empty).count() == 0
