"""Personal data and the terms that give it away: information-theoretic sanitisation, in DataFrame functions only.

Base spans are found by four patterns.  Each distinct value (one address, one number) is a protected entity e.  A term t that
stands near e in several places may reveal it even where e itself is taken out.  With N documents, n(e), n(t) that hold e or t,
and n(e, t) that hold t near e, t tells PMI(e; t) = ln(N n(e, t) / (n(e) n(t))) of the information IC(e) = ln(N / n(e)) of e.
A term with PMI >= DISCLOSED * IC, seen near e in at least SUPPORT different surroundings (told apart by the smallest
digest of their terms, so that copies and nearly all near copies of a passage are one), is sanitised wherever it stands: it is generalised to its class, the first three letters, where the class tells
less than that about every such e, and removed where even the class tells as much.

Inputs: a null text is the empty text.  Rows that repeat a doc_id, or a whole document, are rows of the result each; N and n(t)
count rows, n(e) and n(e, t) count rows of one doc_id and text once.  An empty table gives no rows.  Work is linear in the length of a text: patterns start only
where a match can, and never go back over a run.  Columns besides doc_id and text are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepared, written

DISCLOSED = 0.9                  # share of an entity's information that a term may not tell
SUPPORT = 3                      # different surroundings in which it must stand near the entity
NEAR = 80                        # characters on each side of a span
STEM = 3                         # letters that name the class of a term
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
CHUNK = 256

# kind: pattern that starts only where the plain one can and keeps what a run took, and a cheap condition for any match
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
ADDED = ("generalised", "removed")
SPAN = "array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"


def prefix_sums(numbers: Column) -> Column:
    """Running sums of an array; filled in chunks, so that a long array is not copied for every element."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("cur"), F.array().cast("array<array<int>>").alias("full"))

    def step(s, x):
        at, filled = s["at"] + x, F.size(s["cur"]) >= CHUNK
        return F.struct(at.alias("at"), F.when(filled, F.array(at)).otherwise(F.array_append(s["cur"], at)).alias("cur"),
                        F.when(filled, F.array_append(s["full"], s["cur"])).otherwise(s["full"]).alias("full"))

    return F.aggregate(numbers, start, step, lambda s: F.flatten(F.array_append(s["full"], s["cur"])))


def placed(text: Column, pattern: str) -> Column:
    """array<struct<value, left, right, end>>: leftmost matches, the text before and after up to the next match, and the end."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    d = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("value"), g.alias("left")))
    d = F.zip_with(d, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda s, g: F.struct(s["value"].alias("value"), s["left"].alias("left"), g.alias("right")))
    d = F.filter(d, lambda s: s["value"].isNotNull())
    ends = prefix_sums(F.transform(d, lambda s: F.length(s["left"]) + F.length(s["value"])))
    return F.zip_with(d, ends, lambda s, e: F.struct(s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right"), e.alias("end")))


def luhn(number: Column) -> Column:
    digits = F.transform(F.split(F.reverse(F.translate(number, " -", "")), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(digits, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def entity(kind: str, value: Column) -> Column:
    """One name for the ways to write a value."""
    same = {"email": F.translate(value, CAPITALS, SMALL), "ip": value}.get(kind, F.translate(value, "+ ().-", ""))
    return F.concat(F.lit(f"{kind} "), same)


def spans_of(text: Column, kind: str) -> Column:
    pattern, sign = KINDS[kind]
    edge = lambda s, drop: F.when(F.length(s) <= NEAR, s).otherwise(F.regexp_replace(F.substring(s, *drop[:2]), drop[2], ""))
    d = F.filter(placed(text, pattern), lambda s: valid(kind, s["value"]))
    d = F.transform(d, lambda s: F.struct(
        F.lit(kind).alias("kind"), (s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), entity(kind, s["value"]).alias("value"),
        edge(s["left"], (-NEAR, NEAR, r"^[^\x20\x09-\x0D]*")).alias("left"), edge(s["right"], (1, NEAR, r"[^\x20\x09-\x0D]*$")).alias("right")))
    some = text.contains(sign) if sign else text.rlike("[0-9]")
    return F.when(some, d.cast(SPAN)).otherwise(F.array().cast(SPAN))


def terms(text: Column) -> Column:
    """Distinct terms of at least STEM letters, and their classes."""
    t = F.filter(F.split(F.translate(text, CAPITALS, SMALL), OTHER), lambda w: F.length(w) >= STEM)
    t = F.array_distinct(t)
    return F.concat(t, F.array_distinct(F.transform(t, stem)))


def stem(term: Column) -> Column:
    return F.concat(F.substring(term, 1, STEM), F.lit("*"))


def texts(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.withColumn("key", F.xxhash64("doc_id", "text"))


def base(d: DataFrame) -> DataFrame:
    """doc_id, key and an array of base spans a kind, for each text."""
    return d.select("doc_id", "key", *[spans_of(F.col("text"), k).alias(k) for k in KINDS])


def disclosing(d: DataFrame, found: DataFrame) -> DataFrame:
    """(term, action): terms that tell too much about an entity."""
    rows = found.select("key", F.explode(F.concat(*KINDS)).alias("s")).select("key", F.col("s.value").alias("entity"), F.concat_ws("\x01", "s.left", "s.right").alias("around"))
    of = rows.groupBy("entity").agg(F.count_distinct("key").alias("n_e"))
    seen = rows.select("entity", "key", terms(F.regexp_replace("around", KINDS["email"][0], " ")).alias("units"))
    near = seen.select("entity", "key", F.array_min(F.transform("units", lambda u: F.md5(u))).alias("place"), F.explode("units").alias("unit"))
    near = near.groupBy("entity", "unit").agg(F.count_distinct("key").alias("n_et"), F.count_distinct("place").alias("places"))
    counts = d.select("key", F.explode(terms(F.col("text"))).alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n_t"))
    total = d.agg(F.count(F.lit(1)).alias("total"))
    told = near.where(F.col("places") >= SUPPORT).join(counts, "unit", "left").join(of, "entity").crossJoin(F.broadcast(total))      # one row
    n_t = F.greatest(F.coalesce("n_t", F.lit(0)), F.col("n_et"))
    told = told.where(F.col("n_e") < F.col("total")).withColumn("share", 1 - F.log(n_t / F.col("n_et")) / F.log(F.col("total") / F.col("n_e"))).where(F.col("share") >= DISCLOSED)
    told = written(told.select("entity", "unit"))
    classes = told.where("unit like '%*'").select("entity", F.col("unit").alias("class"), F.lit(1).alias("known"))
    return (told.where("unit not like '%*'").withColumn("class", stem(F.col("unit"))).join(classes, ["entity", "class"], "left")
            .groupBy(F.col("unit").alias("term")).agg(F.max(F.coalesce("known", F.lit(0))).alias("known"))
            .select("term", F.when(F.col("known") == 1, "removed").otherwise("generalised").alias("action")))


def added(d: DataFrame, flagged: DataFrame) -> DataFrame:
    """(key, more): spans of flagged terms outside addresses, for the texts that have some.

    Terms meet the flagged ones without positions first, so only texts with a hit are cut in places, and only places of their
    own flagged terms leave the row.  Spark broadcasts the written tables where their size allows it and sorts both sides
    otherwise.
    """
    hits = d.select("key", F.explode(terms(F.col("text"))).alias("term")).join(flagged, "term")
    hits = written(hits.groupBy("key").agg(F.collect_set(F.struct("term", "action")).alias("flagged")))
    mails = placed(F.col("text"), KINDS["email"][0])
    masked = F.when(F.col("text").contains("@"), F.concat(
        F.array_join(F.transform(mails, lambda s: F.concat(s["left"], F.repeat(F.lit("0"), F.length(s["value"])))), ""),
        F.element_at(F.split("text", KINDS["email"][0], -1), -1))).otherwise(F.col("text"))
    d = d.join(hits, "key").dropDuplicates(["key"]).select("key", masked.alias("masked"), F.transform("flagged", lambda f: f["term"]).alias("names"), "flagged")
    low = lambda c: F.translate(c, CAPITALS, SMALL)
    words = d.select("key", "flagged", F.filter(placed(F.col("masked"), LETTERS), lambda s: F.array_contains("names", low(s["value"]))).alias("words"))
    action = lambda s: F.filter("flagged", lambda f: f["term"] == low(s["value"]))[0]["action"]
    more = F.transform("words", lambda s: F.struct(action(s).alias("kind"), (s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), low(s["value"]).alias("term")))
    return words.select("key", F.sort_array(more).alias("more")).where(F.size("more") > 0)


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, key, arrays of base spans a kind, and `more`: the added spans (kind, start, end, term), by kind and start."""
    prepared(docs.sparkSession)
    d = texts(docs)
    found = written(base(d))
    flagged = written(disclosing(d, found))
    return found.join(written(added(d, flagged)), "key", "left")


def listed(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))


def query(docs: DataFrame) -> DataFrame:
    d = sanitise(docs)
    own = F.concat(*[listed(F.col(k)) for k in KINDS])
    return d.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(own, ","), 256).alias("base_sha256"),
                    F.array_join(F.concat(own, F.coalesce(listed(F.col("more")), F.array().cast("array<string>"))), ",").alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with spans (start, end, put) replaced, by start; one that begins inside another is part of it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s, x):
        parts = F.concat(s["parts"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), x["put"]))
        return F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), parts.alias("parts"))).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["parts"].alias("parts")))

    done = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.aggregate(spans, start, step, done)


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and text with base spans as [KIND], generalised terms as their class and removed terms left out."""
    d = sanitise(docs).dropDuplicates(["key"])
    put = lambda kind: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put")))
    more = F.transform("more", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["kind"] == "removed", "").otherwise(stem(s["term"])).alias("put")))
    spans = F.array_sort(F.concat(*[put(F.col(k)) for k in KINDS], F.coalesce(more, F.array().cast("array<struct<start:int,end:int,put:string>>"))))
    return texts(docs).join(d.select("key", spans.alias("spans")), "key").select("doc_id", redact(F.col("text"), F.col("spans")).alias("text"))


# fixed values of the registered SQL
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def oracle() -> str:
    low = lambda t: f"translate({t}, '{CAPITALS}', '{SMALL}')"
    words = lambda t: f"list_distinct(list_filter(string_split_regex({low(t)}, '{OTHER}'), lambda x: length(x) >= {STEM}))"
    units = lambda t: f"(SELECT list_concat(w, list_distinct(list_transform(w, lambda x: x[1:{STEM}] || '*'))) FROM (SELECT {words(t)} AS w))"
    cut = " UNION ALL ".join(f"SELECT r, {i} AS k, '{kind}' AS kind, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS v, unnest(gs[1:len(ms)]) AS g FROM (SELECT r, regexp_extract_all(t, '{p}', 0) AS ms, string_split_regex(t, '{p}') AS gs FROM d) WHERE len(ms) > 0"
                             for i, (kind, p) in enumerate(PLAIN.items()))
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN reverse({digits})[j]::INT ELSE reverse({digits})[j]::INT * 2 - CASE WHEN reverse({digits})[j]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id::BIGINT AS doc_id, coalesce(text, '') AS t FROM documents),
 cut AS ({cut}),
 spot AS (SELECT *, sum(length(g) + length(v)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM cut),
 side AS (SELECT r, k, kind, v, e - length(v) AS s, e, lag(e, 1, 0) OVER w AS pe, lead(e - length(v)) OVER w AS ns FROM spot
 WHERE kind <> 'card' OR length({digits}) BETWEEN 13 AND 19 WINDOW w AS (PARTITION BY r, k ORDER BY e)),
 base AS MATERIALIZED (SELECT r, k, kind, s::BIGINT AS s, e::BIGINT AS e, kind || ' ' || CASE kind WHEN 'email' THEN {low('v')} WHEN 'ip' THEN v ELSE {digits} END AS entity,
 substr(t, pe::BIGINT + 1, (s - pe)::BIGINT) AS a, substr(t, e::BIGINT + 1, (coalesce(ns, length(t)) - e)::BIGINT) AS b, doc_id, t FROM side JOIN d USING (r)
 WHERE CASE kind WHEN 'email' THEN TRUE WHEN 'ip' THEN regexp_matches(v, '^({BYTE}[.]){{3}}{BYTE}$') WHEN 'card' THEN {luhn} ELSE length({digits}) BETWEEN 9 AND 15 END),
 around AS (SELECT doc_id, t, entity, CASE WHEN length(a) <= {NEAR} THEN a ELSE regexp_replace(right(a, {NEAR}), '^[^\x20\x09-\x0D]*', '') END || chr(1) ||
 CASE WHEN length(b) <= {NEAR} THEN b ELSE regexp_replace(left(b, {NEAR}), '[^\x20\x09-\x0D]*$', '') END AS c FROM base),
 ne AS (SELECT entity, count(DISTINCT (doc_id, t)) AS n_e FROM around GROUP BY 1),
 net AS (SELECT entity, unit, count(DISTINCT (doc_id, t)) AS n_et FROM (SELECT doc_id, t, entity, list_min(list_transform(us, lambda u: md5(u))) AS place, unnest(us) AS unit
 FROM (SELECT *, {units(f"regexp_replace(c, '{PLAIN['email']}', ' ', 'g')")} AS us FROM around)) GROUP BY 1, 2 HAVING count(DISTINCT place) >= {SUPPORT}),
 nt AS (SELECT unit, count(*) AS n_t FROM (SELECT unnest({units('t')}) AS unit FROM d) GROUP BY 1),
 told AS (SELECT entity, unit FROM (SELECT *, greatest(coalesce(n_t, 0), n_et)::DOUBLE AS n, (SELECT count(*) FROM d)::DOUBLE AS total FROM net LEFT JOIN nt USING (unit) JOIN ne USING (entity))
 WHERE n_e < total AND 1 - ln(n / n_et) / ln(total / n_e) >= {DISCLOSED}),
 flagged AS (SELECT x.unit AS term, CASE WHEN max((c.unit IS NOT NULL)::INT) = 1 THEN 'removed' ELSE 'generalised' END AS kind FROM told x
 LEFT JOIN told c ON c.entity = x.entity AND c.unit = x.unit[1:{STEM}] || '*' WHERE NOT ends_with(x.unit, '*') GROUP BY 1),
 masked AS (SELECT r, array_to_string(list_transform(range(1, len(gs) + 1), lambda i: gs[i] || coalesce(repeat('0', length(ms[i])), '')), '') AS t
 FROM (SELECT r, regexp_extract_all(t, '{PLAIN['email']}', 0) AS ms, string_split_regex(t, '{PLAIN['email']}') AS gs FROM d)),
 w AS (SELECT r, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS v, unnest(gs[1:len(ms)]) AS g FROM (SELECT r, regexp_extract_all(t, '{LETTERS}', 0) AS ms, string_split_regex(t, '{LETTERS}') AS gs FROM masked) WHERE len(ms) > 0),
 more AS (SELECT r, CASE kind WHEN 'generalised' THEN 4 ELSE 5 END AS k, kind, (e - length(v))::BIGINT AS s, e::BIGINT AS e FROM (SELECT r, v, sum(length(g) + length(v)) OVER (PARTITION BY r ORDER BY i) AS e FROM w) JOIN flagged ON term = {low('v')}),
 o AS (SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS own, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans
 FROM (SELECT r, k, kind, s, e FROM base UNION ALL SELECT * FROM more) GROUP BY 1)
 SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
 sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (r)"""
