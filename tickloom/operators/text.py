"""Text and retrieval jobs over document tables."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import div
from ..joins import asof_join
from ..series import Series, SeriesSpec, col, parked

# fixed values: word lists and patterns
STOPWORDS = ("the", "a", "an", "of", "and", "in", "to", "for", "was", "what", "is", "our", "we", "with", "on", "its", "does", "do", "by", "are", "as", "at", "or", "from")
NEGATORS = ("not", "no", "never", "without", "nor")
CLAUSE = r"[,;:.!?]"
TOKEN = r"[a-z]+(?:'[a-z]+)?"
SECTION = r"(?m)^(Item\s+\d+[A-Z]?\.)"
AMOUNT = r"\$([\d,]+(?:\.\d+)?) million"
INJECTION = (r"ignore (all )?(previous|prior|above) instructions", r"system (prompt|note)", r"you are now", r"disregard (the|your) (rules|instructions)")


def tokens(text, stop=STOPWORDS) -> Column:
    """Lowercase alphanumeric tokens without stop words, repeats kept."""
    return F.filter(F.split(F.lower(col(text)), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*stop) if stop else w != "")


def lexicon_clauses(text, positive: list[str], negative: list[str], window=2) -> Column:
    """Mean sign of sentiment words; a negator among the previous `window` tokens of the same clause flips the sign."""
    pos, neg, nots = (F.array(*[F.lit(w) for w in ws]) for ws in (positive, negative, NEGATORS))

    def signs(clause):
        # shifted copies of the negator flags are zipped, so every token is looked at once
        tk = F.regexp_extract_all(clause, F.lit(TOKEN), F.lit(0))
        sign = F.transform(tk, lambda w: F.when(F.array_contains(pos, w), 1).when(F.array_contains(neg, w), -1).otherwise(0))
        no = F.transform(tk, lambda w: F.array_contains(nots, w))
        near = None
        for k in range(1, window + 1):
            sh = F.concat(F.array(*[F.lit(False)] * k), no)
            near = sh if near is None else F.zip_with(near, sh, lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
        return F.zip_with(sign, near, lambda v, n: F.coalesce(F.when(n, -v).otherwise(v), F.lit(0)))
    s = F.filter(F.flatten(F.transform(F.split(F.lower(col(text)), CLAUSE), signs)), lambda v: v != 0)
    return F.coalesce(F.try_divide(F.aggregate(s, F.lit(0), lambda a, v: a + v), F.size(s)), F.lit(0.0))


def lexicon_simple(text, positive: list[str], negative: list[str]) -> Column:
    """(pos - neg) / (pos + neg) over all tokens, 0 without any."""
    t = F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z]+"), F.lit(0))
    pos, neg = (F.array(*[F.lit(w) for w in ws]) for ws in (positive, negative))
    p, n = F.size(F.filter(t, lambda w: F.array_contains(pos, w))), F.size(F.filter(t, lambda w: F.array_contains(neg, w)))
    return F.coalesce(F.try_divide(p - n, p + n), F.lit(0.0))


def headline_key(text) -> Column:
    """Normal form of a headline: lowercase letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9 ]", ""), r"\s+", " "))


def dedupe_news(df: DataFrame, symbol: str, headline: str, ts: str, tie: str) -> DataFrame:
    """Earliest row per symbol and normalized headline, as one aggregation with map-side combine."""
    rest = [c for c in df.columns if c != symbol]
    return (df.withColumn("_k", headline_key(headline)).groupBy(symbol, "_k").agg(F.min_by(F.struct(*rest), F.struct(ts, tie)).alias("_m"))
            .select(symbol, *[F.col(f"_m.{c}").alias(c) for c in rest]))


def first_amount(text) -> Column:
    """First '$x million' as a number of millions."""
    return F.try_to_number(F.nullif(F.regexp_replace(F.regexp_extract(col(text), AMOUNT, 1), ",", ""), F.lit("")), F.lit("999999999999.99999")).cast("double")


def injection_hits(text) -> Column:
    """Lines that match an injection pattern, case ignored."""
    pat = "(?i)(" + "|".join(INJECTION) + ")"
    return F.filter(F.split(col(text), "\n"), lambda line: F.rlike(line, F.lit(pat)))


def ungrounded_numbers(extract, source) -> Column:
    """Numbers of an extraction that do not occur in the source text (thousands separators ignored)."""
    nums = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda v: F.regexp_replace(v, ",", ""))
    return F.array_except(nums(col(extract)), nums(col(source)))


def quoted_in(quote, source) -> Column:
    """Quote occurs in the source once whitespace is collapsed."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.contains(flat(col(source)), flat(col(quote)))


def read_structured(df: DataFrame, raw: str, stop_reason: str, schema: str, out="parsed") -> DataFrame:
    """Status of a recorded model message: refusal, truncated, invalid or ok, with the parsed fields."""
    p = F.from_json(raw, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = df.withColumn(out, p)
    status = (F.when(F.col(stop_reason) == "refusal", "refusal").when(F.col(stop_reason) == "max_tokens", "truncated")
              .when(F.col(out).isNull() | F.col(f"{out}._corrupt").isNotNull(), "invalid").otherwise("ok"))
    return d.withColumn("status", status)


def chunk_filings(df: DataFrame, doc: str, text: str, meta: list[str], max_words=60, overlap=10) -> DataFrame:
    """Sections at item headings, then overlapping word windows with stable ids.  A document is one row; no grouping."""
    mark = "\u0001"
    parts = F.split(F.regexp_replace(col(text), SECTION, mark + "$1" + "\u0002"), mark)
    d = df.select(doc, *meta, F.posexplode(parts).alias("_s", "_p"))
    has = F.contains("_p", F.lit("\u0002"))
    d = d.withColumns({"section": F.when(has, F.trim(F.split("_p", "\u0002")[0])).otherwise("Preamble"), "_body": F.when(has, F.split("_p", "\u0002")[1]).otherwise(F.col("_p"))})
    words = F.filter(F.split("_body", r"\s+"), lambda w: w != "")
    step = max_words - overlap
    d = d.withColumn("_w", words).withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - overlap, F.lit(1)) - 1, F.lit(step))))
    d = d.withColumn("chunk", F.array_join(F.slice("_w", F.col("start") + 1, max_words), " ")).where(F.trim("chunk") != "")
    cid = F.substring(F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in (*meta, doc)], "section", F.col("start").cast("string"))), 1, 12)
    return d.select(doc, *meta, "section", "start", "chunk", cid.alias("chunk_id"))


# ---------------------------------------------------------------- retrieval
def bm25_top_k(queries: DataFrame, query: str, qtext: str, docs: DataFrame, doc: str, text: str, scope: list[str], k: int, as_of: tuple[str, str] | None = None, k1=1.5, b=0.75, block=4096, words=1 << 21) -> DataFrame:
    """The k best documents by Okapi score per query: (query, doc, score, rank), of documents that share a term with it, ties by id.

    Statistics belong to the documents a query may see: its scope and, with `as_of` = (query time, document time), only
    documents filed by then.  Documents are tokenized once and stay one row each, with their terms as 64-bit numbers.  They are
    dealt to blocks of about `block` rows or `words` words; a block meets the weighted terms of its queries in one task and
    leaves k candidates per query, so no (query, document) pair is ever a shuffled row.
    """
    asked, filed = ([as_of[0]], [as_of[1]]) if as_of else ([], [])
    numbers = lambda c: F.transform(tokens(c), lambda w: F.xxhash64(w))
    q = queries.select(*scope, query, *asked, F.explode(numbers(qtext)).alias("term")).groupBy(*scope, query, *asked, "term").agg(F.count(F.lit(1)).alias("qf"))
    t = parked(docs.select(*scope, F.col(doc).alias("_id"), *filed, F.coalesce(numbers(text), F.array().cast("array<long>")).alias("_t")).withColumn("len", F.size("_t")))
    wanted = q.select(*scope, "term").distinct()
    held = t.select(*scope, *filed, F.explode(F.array_distinct("_t")).alias("term")).join(wanted, [*scope, "term"], "left_semi").groupBy(*scope, *filed, "term").agg(F.count(F.lit(1)).alias("n"))
    if as_of:
        # what a query may see is a prefix of its scope in filing order: running totals, then one as-of join
        per = t.groupBy(*scope, *filed).agg(F.count(F.lit(1)).alias("_c"), F.sum("len").alias("_w"))
        run = Series.of(per, SeriesSpec(tuple(scope), (as_of[1],), f"unix_micros({as_of[1]}) div 86400000000")).running({"_cn": ("sum", F.col("_c")), "_cw": ("sum", F.col("_w"))}).done()
        stat = asof_join(queries.select(*scope, query, as_of[0]), run.select(*scope, as_of[1], F.col("_cn").alias("_n1"), F.col("_cw").alias("_w1")), scope, as_of[0], as_of[1], ["_n1", "_w1"], bucket_us=30 * 86_400_000_000)
        stat = stat.select(query, F.col("_n1").alias("_N"), (F.col("_w1") / F.col("_n1")).alias("avgdl"))
        seen = q.join(held, [*scope, "term"]).where(F.col(as_of[1]) <= F.col(as_of[0])).groupBy(query, "term").agg(F.sum("n").alias("n"))
        j = q.join(seen, [query, "term"]).join(stat, query)
    else:
        stat = t.groupBy(*scope).agg(F.count(F.lit(1)).alias("_N"), F.avg("len").alias("avgdl"))
        j = q.join(held, [*scope, "term"])
        j = j.join(stat, scope) if scope else j.crossJoin(F.broadcast(stat))
    idf = F.log((F.col("_N") - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
    j = j.select(*scope, F.col(query).alias("_q"), *asked, "term", "avgdl", (F.col("qf") * idf * (k1 + 1)).alias("_w"))
    size = t.groupBy(*scope).agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("len") / words, F.lit(1.0))).alias("_n"))
    meet = lambda d: d.join(size, scope) if scope else d.crossJoin(F.broadcast(size))
    left = meet(t).withColumn("_b", F.pmod(F.xxhash64("_id"), "_n")).drop("_n")
    right = meet(j).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).drop("_n")

    def best(d, w):
        # postings of the block in order of term, then one sum over documents per query
        known = np.unique(w["term"])
        codes, freqs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(0, len(d) if len(known) else 0, 256):
            # a slice of documents at a time: only terms that are asked for stay
            term, at = np.concatenate(d["_t"].iloc[lo:lo + 256].to_list()), np.repeat(np.arange(lo, min(lo + 256, len(d))), d["len"].iloc[lo:lo + 256])
            i = np.searchsorted(known, term)
            asked_for = known[np.minimum(i, len(known) - 1)] == term
            code, tf = np.unique(i[asked_for] * len(d) + at[asked_for], return_counts=True)
            codes.append(code)
            freqs.append(tf)
        code, tf = np.concatenate(codes), np.concatenate(freqs)
        o = np.argsort(code)
        code, tf = code[o], tf[o]
        term, row = known[code // max(len(d), 1)], code % max(len(d), 1)
        ids, length = d["_id"].to_numpy(), d["len"].to_numpy(float)
        out = []
        for name, g in w.sort_values(["_q", "term"]).groupby("_q", sort=False):
            lo, hi = np.searchsorted(term, g["term"], "left"), np.searchsorted(term, g["term"], "right")
            n = hi - lo
            pick = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            r, f = row[pick], tf[pick]
            s = np.repeat(g["_w"].to_numpy(), n) * f / (f + k1 * (1 - b + b * length[r] / g["avgdl"].iloc[0]))
            if as_of:
                ok = (d[as_of[1]] <= g[as_of[0]].iloc[0]).to_numpy()[r]
                r, s = r[ok], s[ok]
            hit = np.flatnonzero(np.bincount(r, minlength=len(d)))
            score = np.bincount(r, s, len(d))[hit]
            if len(hit) > k:
                near = score >= np.partition(score, len(hit) - k)[len(hit) - k]
                hit, score = hit[near], score[near]
            o = np.lexsort((ids[hit], -score))[:k]
            out.append(pd.DataFrame({query: name, doc: ids[hit][o], "score": score[o]}))
        return pd.concat(out) if out else pd.DataFrame({query: [], doc: [], "score": []})

    sch = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(doc, docs.schema[doc].dataType), T.StructField("score", T.DoubleType())])
    return top_k(left.groupBy(*scope, "_b").cogroup(right.groupBy(*scope, "_b")).applyInPandas(best, sch), query, doc, k)


def top_k(scores: DataFrame, query: str, doc: str, k: int, score="score") -> DataFrame:
    """Best k documents per query with their rank (ties by id); the filter is pushed into the window as a rank limit."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), doc)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_top_k(queries: DataFrame, query: str, qvec: str, docs: DataFrame, doc: str, dvec: str, scope: list[str], k: int, block=1024) -> DataFrame:
    """The k documents with the largest dot product per query inside a scope: (query, doc, score, rank), ties by document id.

    Both sides are packed into blocks of at most about `block` vectors; a pair of blocks is one matrix product in a task and
    leaves k candidates per query, so no pair of vectors is ever a row.
    """
    kinds = {f.name: f.dataType for f in [*queries.schema.fields, *docs.schema.fields]}

    def packed(df, key, vec, side):
        n = df.groupBy(*scope).agg(F.ceil(F.count(F.lit(1)) / block).alias("_n")) if scope else df.agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
        d = df.join(n, scope) if scope else df.crossJoin(F.broadcast(n))
        d = d.select(*scope, F.pmod(F.xxhash64(key), F.greatest("_n", F.lit(1))).alias("_b"), F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"))
        fields = [*[kinds[c] for c in scope], T.ArrayType(kinds[key]), T.BinaryType()]
        sch = T.StructType([T.StructField(c, f) for c, f in zip([*scope, f"{side}i", f"{side}v"], fields)])

        def pack(g):
            # vectors as bytes: no Python number for each coordinate
            return pd.DataFrame({**{c: g[c].iloc[:1] for c in scope}, f"{side}i": [g["key"].to_numpy()], f"{side}v": [np.stack(g["vec"].to_list()).astype(float).tobytes()]})
        return d.groupBy(*scope, "_b").applyInPandas(pack, sch)

    def best(batches):
        for b in batches:
            for qi, qv, di, dv in zip(b["_qi"], b["_qv"], b["_di"], b["_dv"]):
                names, ids = np.asarray(qi), np.asarray(di)
                g = np.frombuffer(qv).reshape(len(names), -1) @ np.frombuffer(dv).reshape(len(ids), -1).T
                h = np.where(np.isnan(g), -np.inf, g)
                row, at = np.nonzero(h >= np.partition(h, -k, axis=1)[:, -k, None]) if len(ids) > k else np.indices(h.shape).reshape(2, -1)
                o = np.lexsort((ids[at], -h[row, at], row))
                row, at = row[o], at[o]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, at = row[first], at[first]
                yield pd.DataFrame({query: names[row], doc: ids[at], "score": g[row, at]})

    a, z = packed(queries, query, qvec, "_q"), packed(docs, doc, dvec, "_d")
    if not scope:
        z = z.hint("rebalance")                                      # packing and products are tasks of their own, one Python worker each
    pairs = a.join(z, scope) if scope else a.crossJoin(z)            # blocks of a stated query set against blocks of all rows
    sch = T.StructType([T.StructField(query, kinds[query]), T.StructField(doc, kinds[doc]), T.StructField("score", T.DoubleType())])
    return top_k(pairs.select("_qi", "_qv", "_di", "_dv").mapInPandas(best, sch), query, doc, k)


def rank_fusion(rankings: list[DataFrame], query: str, doc: str, k=60) -> DataFrame:
    """Reciprocal rank fusion; ties go to the document seen first."""
    u = None
    for i, r in enumerate(rankings):
        x = r.select(query, doc, "rank", F.lit(i).alias("_l"))
        u = x if u is None else u.unionByName(x)
    g = u.groupBy(query, doc).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("_l", "rank")).alias("_first"))
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), "_first")
    return g.withColumn("rank", F.row_number().over(w)).drop("_first")


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, query: str, doc: str, k=5) -> DataFrame:
    """recall@1, recall@k and reciprocal rank, averaged over queries with a relevant document."""
    n = relevant.groupBy(query).agg(F.count(F.lit(1)).alias("_n"))
    hit = ranked.join(relevant, [query, doc]).groupBy(query).agg(F.count(F.when(F.col("rank") <= 1, 1)).alias("_h1"), F.count(F.when(F.col("rank") <= k, 1)).alias("_hk"), F.min("rank").alias("_r"))
    d = n.join(hit, query, "left")
    return d.agg(F.avg(F.coalesce("_h1", F.lit(0)) / F.col("_n")).alias("recall_1"), F.avg(F.coalesce("_hk", F.lit(0)) / F.col("_n")).alias("recall_k"), F.avg(F.coalesce(1.0 / F.col("_r"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("n"))


def lsa_vectors(docs: DataFrame, doc: str, text: str, dim=16, features=4096) -> DataFrame:
    """TF-IDF of hashed terms projected on its leading principal directions, unit length.

    Documents are tokenized once and kept as sparse counts, which also go to Python as such: a dense row is made there only in a
    slice of 1,024 documents.  Tasks add up products of slices (whole numbers, so in any order the same); the driver receives the
    sums (`features` squared numbers), weights them and takes the directions from a symmetric eigenvalue solver, which always
    converges.
    """
    from pyspark.ml.feature import HashingTF
    t = docs.select(doc, F.coalesce(tokens(text), F.array().cast("array<string>")).alias("_t"))
    t = HashingTF(numFeatures=features, inputCol="_t", outputCol="_tf").transform(t).withColumn("_tf", F.unwrap_udt("_tf"))
    t = parked(t.select(doc, F.col("_tf.indices").alias("_i"), F.col("_tf.values").cast("array<int>").alias("_n")))

    def slices(terms, counts):
        for lo in range(0, len(terms), 1024):
            i, n = (x.iloc[lo:lo + 1024].to_list() for x in (terms, counts))
            out = np.zeros((len(i), features))
            out[np.repeat(np.arange(len(i)), [len(v) for v in i]), np.concatenate(i)] = np.concatenate(n)
            yield out

    def products(batches):
        total = np.zeros((features + 3, features))            # products, then sums, documents that hold a term, documents
        for b in batches:
            for x in slices(b["_i"], b["_n"]):
                total[:-3] += x.T @ x
                total[-3:] += np.stack([x.sum(axis=0), (x > 0).sum(axis=0), np.full(features, len(x))])
        yield pd.DataFrame({"i": np.arange(features + 3), "v": list(map(np.ndarray.tobytes, total))})

    def added(g):
        return pd.DataFrame({"i": g["i"].iloc[:1], "v": [sum(map(np.frombuffer, g["v"])).tobytes()]})

    sums = {r["i"]: np.frombuffer(r["v"]) for r in t.select("_i", "_n").mapInPandas(products, "i int, v binary").groupBy("i").applyInPandas(added, "i int, v binary").collect()}
    lead = np.zeros((features, dim))
    if sums and sums[features + 2][0] > 1:
        total, held, n = sums[features], sums[features + 1], sums[features + 2][0]
        idf = np.log((n + 1) / (held + 1))
        cov = (np.stack([sums[i] for i in range(features)]) - np.outer(total, total) / n) * np.outer(idf, idf) / (n - 1)
        lead = idf[:, None] * np.linalg.eigh(cov)[1][:, ::-1][:, :dim]

    @F.pandas_udf("array<double>")
    def project(terms: pd.Series, counts: pd.Series) -> pd.Series:
        v = np.concatenate([np.empty((0, dim)), *[x @ lead for x in slices(terms, counts)]])
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return pd.Series(list(np.divide(v, size, out=np.zeros_like(v), where=size > 0)))

    return t.select(doc, project("_i", "_n").alias("v"))


def faithfulness(claims: DataFrame, docs: DataFrame, answer: str, claim: str, text="text", title="title", cited="cited", doc_title="title", doc_text="doc_text") -> DataFrame:
    """Share of claims whose citations all occur verbatim; a 'Not found' claim may stand without one."""
    d = claims.where(F.trim(text) != "").join(docs.select(F.col(doc_title).alias(title), doc_text), title, "left")
    ok = F.when(F.col(cited).isNull(), F.trim(F.col(text)).startswith("Not found")).otherwise(F.coalesce(F.contains(doc_text, F.col(cited)), F.lit(False)))
    c = d.groupBy(answer, claim).agg(F.min(ok).alias("_ok"))
    return c.groupBy(answer).agg(F.avg(F.col("_ok").cast("double")).alias("faithfulness"))


def field_scores(pred: DataFrame, gold: DataFrame, item: str, fields: list[str], rel_tol=0.005) -> DataFrame:
    """Precision and recall per numeric field with a relative tolerance; a missing prediction costs recall only."""
    def long(df, v):
        return df.select(item, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot([item], fields, "field", v)
    j = long(gold, "g").join(long(pred, "p"), [item, "field"], "left")
    hit = F.col("g").isNotNull() & F.col("p").isNotNull() & (F.abs(F.col("p") - F.col("g")) <= rel_tol * F.abs("g"))
    return j.groupBy("field").agg(div(F.count(F.when(hit, 1)), F.count("p")).alias("precision"), div(F.count(F.when(hit, 1)), F.count("g")).alias("recall"))


def regression_report(items: DataFrame, by: list[str], item: str, gold: str, old: str, new: str) -> DataFrame:
    """Old and new score and the items that got worse (their ids as a table: one row each)."""
    o, n = F.coalesce(F.col(old) == F.col(gold), F.lit(False)), F.coalesce(F.col(new) == F.col(gold), F.lit(False))
    return items.groupBy(*by).agg(F.avg(o.cast("double")).alias("old_score"), F.avg(n.cast("double")).alias("new_score"), F.count(F.when(o & ~n, 1)).alias("regressed"))


def usage_cost(usage: DataFrame, prices: DataFrame, by: list[str]) -> DataFrame:
    """Token totals, cached share and cost (prices per million: model, input, cached, output; a small fixed table)."""
    j = usage.join(F.broadcast(prices), "model")
    fresh = F.col("input_tokens") * F.col("input") + F.col("cached_tokens") * F.col("cached") + F.col("output_tokens") * F.col("output")
    return j.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens"), div(F.sum("cached_tokens"), F.sum(F.col("input_tokens") + F.col("cached_tokens"))).alias("cached_share"), (F.sum(fresh) / 1e6).alias("cost"))


def proposal_review(max_contracts=10, allowed=("iron_condor", "vertical", "collar")) -> Column:
    """First broken rule of a proposal row (structure, contracts, defined_risk, rationale); NULL when it passes."""
    return (F.when(~F.col("structure").isin(list(allowed)), "structure not allowed").when((F.col("contracts") < 1) | (F.col("contracts") > max_contracts), "size")
            .when(~F.col("defined_risk"), "undefined risk").when(F.coalesce(F.trim("rationale"), F.lit("")) == "", "no rationale"))


def score_requests(news: DataFrame, story: str, text: str) -> DataFrame:
    """One request row per distinct story; nothing is sent anywhere."""
    return news.dropDuplicates([story]).select(F.col(story).alias("custom_id"), F.to_json(F.struct(F.col(text).alias("content"))).alias("body"))


def usable_at(published: str, scored: str) -> Column:
    return F.greatest(published, scored)


def brief_lines(alerts: DataFrame, day: str, ticker: str, sentiment: str, headline: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """One formatted line per alert, strongest first inside a day and missing values last; `tie` names the columns that order equal ones.

    A line with a missing part is NULL.  Sizes are rounded from their binary value, half to even, as printf does in C.
    """
    x = F.col(sentiment)
    w = Window.partitionBy(day).orderBy(F.abs(x).desc(), F.col(ticker).asc_nulls_last(), F.col(headline).asc_nulls_last(), *tie)
    size = (F.when(F.isnan(x), "+nan").when(x == float("inf"), "+inf").when(x == float("-inf"), "-inf")
            .otherwise(F.call_function("format_number", x, F.lit("+0.00;-0.00"))))
    return alerts.select(day, F.row_number().over(w).alias("line_no"), F.concat(ticker, F.lit(" "), size, F.lit(" "), headline).alias("line"))
