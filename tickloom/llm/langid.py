"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate steps, elastic-net penalty) on a bounded sample of labelled
rows, then calibrated with one temperature. Document frequencies are counted over all labelled training rows; whole texts
are read everywhere.

Defined results: null text, empty text or a text without a letter is `und` with score 0; a null label is not learned
from; with no labelled rows at all every text is `und`. Repeated rows count as often as they occur. Extra columns are kept
by `predict` and ignored by `train`.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMS = 1 << 15                    # hashed n-gram features
SLICE = 1 << 18                   # characters turned into n-grams at once
KEYS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


@dataclass
class Model:
    """Weights (features x languages), their intercepts, inverse document frequencies and the temperature."""
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1-, 2- and 3-grams of the lower-cased text and their counts; characters other than letters become spaces."""
    low, out = text.lower(), None
    for at in range(0, max(len(low), 1), SLICE):
        a = np.frombuffer(low[at: at + SLICE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        a = np.where((a <= 64) | ((a >= 91) & (a <= 96)), np.uint32(32), a)
        last = at + SLICE >= len(low)
        h, grams = np.zeros(len(a), np.uint32), []
        for n in range(min(3, len(a))):
            h = h[: len(a) - n] * np.uint32(31) + a[n:] * KEYS[n]
            grams.append((h if last else h[:SLICE]) ^ np.uint32(n * 0x632BE5AB))
        x = np.concatenate(grams) if grams else h
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
        c = np.bincount(x >> np.uint32(17), minlength=DIMS)
        out = c if out is None else out + c
    hit = np.flatnonzero(out)
    return hit, out[hit]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their sublinear TF times IDF, with length one."""
    at, c = counts(text)
    v = np.log1p(c) * idf[at]
    n = math.sqrt(float(v @ v))
    return at, v / n if n > 0 else v


def _frequencies(batches):
    df, n = np.zeros(DIMS, np.int64), 0
    for b in batches:
        for text in b["text"]:
            df[counts(text)[0]] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pd.DataFrame({"feature": np.append(at, -1), "n": np.append(df[at], n)})


def train(labelled: DataFrame, per_language: int = 600, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0,
          l1: float = 1e-4, l2: float = 1e-5) -> Model:
    """Fit on `labelled` (doc_id, text, lang). About `per_language` rows of each language, drawn by a hash of the id and the
    text, enter the fit; document frequencies come from all rows. A tenth of the sample only sets the temperature."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    df = (rows.select("text").mapInPandas(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect())
    freq = {r["feature"]: r["n"] for r in df}
    total = freq.pop(-1, 0)
    idf = np.full(DIMS, math.log1p(total) + 1.0)
    for f, n in freq.items():
        idf[f] = math.log((1 + total) / (1 + n)) + 1.0
    sizes = rows.groupBy("lang").count()
    draw = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)).alias("draw")
    sample = (rows.withColumn("draw", draw).join(F.broadcast(sizes), "lang")
              .where(F.col("draw") * F.col("count") < per_language))

    def sparse(batches):
        for b in batches:
            vs = [vector(t, idf) for t in b["text"]]
            yield pd.DataFrame({"one": 1, "lang": b["lang"], "draw": b["draw"] * b["count"] / per_language,
                                "at": [v[0] for v in vs], "v": [v[1] for v in vs]})

    fit = (sample.mapInPandas(sparse, "one int, lang string, draw double, at array<int>, v array<double>")
           .groupBy("one").applyInPandas(lambda pdf: _fit(pdf, epochs, alpha, beta, l1, l2),
                                            "languages array<string>, weights binary, bias array<double>, temperature double").collect())
    if not fit:
        return Model([], idf, np.zeros((DIMS, 0)), np.zeros(0), 1.0)
    r = fit[0]
    return Model(list(r["languages"]), idf, np.frombuffer(r["weights"], np.float32).reshape(DIMS, -1).astype(float),
                 np.array(r["bias"]), r["temperature"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _fit(pdf: pd.DataFrame, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> pd.DataFrame:
    """FTRL-proximal on the bounded sample: z gathers gradients less the curvature of past steps, n their squares."""
    pdf = pdf.sort_values("draw", kind="stable").reset_index(drop=True)
    langs = sorted(pdf["lang"].unique())
    y = pdf["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    k = len(langs)
    z, n = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))
    held = np.arange(len(pdf)) % 10 == 9

    def weights(at):
        zz, nn = z[at], n[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        w[np.abs(zz) <= l1] = 0.0
        return w

    xs = [(np.append(np.asarray(a), DIMS), np.append(np.asarray(v), 1.0)) for a, v in zip(pdf["at"], pdf["v"])]
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(xs)):
            if held[i]:
                continue
            at, v = xs[i]
            w = weights(at)
            p = _softmax(v @ w)
            p[y[i]] -= 1.0
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(DIMS + 1))
    cal = np.flatnonzero(held) if held.any() else np.arange(len(xs))
    logits = np.array([xs[i][1] @ w[xs[i][0]] for i in cal])
    lo, hi = math.log(0.05), math.log(20.0)           # golden-section search on log T; the loss has one minimum there
    loss = lambda t: -np.log(np.maximum(_softmax(logits / math.exp(t))[np.arange(len(cal)), y[cal]], 1e-300)).mean()
    for _ in range(40):
        a, b = hi - 0.618 * (hi - lo), lo + 0.618 * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return pd.DataFrame({"languages": [langs], "weights": [w[:DIMS].astype(np.float32).tobytes()], "bias": [w[DIMS]], "temperature": [math.exp((lo + hi) / 2)]})


def predict(model: Model, text: Column) -> Column:
    """Struct (lang_pred, score) of a text column; the model has a fixed size (features x languages)."""
    langs, idf, bias, t = model.languages, model.idf, model.bias, model.temperature
    weights = model.weights.astype(np.float32).tobytes()

    @F.pandas_udf("lang_pred string, score double")
    def udf(texts: pd.Series) -> pd.DataFrame:
        w = np.frombuffer(weights, np.float32).reshape(DIMS, -1)
        out = []
        for s in texts:
            if not langs or not has_letter(s):
                out.append((UNKNOWN, 0.0))
                continue
            at, v = vector(s, idf)
            p = _softmax((v @ w[at] + bias) / t)
            j = int(p.argmax())
            out.append((langs[j], float(p[j])))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return udf(text)


def held_out(doc_id: str = "doc_id", mod: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out()))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), predict(model, F.col("text")).alias("p"))
    return d.select("doc_id", "held_out", "p.lang_pred", "p.score")


def stage(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Rows whose language is known with a score of at least `min_score`; others are rejected. All columns stay."""
    model = train(docs.where(~held_out()))
    p = predict(model, F.col("text"))
    return docs.where((p["lang_pred"] != UNKNOWN) & (p["score"] >= min_score))
