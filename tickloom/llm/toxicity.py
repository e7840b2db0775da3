"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are lower-cased words and, for longer words, their starts and ends of 3 to 6 letters. A token's log-odds between toxic
and clean documents carry a Dirichlet prior proportional to the token's frequency in the whole corpus; tokens whose log-odds
stand out by their own standard error form the lexicon, and a word scores the best of its tokens. All words are lowered by as
much as makes clean texts lose score on the whole, so a linear scan finds every maximal-scoring segment of a text and only
passages that stand out of clean texts are long ones. A segment's score is turned into a
p-value by an extreme-value (Gumbel) fit to clean documents, corrected for text length; the surprise of a document's
segments adds up, and a logistic curve fitted on the training labels maps it to a probability.

Labels come from a bounded sample (`SAMPLE` labelled rows); corpus frequencies cover every training document and scoring
covers every text in full.

Defined results: null and empty texts have no segment and get the score of a text without evidence; null labels are not
learned from; without labelled rows every score is 0. Repeated rows count as often as they occur.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SAMPLE = 40_000               # most labelled rows that are fitted on
LEXICON = 20_000              # most tokens in the lexicon, the clearest first
LEAST = 5                     # toxic documents a token must occur in
CLEAR = 4.0                   # standard errors that a lexicon token's log-odds lie above zero
PRIOR = 200.0                 # weight of the prior, in documents
REACH = 40                    # at most so many words without a lexicon token undo a typical lexicon word
BINS = 400
WORD = re.compile(r"[^\W\d_]+")
KEPT_WORDS = 300_000


def tokens(word: str) -> list[str]:
    out = [word]
    for k in range(3, min(7, len(word))):
        out += [f"{word[:k]}*", f"*{word[-k:]}"]
    return out


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    gap: float = -1.0                    # score of a word outside the lexicon, the drop of every word
    rate: float = 1.0                    # 1 / scale of the Gumbel law of the best segment
    shift: float = 0.0                   # its place for a text of one word
    slope: float = 0.0
    offset: float = -30.0


class Affixes(dict):
    """Values of words, made once for each word from a table of tokens (whole words, starts `abc*` and ends `*abc`)."""

    def __init__(self, table: dict, combine, none):
        super().__init__()
        self.combine, self.none = combine, none
        self.whole = {t: v for t, v in table.items() if "*" not in t}
        self.starts = {t[:-1]: v for t, v in table.items() if t.endswith("*")}
        self.ends = {t[1:]: v for t, v in table.items() if t.startswith("*")}

    def __missing__(self, word: str):
        starts, ends, n = self.starts, self.ends, len(word)
        found = [self.whole[word]] if word in self.whole else []
        for k in range(3, min(7, n)):
            if (t := word[:k]) in starts:
                found.append(starts[t])
            if (t := word[n - k:]) in ends:
                found.append(ends[t])
        out = self.combine(found) if found else self.none
        if len(self) < KEPT_WORDS:
            self[word] = out
        return out


def scores(m: Model) -> Affixes:
    return Affixes(m.lexicon, max, m.gap)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in one pass over the runs of equal sign."""
    up = np.concatenate(([False], scores > 0, [False]))
    starts, ends = np.flatnonzero(~up[:-1] & up[1:]), np.flatnonzero(up[:-1] & ~up[1:])
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    # start, end, sum before it, sum after it, nearest earlier segment that starts lower: with that link no segment is looked
    # at twice, so the scan is linear
    held: list[tuple[int, int, float, float, int]] = []
    for s, e, low, high in zip(starts.tolist(), ends.tolist(), sums[starts].tolist(), sums[ends].tolist()):
        k = len(held) - 1
        while True:
            while k >= 0 and held[k][2] >= low:
                k = held[k][4]
            if k < 0 or held[k][3] >= high:
                break
            s, low, link = held[k][0], held[k][2], held[k][4]            # the segment grows over the one it ends higher than
            del held[k:]
            k = link
        held.append((s, e, low, high, k))
    return [(s, e, high - low) for s, e, low, high, _ in held]


def can_stand_out(y: np.ndarray, g: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Whether a token in y of n_bad toxic and g of n_good clean documents can lie CLEAR standard errors above zero under any
    corpus frequency. On an interval of prior weights each term of the log-odds is at most its value at one end, and so is
    the inverse of the standard error; intervals are made narrower for the tokens that are left. Below the least weight, 1e-6,
    nothing changes where g > 0, and elsewhere the standard error is over 1,000."""
    alive = np.arange(len(y))
    for ratio in (1.5, 1.1, 1.02):
        most = np.full(len(alive), -np.inf)
        yy, gg = y[alive], g[alive]
        low = 1e-6
        while low < PRIOR:
            high = min(low * ratio, PRIOR)
            odds = (np.log((yy + high) / np.maximum(n_bad + PRIOR - yy - high, 0.5))
                    - np.log((gg + low) / np.maximum(n_good + PRIOR - gg - low, 0.5)))
            most = np.maximum(most, odds / np.sqrt(1.0 / (yy + high) + 1.0 / (gg + high)))
            low = high
        alive = alive[most >= CLEAR]
    out = np.zeros(len(y), bool)
    out[alive] = True
    return out


def word_list(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def surprise(found: list[float], n: int, m: Model) -> float:
    """Sum over segment scores of -log p, p the chance that a clean text of n words has a segment of this score or more."""
    total = 0.0
    for s in found:
        z = m.rate * s - math.log1p(n) - m.shift
        total += -math.log(max(-math.expm1(-math.exp(min(50.0, -z))), 1e-300))
    return total


def _counts(rows: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(token, n): documents that hold each token, of all tokens or of those wanted; the token '' counts documents."""
    def every(batches):
        total: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                seen = set()
                for w in set(word_list(t)):
                    seen.update(tokens(w))
                total.update(seen)
            total[""] += len(b)
            if len(total) > 2_000_000:
                yield pd.DataFrame(total.items(), columns=["token", "n"])
                total = Counter()
        if total:
            yield pd.DataFrame(total.items(), columns=["token", "n"])

    def known(batches):
        # a word's wanted tokens are an array of their numbers
        numbers = Affixes({t: i for i, t in enumerate(wanted)}, partial(np.array, dtype=np.int32), np.empty(0, np.int32))
        total, n = np.zeros(len(wanted), np.int64), 0
        for b in batches:
            for t in b["text"]:
                if found := [numbers[w] for w in set(word_list(t))]:
                    total[np.unique(np.concatenate(found))] += 1
            n += len(b)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"token": ["", *map(wanted.__getitem__, held)], "n": np.concatenate(([n], total[held]))})

    run = every if wanted is None else known
    return rows.select("text").mapInPandas(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on `docs` (doc_id, text) and `labels` (doc_id, toxic); pass only rows that may be learned from."""
    marks = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    n = marks.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    marks = F.broadcast(marks.where(share < SAMPLE / max(n, 1)).limit(2 * SAMPLE))        # bounded by SAMPLE
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marks, "doc_id")
    bad = {r["token"]: r["n"] for r in _counts(rows.where("toxic = 1")).where(F.col("n") >= LEAST).collect()}      # of the bounded sample
    n_bad = bad.pop("", 0)
    if not bad:
        return Model()
    good = {r["token"]: r["n"] for r in _counts(rows.where("toxic = 0"), list(bad)).collect()}       # tokens of `bad` only
    n_good = good.pop("", 0)
    # corpus frequencies are needed for tokens that can enter the lexicon at all
    can = can_stand_out(np.array(list(bad.values()), float), np.array([good.get(t, 0) for t in bad], float), n_bad, n_good)
    bad = {t: y for (t, y), k in zip(bad.items(), can) if k}
    every = {r["token"]: r["n"] for r in _counts(docs, list(bad)).collect()} if bad else {}
    n_all = every.pop("", 0)
    found = []
    for t, y in bad.items():
        a = PRIOR * (every.get(t, 0) + 0.5) / (n_all + 1.0)
        g = good.get(t, 0)
        odds = math.log((y + a) / max(n_bad + PRIOR - y - a, 0.5)) - math.log((g + a) / max(n_good + PRIOR - g - a, 0.5))
        z = odds / math.sqrt(1.0 / (y + a) + 1.0 / (g + a))
        if z >= CLEAR:
            found.append((z, t, odds))
    found = sorted(found, reverse=True)[:LEXICON]
    if not found:
        return Model()
    lexicon = {t: odds for _, t, odds in found}
    m = drifting_down(Model(lexicon, -float(np.median(list(lexicon.values()))) / REACH), rows.where("toxic = 0"))
    # extreme-value law of the best segment of clean texts, by moments
    best = written(rows.mapInPandas(_found(m), "toxic int, n int, best double, found array<double>"))     # of the bounded sample
    r = best.where("toxic = 0 and best > 0").agg(F.stddev("best").alias("sd"), F.avg("best").alias("mean"), F.avg(F.log1p("n")).alias("len")).first()
    sd = r["sd"] if r["sd"] and r["sd"] > 1e-6 else 1.0
    m.rate = math.pi / (math.sqrt(6) * sd)
    m.shift = m.rate * (r["mean"] or 0.0) - 0.5772 - (r["len"] or 0.0)
    # logistic curve over the binned surprise
    told = F.pandas_udf(lambda found, n: pd.Series([surprise(f, k, m) for f, k in zip(found, n)], dtype=float), "double")
    bins = (best.select("toxic", told("found", "n").alias("x"))
            .groupBy("toxic", F.least(F.floor(F.log1p("x") * 50), F.lit(BINS)).alias("bin")).count().collect())
    x = np.array([(b["bin"] + 0.5) / 50 for b in bins])
    y, k = np.array([float(b["toxic"]) for b in bins]), np.array([float(b["count"]) for b in bins])
    w = np.array([1.0, -2.0])
    for _ in range(60):                                   # Newton with a light ridge, so that separable bins stay finite
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        a = np.stack([x, np.ones_like(x)])
        grad = a @ (k * (p - y)) + np.array([1e-2 * w[0], 1e-2 * w[1]])
        hess = (a * (k * p * (1 - p))) @ a.T + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    m.slope, m.offset = float(w[0]), float(w[1])
    return m


def drifting_down(m: Model, clean: DataFrame) -> Model:
    """The model with all words lowered so far that clean texts lose score on the whole.

    Where lexicon words are frequent, a gap by their median alone is made up for by weak ones: texts drift upwards, whole texts
    become one segment and length decides. The drop is twice the mean score a word that all but 1 % of clean texts keep below.
    """
    def gains(batches):
        table = Affixes(m.lexicon, max, 0.0)
        for b in batches:
            words = [w for w in map(word_list, b["text"]) if w]
            yield pd.DataFrame({"gain": [sum(map(table.__getitem__, w)) / len(w) for w in words]}, dtype=float)

    usual = clean.select("text").mapInPandas(gains, "gain double").agg(F.percentile_approx("gain", 0.99, 10_000).alias("q")).first()["q"] or 0.0
    drop = max(2.0 * usual, -m.gap)
    return Model({t: odds - drop for t, odds in m.lexicon.items() if odds > drop}, -drop)


def _found(m: Model):
    def run(batches):
        table = scores(m)
        for b in batches:
            out = []
            for t, y in zip(b["text"], b["toxic"]):
                s = list(map(table.__getitem__, word_list(t)))
                found = [x for *_, x in segments(np.array(s))] if s and max(s) > 0 else []
                out.append((y, len(s), max(found, default=0.0), found))
            yield pd.DataFrame(out, columns=["toxic", "n", "best", "found"])
    return run


def shared_scores(m: Model) -> Affixes:
    """The word scores of a model, kept between the batches of a worker."""
    if not hasattr(m, "_scores"):
        m._scores = scores(m)
    return m._scores


def evidence(m: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        table, out = shared_scores(m), []
        for t in texts:
            s = list(map(table.__getitem__, word_list(t)))
            out.append(surprise([x for *_, x in segments(np.array(s))], len(s), m) if s and max(s) > 0 else 0.0)
        return pd.Series(out, dtype=float)
    return udf(text)


def score(m: Model, text: Column) -> Column:
    return 1 / (1 + F.exp(-(F.log1p(evidence(m, text)) * m.slope + m.offset)))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    m = train(docs.where(~held_out()), labels.where(~held_out()))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score(m, F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
