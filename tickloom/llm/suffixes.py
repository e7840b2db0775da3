"""Removal of long repeated byte strings with a difference cover.

A perfect difference set D modulo `PERIOD` gives the sampled positions p with p mod PERIOD in D: whatever the offset of two
equal strings of `LENGTH` bytes, some position of the one and the matching position of the other are both sampled within
their first PERIOD bytes. So equal strings always show as equal sampled suffixes of `LENGTH - PERIOD + 1` bytes, and only 12
of 133 suffixes need names.

Names are made as in suffix sorting by triples: the name of 3 bytes is their value, the name of 9, 27, 81 and 243 bytes is a
64-bit name of a triple of names, and a prefix of another length is named by two overlapping ones. Since only equality of
prefixes of one fixed length matters, names need no ranks, and one distributed sort of the names replaces the rounds of the
recursion: sorted names are compared with their neighbours, and names found in two places survive (`_repeated`). The
remaining suffixes, those at any position within PERIOD before a surviving sample, are then named with all LENGTH bytes and
sorted and compared the same way; a second, independent name chooses their bucket, so that the bits a name effectively has
grow with the number of buckets. Each position whose name repeats covers LENGTH bytes.

Equal texts are one text throughout: they are found by their digest, and removed whole if they are long enough. A task sends
each name at most once, so a passage that a third of all texts hold reaches a bucket once for every task, not for every text.

Passages of PASSAGE words may be shorter than LENGTH bytes. On request they are found the same way at the same time, over
words in place of bytes: a cover modulo WORD_PERIOD samples runs of SHARED words, and passages near a run that another text
holds are named in full. Words are compared with A-Z lower-cased and whatever white space is between them, and a passage counts
only if another text only if another text holds it. A text sends each name of words once. A name of a run of words is a difference of prefix sums.

Names of the first round only tell where to look, so 48 bits of them are sent, and a text's runs of places are kept beside it for
the second round and the cut.

Defined results: null text is empty; texts shorter than LENGTH only lose nothing; repeated rows remove each other.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written
from .hashing import BASE, STEP, U, mix, powers, remembered, word_hashes

LENGTH, PERIOD, ORDER = 400, 133, 11          # PERIOD = ORDER^2 + ORDER + 1
WINDOW = LENGTH - PERIOD + 1                  # bytes that sampled suffixes must share
PASSAGE, WORD_PERIOD, WORD_ORDER = 50, 31, 5
SHARED = PASSAGE - WORD_PERIOD + 1            # words that sampled runs must share
FLUSH = 2_000_000                             # names a task holds before it sends them
BUCKET_BYTES = 16 << 20                       # names of one bucket
FILLED = 1 << 20                              # bytes named at once


@remembered
def cover(q: int = ORDER) -> np.ndarray:
    """A perfect difference set: powers of a cubic root over the field of q elements that lie in one plane (Singer)."""
    c = next(c for c in range(1, q) if all((x**3 - x - c) % q for x in range(q)))     # x^3 = x + c without a root
    v, out = (1, 0, 0), []
    for i in range(q * q + q + 1):
        if v[2] == 0:
            out.append(i)
        v = (c * v[2] % q, (v[0] + v[2]) % q, v[1])
    return np.array(out)


@remembered
def factors(seed: int) -> tuple:
    """Three odd multipliers and an addend for the names of a seed."""
    m = mix(np.arange(4, dtype=U) + U(4 * seed + 1)) | U(1)
    return m[0], m[1], m[2], m[3]


def join3(a: np.ndarray, b: np.ndarray, c: np.ndarray, seed: int) -> np.ndarray:
    x, y, z, s = factors(seed)
    return mix(a * x + b * y + c * z + s)


def triple(n: np.ndarray, step: int, size: int, seed: int) -> np.ndarray:
    """Names of `size` positions from three names that are `step` apart."""
    return join3(n[:size], n[step: step + size], n[2 * step: 2 * step + size], seed)


def names27(data: bytes, seed: int = 0) -> np.ndarray:
    """Names of the 27 bytes that start at each position."""
    a = np.frombuffer(data, np.uint8).astype(U)
    n = (a[:-2] << U(16)) | (a[1:-1] << U(8)) | a[2:]
    n = triple(n, 3, len(n) - 6, seed)
    return triple(n, 9, len(n) - 18, seed)


def names81(n27: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
    return join3(n27[at], n27[at + 27], n27[at + 54], seed)


def names243(n27: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
    return join3(names81(n27, at, seed), names81(n27, at + 81, seed), names81(n27, at + 162, seed), seed)


def samples(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sampled positions, names of their WINDOW bytes), slice by slice."""
    places, names = [], []
    d = cover()
    for lo in range(0, len(data) - WINDOW + 1, FILLED - FILLED % PERIOD):
        hi = min(len(data) - WINDOW + 1, lo + FILLED - FILLED % PERIOD)
        at = (np.arange(lo, hi, PERIOD)[:, None] + d[None, :]).ravel()
        at = at[at < hi]
        n = names27(data[lo: hi + WINDOW])
        k = at - lo
        places.append(at)
        names.append(mix(names243(n, k) * U(BASE) + names243(n, k + WINDOW - 243)))
    return (np.concatenate(places), np.concatenate(names)) if places else (np.empty(0, np.int64), np.empty(0, U))


def long_names(data: bytes, runs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, names, second names) of the LENGTH bytes at every position of the runs [lo, hi)."""
    places, names, others = [np.empty(0, np.int64)], [np.empty(0, U)], [np.empty(0, U)]
    for start, stop in runs:
        for lo in range(start, stop, FILLED):
            hi = min(stop, lo + FILLED)
            both = []
            for seed in (1, 2):
                n = names27(data[lo: hi + LENGTH], seed)
                n = triple(n, 27, hi - lo + LENGTH - 81, seed)
                n = triple(n, 81, hi - lo + LENGTH - 243, seed)
                both.append(mix(n[: hi - lo] * U(BASE) + n[LENGTH - 243: LENGTH - 243 + hi - lo]))
            places.append(np.arange(lo, hi))
            names.append(both[0])
            others.append(both[1])
    return np.concatenate(places), np.concatenate(names), np.concatenate(others)


def run_names(words: np.ndarray, at: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Names of the `width` words from each of the ascending places."""
    base, out = int(factors(seed)[0]), [np.empty(0, U)]
    up, down = powers(base, STEP), powers(pow(base, -1, 1 << 64), STEP)
    for lo in range(0, len(words) - width + 1, STEP - width):
        k = at[np.searchsorted(at, lo): np.searchsorted(at, lo + STEP - width)] - lo
        part = words[lo: lo + STEP]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out.append(mix((sums[k + width] - sums[k]) * down[k]))
    return np.concatenate(out)


def word_samples(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sampled places, names of their SHARED words)."""
    if len(words) < PASSAGE:
        return np.empty(0, np.int64), np.empty(0, U)
    at = (np.arange(0, len(words), WORD_PERIOD)[:, None] + cover(WORD_ORDER)[None, :]).ravel()
    at = at[at <= len(words) - SHARED]
    return at, run_names(words, at, SHARED, 3)


def passage_names(words: np.ndarray, runs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, names, second names) of the PASSAGE words at every place of the runs [lo, hi)."""
    if not len(runs):
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, U)
    at = np.concatenate([np.arange(lo, hi) for lo, hi in runs])
    return at, run_names(words, at, PASSAGE, 4), run_names(words, at, PASSAGE, 5)


class Sender:
    """Names of a task on their way to buckets: a name met twice is known to repeat, the others are sent once."""

    def __init__(self, buckets: int, narrow: bool):
        self.buckets, self.narrow, self.size = buckets, narrow, 0
        self.keys, self.names, self.homes = [], [], []

    def add(self, key: int, names: np.ndarray, homes: np.ndarray) -> None:
        self.keys.append(np.full(len(names), key, np.int64))
        self.names.append(names)
        self.homes.append((homes % U(self.buckets)).astype(np.uint32))
        self.size += len(names)

    def flush(self) -> pd.DataFrame:
        """Rows (bucket, texts, runs, names): each name once, under text 0 if it already repeats here; and under buckets from
        `buckets` on, by text, the names that are known to repeat."""
        keys, names, homes = (np.concatenate(x) for x in (self.keys, self.names, self.homes))
        self.keys, self.names, self.homes, self.size = [], [], [], 0
        order = np.lexsort((names, homes))
        keys, names, homes = keys[order], names[order], homes[order].astype(np.int64)
        same = np.zeros(len(names) + 1, bool)
        same[1:-1] = (names[1:] == names[:-1]) & (homes[1:] == homes[:-1])
        many, first = same[1:] | same[:-1], ~same[:-1]
        out = []
        for pick, known in ((first, False), (many, True)):
            k, n, b = (keys if known else np.where(many, 0, keys))[pick], names[pick], homes[pick]
            if known:
                b = (mix(k.view(U)) % U(self.buckets)).astype(np.int64) + self.buckets
            order = np.lexsort((k, b))
            k, n, b = k[order], n[order], b[order]
            edge = np.flatnonzero(np.diff(b, prepend=-1)) if len(b) else np.empty(0, int)
            for lo, hi in zip(edge, [*edge[1:], len(b)]):
                u, r = _runs(k[lo:hi])
                out.append((int(b[lo]), u.tobytes(), r.tobytes(), packed(n[lo:hi]) if self.narrow else n[lo:hi].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "texts", "runs", "names"])


def _runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[at], np.diff(np.append(at, len(k))).astype(np.uint32)


SENT = "bucket long, texts binary, runs binary, names binary"
PART = "slice long, bucket long, texts binary, runs binary, rest binary, names binary"
ANSWER = "text_key long, direct binary, rest_buckets binary, rest_names binary"


def short(names: np.ndarray) -> np.ndarray:
    """The low 48 bits, enough to tell the names of one text in one bucket apart."""
    return names & U((1 << 48) - 1)


def packed(names: np.ndarray) -> bytes:
    return np.ascontiguousarray(names.view("<u2").reshape(-1, 4)[:, :3]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 4), "<u2")
    out[:, :3] = np.frombuffer(raw, "<u2").reshape(-1, 3)
    return out.view(U).ravel()


def _repeated(buckets: int, narrow: bool):
    """Sort a bucket's names, compare neighbours, and answer each text: the names that repeat, or, where those are fewer, the
    names that do not (`rest`).  Answers leave in slices of the texts, so that a bucket makes few rows."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        keys = np.concatenate([np.repeat(np.frombuffer(t, np.int64), np.frombuffer(r, np.uint32)) for t, r in zip(pdf["texts"], pdf["runs"])])
        names = np.concatenate([unpacked(x) if narrow else np.frombuffer(x, U) for x in pdf["names"]])
        order = np.lexsort((keys, names))
        keys, names = keys[order], names[order]
        if bucket >= buckets:
            hit = np.ones(len(names), bool)
        else:
            new = np.concatenate(([True], names[1:] != names[:-1]))
            start, group = np.flatnonzero(new), np.cumsum(new) - 1
            last = np.append(start[1:], len(keys)) - 1
            # held by two texts, or met twice by one task (text 0)
            hit = ((keys[start] != keys[last]) | np.logical_or.reduceat(keys == 0, start))[group]
        hit, names, keys = hit[keys != 0], names[keys != 0], keys[keys != 0]
        home = (mix(keys.view(U)) % U(buckets)).astype(np.int64)
        order = np.lexsort((keys, home))
        hit, names, keys, home = hit[order], names[order], keys[order], home[order]
        if not hit.any():
            return pd.DataFrame([], columns=[c.split()[0] for c in PART.split(", ")])
        at = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        size = np.diff(np.append(at, len(keys)))
        found = np.add.reduceat(hit.astype(np.int64), at)
        rest = (2 * found > size) & (bucket < buckets)
        send = (hit != np.repeat(rest, size)) & np.repeat(found > 0, size)
        sent, some = np.add.reduceat(send.astype(np.int64), at), found > 0
        text, runs, flags, where = keys[at][some], sent[some].astype(np.uint32), rest[some], home[at][some]
        low = names[send]
        edge = np.flatnonzero(np.diff(where, prepend=-1))
        ends, stops = np.append(edge[1:], len(where)), np.concatenate(([0], np.cumsum(runs, dtype=np.int64)))
        return pd.DataFrame([(int(where[i]), bucket, text[i:j].tobytes(), runs[i:j].tobytes(), flags[i:j].tobytes(), packed(low[stops[i]: stops[j]])) for i, j in zip(edge, ends)],
                            columns=[c.split()[0] for c in PART.split(", ")])
    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """All answers of each text of a slice as one row."""
    text = [np.frombuffer(x, np.int64) for x in pdf["texts"]]
    runs = [np.frombuffer(x, np.uint32) for x in pdf["runs"]]
    flags = np.concatenate([np.frombuffer(x, bool) for x in pdf["rest"]])
    bucket = np.repeat(pdf["bucket"].to_numpy(), [len(t) for t in text])
    text, runs = np.concatenate(text), np.concatenate(runs)
    names = np.concatenate([unpacked(x) for x in pdf["names"]])
    owner, by_rest = np.repeat(text, runs), np.repeat(flags, runs)

    def split(keys, values):
        order = np.argsort(keys, kind="stable")
        u, n = _runs(keys[order]) if len(keys) else (keys, [])
        return dict(zip(u.tolist(), np.split(values[order], np.cumsum(n)[:-1]) if len(n) else []))

    direct, left, homes = split(owner[~by_rest], names[~by_rest]), split(owner[by_rest], names[by_rest]), split(text[flags], bucket[flags])
    none = np.empty(0, U)
    return pd.DataFrame([(k, packed(direct.get(k, none)), homes.get(k, none).astype(np.int64).tobytes(), packed(left.get(k, none))) for k in np.unique(text).tolist()],
                        columns=["text_key", "direct", "rest_buckets", "rest_names"])


def _gather(buckets: int, names_of, narrow: bool):
    """Send the names of each different text of a task."""
    def run(batches):
        sender, seen = Sender(buckets, narrow), set()
        for b in batches:
            for row in b.itertuples(index=False):
                if row.text_key in seen:
                    continue
                seen.add(row.text_key)
                names, homes = names_of(row)
                if len(names):
                    sender.add(row.text_key, names, homes)
                if sender.size >= FLUSH:
                    yield sender.flush()
                    seen = set()
        if sender.size:
            yield sender.flush()
    return run


def _answers(sent: DataFrame, buckets: int, narrow: bool) -> DataFrame:
    """One row for each text with a repeated name, written out, with all its answers."""
    parts = sent.groupBy("bucket").applyInPandas(_repeated(buckets, narrow), PART)
    whole = parts.groupBy("slice").applyInPandas(_merged, ANSWER)
    return written(whole.select("text_key", F.struct("direct", "rest_buckets", "rest_names").alias("answers")))


def _answered(names: np.ndarray, homes: np.ndarray, buckets: int, answers) -> np.ndarray:
    """Which of a text's names repeat, by its answers."""
    low, hit = short(names), np.zeros(len(names), bool)
    if answers["direct"]:
        hit = np.isin(low, unpacked(answers["direct"]))
    if answers["rest_buckets"]:
        told = np.zeros(buckets, bool)
        told[np.frombuffer(answers["rest_buckets"], np.int64)] = True
        told = told[(homes % U(buckets)).astype(np.int64)]
        told[told] = ~np.isin(low[told], unpacked(answers["rest_names"]))
        hit |= told
    return hit


def _runs_before(hit: np.ndarray, period: int, last: int) -> list[tuple[int, int]]:
    """Runs [lo, hi) of the places within `period` before a hit, up to `last`."""
    lo, hi = np.maximum(0, hit - period + 1), np.minimum(hit, last) + 1
    lo, hi = lo[lo < hi], hi[lo < hi]
    if not len(lo):
        return []
    new = np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1]) + 1
    return list(zip(lo[np.append(0, new)].tolist(), np.append(np.maximum.accumulate(hi)[new - 1], hi.max()).tolist()))


def _covered(hit: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what pieces of a length at the hits cover."""
    new = np.flatnonzero(np.diff(hit) > length) + 1
    return hit[np.append(0, new)], hit[np.append(new - 1, len(hit) - 1)] + length


def _words(data: bytes, passages: bool) -> np.ndarray:
    return word_hashes(data.lower()) if passages else np.empty(0, U)


def _once(names: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, first = np.unique(names, return_index=True)
    return names, homes[first]


def _candidates(data: bytes, words: np.ndarray, buckets: int, answers) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Runs of positions, and of words, that lie within a period before a sample whose name repeats."""
    (at, n), (place, m) = samples(data) if len(data) >= LENGTH else word_samples(words[:0]), word_samples(words)
    names = np.concatenate((n, m))
    hit = _answered(names, names, buckets, answers)
    return _runs_before(at[hit[: len(n)]], PERIOD, len(data) - LENGTH), _runs_before(place[hit[len(n):]], WORD_PERIOD, len(words) - PASSAGE)


def _cut(data: bytes, words: np.ndarray, runs, buckets: int, answers) -> tuple[int, int, bytes, int]:
    """(bytes removed, removed runs, bytes left, words in passages) when every place of `runs` whose name repeats covers LENGTH
    bytes or PASSAGE words."""
    (at, n, homes), (place, m, others) = long_names(data, runs[0]), passage_names(words, runs[1])
    hit = _answered(np.concatenate((n, m)), np.concatenate((homes, others)), buckets, answers)
    at, place = at[hit[: len(n)]], place[hit[len(n):]]
    shared = 0
    if len(place):
        start, end = _covered(place, PASSAGE)
        shared = int((end - start).sum())
    if not len(at):
        return 0, 0, data, shared
    start, end = _covered(at, LENGTH)
    left = [data[a:b] for a, b in zip(np.append(0, end), np.append(start, len(data)))]
    return int((end - start).sum()), len(start), b"".join(left), shared


def query(docs: DataFrame, passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `passages` also n_passage_words, the words of a document that lie in
    a run of PASSAGE words which another document holds as well."""
    least = 2 * PASSAGE - 1 if passages else LENGTH                    # bytes of the shortest text that can lose or share
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("text_key", F.when(F.xxhash64("text") == 0, 1).otherwise(F.xxhash64("text"))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    total = d.agg(F.sum("n_bytes")).first()[0] or 0
    share = (ORDER + 1) / PERIOD + passages * (WORD_ORDER + 1) / WORD_PERIOD / 6          # names a byte, at six bytes a word
    buckets = max(16, -int(-total * share * 8 // BUCKET_BYTES))
    long_texts = d.where(F.col("n_bytes") >= least).select("text_key", "text")
    spark = docs.sparkSession

    def sampled(row):
        data = row.text.encode("utf-8", "surrogatepass")
        n = samples(data)[1] if len(data) >= LENGTH else np.empty(0, U)
        n = np.concatenate((n, np.unique(word_samples(_words(data, passages))[1])))
        return short(n), n

    def located(batches):
        seen: set[int] = set()
        for b in batches:
            out = []
            for key, t, first in zip(b["text_key"], b["text"], b["answers"]):
                if key not in seen:
                    seen.add(key)
                    data = t.encode("utf-8", "surrogatepass")
                    runs = _candidates(data, _words(data, passages), buckets, first)
                    if any(runs):
                        out.append((key, t, *(np.array(r, np.int64).tobytes() for r in runs)))
            yield pd.DataFrame(out, columns=["text_key", "text", "places", "word_places"])

    def known(data, places, word_places):
        runs = [np.frombuffer(x, np.int64).reshape(-1, 2).tolist() for x in (places, word_places)]
        return _words(data, bool(runs[1])), runs

    found = _answers(long_texts.mapInPandas(_gather(buckets, sampled, True), SENT), buckets, True)
    released(spark)
    held = written(long_texts.join(found, "text_key").mapInPandas(located, "text_key long, text string, places binary, word_places binary"))
    released(spark)
    more = max(16, -(-(held.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * (8 + 2 * passages) // BUCKET_BYTES))

    def starts(row):
        data = row.text.encode("utf-8", "surrogatepass")
        words, runs = known(data, row.places, row.word_places)
        once = _once(*passage_names(words, runs[1])[1:])
        return tuple(np.concatenate(x) for x in zip(long_names(data, runs[0])[1:], once))

    again = _answers(held.mapInPandas(_gather(more, starts, False), SENT), more, False)
    released(spark)

    def cut(batches):
        for b in batches:
            out = []
            for t, places, word_places, second in zip(b["text"], b["places"], b["word_places"], b["answers"]):
                data = t.encode("utf-8", "surrogatepass")
                removed, spans, left, shared = _cut(data, *known(data, places, word_places), more, second)
                out.append((hashlib.sha256(data).hexdigest(), removed, spans, hashlib.sha256(left).hexdigest(), shared))
            yield pd.DataFrame(out, columns=["sha", "n_removed", "n_spans", "kept", "shared"])

    parts = held.join(again, "text_key").mapInPandas(cut, "sha string, n_removed long, n_spans long, kept string, shared long").dropDuplicates(["sha"])
    n_words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")) if passages else F.lit(0)
    rows = written(d.select("doc_id", "n_bytes", F.sha2("text", 256).alias("sha"), n_words.cast("long").alias("n_words")))
    copies = rows.where(F.col("n_bytes") >= least).groupBy("sha").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = rows.join(parts, "sha", "left").join(copies, "sha", "left")
    again_whole = F.col("copies").isNotNull()
    whole = again_whole & (F.col("n_bytes") >= LENGTH)
    shared = F.when(again_whole & (F.col("n_words") >= PASSAGE), F.col("n_words")).otherwise(F.coalesce("shared", F.lit(0)))
    return rows.select("doc_id", "n_bytes",
                       F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                       F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                       F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
                       *([shared.cast("long").alias("n_passage_words")] if passages else []))
