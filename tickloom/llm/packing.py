"""Packing token sequences by exact complements, then best fit.

Texts become token ids in tasks; only documents longer than a sequence are cut. Packing works on the histogram of piece
lengths, which has at most `CAPACITY` rows whatever the table's size. The longest length left opens a sequence; its gap is
looked up among the sums of one, two and three available lengths, and a combination that fills it exactly is consumed as
often as the counts allow. Where none exists the longest length that fits is taken and the smaller gap looked up again.
Every pattern uses up at least one length, so there are at most a few thousand patterns. Pieces then get their rank inside
their length (counted in salted groups, because one length may hold a third of all rows) and read sequence and offset from
the ranges of the patterns.

Defined results: null text counts as empty, an empty document is the single closing id; equal rows are packed separately.
"""
from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CAPACITY = 4096
CLOSING = 1
CACHED, LONGEST = 1_000_000, 40       # tokens kept per worker and their largest length
JOINED = 5_000                        # new tokens encoded as one text
SLICE = 1 << 21                       # characters of a text encoded at once
GATHERED = 8 << 20                    # characters of the texts whose new tokens are encoded together
# a token of lower-cased Latin-1 text: the tokenizer's own expression with its classes written out
TOKEN = re.compile(r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\x09-\x0D\x20\x85\xA0]+")
RANKED = 20_000                       # rows of one length numbered in one group


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Numbers of tokens, and the ids of each number.  Number 0 is the closing id.  Tokens are what the tokenizer splits a text
    into before it merges: white space always splits, and in texts of Latin-1 characters lower-casing and splitting are those of
    `TOKEN`.  Other words stay whole (`odd`)."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.fresh, self.odd = Tokenizer.from_file(path), {}, set()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)          # ids that end a token
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.ids, self.first, self.size = np.array([CLOSING], "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64)

    def __missing__(self, token: str) -> int:
        n = self.fresh.get(token)
        if n is None:
            n = self.fresh[token] = len(self.first) + len(self.fresh)
        return n

    def numbers(self, text: str, closes: bool) -> np.ndarray:
        """Numbers of the tokens of a text, and 0 where it closes."""
        if plain(text):
            tokens = TOKEN.findall(text.lower())
        else:
            tokens = []
            for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
                if plain(w):
                    tokens += TOKEN.findall(w.lower())
                else:
                    self.odd.add(w)
                    tokens.append(w)
        out = np.zeros(len(tokens) + closes, np.int64)
        out[: len(tokens)] = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return out

    def learn(self) -> None:
        """Ids of the tokens met since the last call."""
        def encoded(texts):
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        tokens = list(self.fresh)
        whole = [i for i, t in enumerate(tokens) if t in self.odd] if self.odd else []
        split = [i for i, t in enumerate(tokens) if t not in self.odd] if self.odd else range(len(tokens))
        order, ids, sizes = [], [], []
        groups = [split[i: i + JOINED] for i in range(0, len(split), JOINED)]
        for group, x in zip(groups, encoded([" ".join([tokens[i] for i in g]) for g in groups])):
            ends = np.flatnonzero(self.last[x])
            if len(ends) == len(group) and ends[-1] == len(x) - 1:
                order.append(np.asarray(group, np.int64))
                ids.append(x)
                sizes.append(np.diff(ends, prepend=-1))
            else:
                whole += group
        if whole:
            each = encoded([tokens[i] for i in whole])
            order.append(np.asarray(whole, np.int64))
            ids += each
            sizes.append(np.array([len(x) for x in each], np.int64))
        if tokens:
            order, size = np.concatenate(order), np.concatenate(sizes)
            new = np.empty((2, len(tokens)), np.int64)
            new[:, order] = len(self.ids) + np.cumsum(size) - size, size
            self.ids = np.concatenate((self.ids, *ids))
            self.first, self.size = np.concatenate((self.first, new[0])), np.concatenate((self.size, new[1]))

    def spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all numbers, where those of each end)."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.first[numbers] - ends + size, size) + np.arange(int(size.sum()))], ends

    def keep(self) -> None:
        """Keep short tokens as long as there is room, forget the others."""
        base = len(self.first) - len(self.fresh)
        kept = [(t, n) for t, n in self.fresh.items() if len(t) <= LONGEST][: max(0, CACHED - len(self))]
        if self.fresh:
            chosen = np.concatenate((np.arange(base), np.array([n for _, n in kept], np.int64)))
            ids, ends = self.spread(chosen)
            self.size = self.size[chosen]
            self.ids, self.first = ids, ends - self.size
            self.update((t, base + i) for i, (t, _) in enumerate(kept))
        self.fresh, self.odd = {}, set()


def plain(text: str) -> bool:
    """Latin-1 only, and no special token of the vocabulary: folded and split the same way in any surroundings."""
    if "<|" in text:
        return False
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return True


def words(path: str) -> Words:
    """The words of a worker.  Functions of this library travel by value and are new in every task, so what outlives a task
    hangs on a module that is imported there."""
    import tokenizers
    kept = vars(tokenizers).setdefault("_kept_words", {})
    if path not in kept:
        kept[path] = Words(path)
    return kept[path]


def _slices(text: str):
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            cut = text.rfind(" ", at, end)
            cut = cut if cut > at else text.find(" ", end)
            end = cut if cut > at else len(text)
        yield text[at:end]
        at = end


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text and the closing id, as the tokenizer gives them for the whole text."""
    known, out = words(path), [[] for _ in texts]
    held, owners, size = [], [], 0

    def flush():
        known.learn()
        ids, ends = known.spread(np.concatenate(held))
        stops = np.concatenate(([0], ends))[np.cumsum([0] + [len(x) for x in held])].tolist()
        for k, lo, hi in zip(owners, stops, stops[1:]):
            out[k].append(ids[lo:hi].tobytes())
        known.keep()
        held.clear()
        owners.clear()

    for k, t in enumerate(texts):
        t = t or ""
        if len(t) > SLICE:
            t = t.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        slices = list(_slices(t)) or [""]
        for i, x in enumerate(slices):
            held.append(known.numbers(x, i == len(slices) - 1))
            owners.append(k)
            size += len(x)
            if size >= GATHERED:
                flush()
                size = 0
    if held:
        flush()
    return [b"".join(x) for x in out]


class Stock:
    """Pieces left of each length, and the available lengths as two bit sets: bit x, and mirrored bit capacity - x.  A sum of
    two lengths is then one shift and one `and` of the sets."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity, self.bits, self.mirror = [0] * (capacity + 1), capacity, 0, 0
        for x, n in counts.items():
            self.change(x, n)

    def change(self, x: int, n: int) -> None:
        had = self.left[x] > 0
        self.left[x] += n
        if had != (self.left[x] > 0):
            self.bits ^= 1 << x
            self.mirror ^= 1 << (self.capacity - x)

    def longest(self, most: int) -> int:
        """The longest available length of at most `most`, 0 if there is none."""
        return (self.bits & ((2 << most) - 1)).bit_length() - 1 if self.bits & ((2 << most) - 1) else 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two available lengths with this sum, the longer one as long as possible."""
        both = self.bits & (self.mirror >> (self.capacity - total))
        if total % 2 == 0 and self.left[total // 2] == 1:
            both &= ~(1 << (total // 2))
        x = both.bit_length() - 1
        return (x, total - x) if both else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap exactly."""
        if self.left[gap] > 0:
            return (gap,)
        if two := self.pair(gap):
            return two
        x = self.longest(gap - 2) if gap > 2 else 0
        while x:
            self.change(x, -1)
            rest = self.pair(gap - x)
            self.change(x, 1)
            if rest:
                return (x, *rest)
            x = self.longest(x - 1)
        return None


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths and how many of each, number of sequences) so that every piece is placed."""
    stock, out = Stock(counts, capacity), []
    while top := stock.longest(capacity):
        use: dict[int, int] = {}

        def take(x):
            stock.change(x, -1)
            use[x] = use.get(x, 0) + 1

        take(top)
        gap = capacity - top
        while gap > 0:
            if exact := stock.exact(gap):
                for x in exact:
                    take(x)
                break
            x = stock.longest(gap)
            if not x:
                break
            take(x)
            gap -= x
        more = min(stock.left[x] // k for x, k in use.items())
        for x, k in use.items():
            stock.change(x, -k * more)
        out.append((use, 1 + more))
    return out


def ranges(found: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies per sequence, first sequence, offset), ordered by length and rank."""
    rows, used, base = [], {}, 0
    for use, times in found:
        at = 0
        for x, k in sorted(use.items(), reverse=True):
            rows.append((x, used.get(x, 0), k, base, at))
            used[x] = used.get(x, 0) + k * times
            at += x * k
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _gathered(batches):
    """Arrow batches joined until they hold enough text."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += int(b["text"].str.len().fillna(0).sum()) if len(b) else 0
        if size >= GATHERED:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of `docs` (doc_id, text)."""
    path = path or default_vocabulary()

    def run(batches):
        for b in _gathered(batches):
            out = []
            for d, ids in zip(b["doc_id"], encode(list(b["text"]), path)):
                for k, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                    part = ids[at: at + 4 * CAPACITY]
                    out.append((d, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place_pieces(cut: DataFrame) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a length of at most `CAPACITY`."""
    cut = written(cut)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}   # at most CAPACITY rows
    where = ranges(patterns(counts))
    salts = max(1, -(-max(counts.values(), default=1) // RANKED))
    d = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (d.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("k"))
            .select("length", "salt", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base")))
    row = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    d = d.withColumn("row", row).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("row") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = lambda x, r: x.astype(np.int64) * (1 << 48) + r
        r = rank.to_numpy()
        at = where[np.searchsorted(key(where[:, 0], where[:, 1]), key(length.to_numpy(), r), side="right") - 1]
        k = r - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 3] + k // at[:, 2], "offset": at[:, 4] + k % at[:, 2] * at[:, 0]})

    d = d.withColumn("at", place("length", "rank"))
    return d.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    return place_pieces(pieces(docs, path))
