"""Secret scan with a trigram inverted index.

Every rule's regular expression is parsed into a Boolean query over trigrams that any match must contain. One pass over the
bytes of a shard of the table (one Arrow batch) builds sorted postings of the trigrams that the queries name, the queries
intersect and unite postings, and only the surviving texts are verified by the expression itself. A rule without a mandatory trigram (long hexadecimal runs)
scans every text. Sharding the index by document means that no posting list of a frequent trigram grows with the table.

Kinds `assign`, `access` and `hex` are the base rules; the others come from public token formats. Matches are leftmost and
non-overlapping per kind, and those that miss a kind's length are dropped. Positions count code points, end exclusive.
Defined results: null text counts as empty and has no span; repeated rows repeat their result.
"""
from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass
from re import _constants as K
from re import _parser as P

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALL, NONE = ("and", ()), ("or", ())     # queries that every text and no text satisfies
WIDEST, MOST = 12, 64                   # largest class and largest set of strings kept exactly
PIECE = 1 << 20                         # bytes of a shard that are turned into trigrams at once


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0          # characters the group needs
    secret: int = 0         # group that a redaction removes


# fixed values: the base rules; `{24,}` finds the same maximal runs as `+` with shorter ones dropped
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", False, 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
BASE = ("assign", "access", "hex")


def _all(parts):
    flat = []
    for p in parts:
        if p == NONE:
            return NONE
        flat.extend(p[1] if p[0] == "and" else (p,))
    flat = tuple(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("and", flat)


def _any(parts):
    flat = []
    for p in parts:
        if p == ALL:
            return ALL
        flat.extend(p[1] if p[0] == "or" else (p,))
    flat = tuple(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("or", flat)


def _strings(found: set[str]):
    """Query for texts that hold one of `found`."""
    return _any([_all([("tri", s[i: i + 3]) for i in range(len(s) - 2)]) for s in sorted(found)])


def _walk(nodes) -> tuple[set[str] | None, tuple]:
    """(all strings the nodes can match, or None if there are too many; query their matches satisfy)."""
    run, parts, whole = {""}, [], True
    for op, arg in nodes:
        exact, query = None, ALL
        if op is K.LITERAL:
            exact = {chr(arg).lower()} if arg < 128 else None        # postings know no case beyond ASCII
        elif op is K.IN:
            chars = _members(arg)
            exact = chars if chars is not None and len(chars) <= WIDEST else None
        elif op is K.SUBPATTERN:
            exact, query = _walk(arg[3])
        elif op is K.BRANCH:
            arms = [_walk(a) for a in arg[1]]
            if all(e is not None for e, _ in arms):
                exact = set().union(*(e for e, _ in arms))
            query = _any([q if e is None else _all([q, _strings(e)]) for e, q in arms])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            e, q = _walk(inner)
            if e is not None and (low, high) == (0, 1):
                exact = e | {""}
            elif low > 0:
                query = q if e is None else _all([q, _strings(e)])
        elif op is K.AT:
            exact = {""}
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
        else:
            parts += [_strings(run), query]
            if exact is not None:
                run = exact
            else:
                whole, run = False, {""}
            whole = False
    return (run if whole else None), _all([*parts, _strings(run)]) if not whole else ALL


def _members(arg) -> set[str] | None:
    out: set[str] = set()
    for op, v in arg:
        if op is K.LITERAL and v < 128:
            out.add(chr(v).lower())
        elif op is K.RANGE and v[1] < 128:
            out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
        else:
            return None
    return out


def trigram_query(pattern: str):
    """Boolean query ('tri', t) / ('and', ...) / ('or', ...) over the lower-cased text; ALL when nothing is mandatory."""
    exact, query = _walk(P.parse(pattern))
    return _all([query, _strings(exact)]) if exact is not None else query


def evaluate(query, postings, every: np.ndarray) -> np.ndarray:
    """Sorted positions of the texts that satisfy the query."""
    op, arg = query
    if op == "tri":
        return postings(arg)
    if op == "and":
        out = every
        for q in arg:
            if not len(out):
                break
            out = np.intersect1d(out, evaluate(q, postings, every), assume_unique=True)
        return out
    return np.unique(np.concatenate([evaluate(q, postings, every) for q in arg])) if arg else every[:0]


def trigrams(query) -> set[str]:
    op, arg = query
    return {arg} if op == "tri" else set().union(*map(trigrams, arg))


def code(tri: str) -> int:
    return int.from_bytes(tri.encode(), "big")


class Shard:
    """Inverted index of one batch of texts over lower-cased (ASCII) bytes: for each trigram the sorted positions of the texts
    that hold it. `named` marks the trigrams to keep (all where it is None)."""

    def __init__(self, texts: list[str], named: np.ndarray | None = None):
        parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        ends = np.cumsum([len(p) + 1 for p in parts])
        raw = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8)          # a byte that no text holds ends each of them
        self.texts, found = max(len(texts), 1), [np.zeros(0, np.int64)]
        for k in range(0, len(raw) - 2, PIECE):
            b = raw[k: k + PIECE + 2].astype(np.int32)
            codes = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
            at = np.arange(len(codes)) if named is None else np.flatnonzero(named[codes])
            found.append(np.unique(codes[at].astype(np.int64) * self.texts + np.searchsorted(ends, at + k, "right")))
        self.keys = np.unique(np.concatenate(found))                        # by trigram, then text

    def __call__(self, tri: str) -> np.ndarray:
        first = code(tri) * self.texts
        lo, hi = np.searchsorted(self.keys, [first, first + self.texts])
        return self.keys[lo:hi] - first


def prepare(rules=RULES) -> tuple[np.ndarray, list]:
    """(marks of the trigrams that the queries name, [(rule, query, expression)])."""
    named, plan = np.zeros(1 << 24, bool), []
    for r in rules:
        query = trigram_query(r.pattern)
        named[[code(t) for t in trigrams(query)]] = True
        plan.append((r, query, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0))))
    return named, plan


def scan(texts: list[str], prepared=None) -> list[list[tuple[int, int, str, int, int]]]:
    """For each text its matches (start, rank of the kind, kind, end, start of what a redaction removes), in order."""
    named, plan = prepared or prepare()
    shard, every, found = Shard(texts, named), np.arange(len(texts)), [[] for _ in texts]
    for rank, (r, query, regex) in enumerate(plan):
        for i in evaluate(query, shard, every):
            for m in regex.finditer(texts[i]):
                if m.end(r.group) - m.start(r.group) >= r.least:
                    found[i].append((m.start(), rank, r.kind, m.end(), m.start(r.secret)))
    return [sorted(f) for f in found]


def join_spans(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e, _ in spans)


def redact(text: str, spans) -> str:
    """The text with every secret replaced by its kind in brackets; overlapping spans are one."""
    out, at = [], 0
    merged: list[list] = []
    for s, e, k in sorted((c, e, k) for _, _, k, e, c in spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*out, text[at:]])


def _rows(batches):
    prepared = prepare()
    for b in batches:
        texts = [t or "" for t in b["text"]]
        out = []
        for spans in scan(texts, prepared):
            base = [s for s in spans if s[2] in BASE]
            kinds = [s[2] for s in base]
            out.append((*(kinds.count(k) for k in BASE), hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans)))
        n = list(zip(*out)) if out else [()] * 5
        yield pd.DataFrame({"doc_id": b["doc_id"], "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": n[3], "spans": n[4]})


def query(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        _rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    plain = [t or "" for t in texts]
    return pd.Series([t if not s else redact(p, s) for t, p, s in zip(texts, plain, scan(plain))], dtype=object)


def stage(docs: DataFrame) -> DataFrame:
    """Documents with their secrets replaced by `[kind]`; `n_chars` follows where the text changed. Every row and column stays."""
    new = f"_{uuid.uuid4().hex}"
    d = docs.withColumn(new, _redacted(F.col("text").cast("string")))
    same = F.col(new).eqNullSafe(F.col("text"))
    cols = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cols["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(new).cast(kind))
    return d.select(*[cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in docs.columns])
