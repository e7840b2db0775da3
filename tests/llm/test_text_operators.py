"""Each operator against a brute-force answer on documents with nulls, empties, ties, repeats and clashing columns."""
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tickloom.llm import langid, licenses, merkle, minhash, mixing, packing, secret_scan, suffixes, toxicity


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(rows):
    """Components by comparing all pairs: row index -> smallest id."""
    sets, boss = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                boss[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [least.get(find(i)) for i in range(len(rows))]


def test_minhash_components(docs, rows):
    want = collections.Counter((r[0], len(shingle_set(r[1])), c if shingle_set(r[1]) else r[0]) for r, c in zip(rows, linked(rows)))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.query(docs).collect())
    assert got == want


def test_minhash_stage_keeps_one_of_each_group(docs, rows):
    out = minhash.stage(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    mine = [r for r in got if shingle_set(r[1])]
    # what is kept links with nothing that is kept, and every row links to something kept: one row a group of texts
    sets = [shingle_set(r[1]) for r in mine]
    assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    groups = {}
    for r, c in zip(rows, linked(rows)):
        if shingle_set(r[1]):
            groups.setdefault((c, frozenset(shingle_set(r[1])) if c in (5, None) else 0), []).append(r)
    assert len(mine) == len(groups)
    assert {"another text under a known id", "no id here but words enough for it"} <= {r[1] for r in mine}
    assert sorted(r[0] for r in mine if r[0] is not None) == sorted(c for c, _ in groups if c is not None)
    assert sum(not shingle_set(r[1]) for r in got) == sum(not shingle_set(r[1]) for r in rows)


def test_minhash_repeated_id_with_unlike_texts(spark):
    """A and B share an id and nothing else; near copies of B under other ids lose to B, not to A."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, b + " more"), (None, b + " less"), (None, "only without an id here"), (None, "only without an id here")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.query(d).collect()}
    assert got == {(1, 56, 1), (2, 57, 1), (None, 57, 1), (None, 1, None)}
    assert sorted(minhash.stage(d).collect(), key=str) == sorted([(1, a), (1, b), (None, "only without an id here")], key=lambda r: str(spark.createDataFrame([r], d.schema).first()))


def test_minhash_large_group_of_variants(spark):
    """Copies that are near the threshold of each other: blocks must find links that no star finds."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for at in rng.choice(150, rng.integers(0, 9), replace=False):
            w[at] = f"e{rng.integers(1e9)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(260)] == linked(rows)


def test_minhash_block_finds_all_joins():
    import pandas as pd
    s = {i: np.sort(np.array([k + i for k in range(40)], np.uint64)) for i in range(12)}
    pdf = pd.DataFrame([{"query": q, "node": i, "component": i, "shingles": s[i].tobytes()} for i in s for q in (True, False)])
    out = minhash._block(pdf)
    assert len(out) == 11                                      # neighbours overlap by 39 of 41: one chain


def test_connected_components(spark):
    from tickloom.llm.common import connected_components
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 5000), (5000, 2000)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(301)) and {got[k] for k in (1000, 2000, 5000)} == {1000}


def test_language(docs, rows):
    got = langid.query(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(88, "und"), (89, "und"), (90, "und"), (91, "und")} <= by
    right = [r.lang_pred == rows[r.doc_id][2] for r in got if r.doc_id is not None and r.doc_id < 60 and r.held_out and r.lang_pred != "und"]
    assert np.mean(right) >= 0.9
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def test_language_stage(docs):
    kept = langid.stage(docs, 0.3)
    assert kept.columns == docs.columns
    assert not {88, 89, 90, 91} & {r.doc_id for r in kept.select("doc_id").collect()}


def test_ngram_counts_do_not_depend_on_slices(monkeypatch):
    text = "Größe, the 12 niños" * 40
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "SLICE", 17)
    parts = langid.counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_secrets(docs, rows):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = []
    for r in rows:
        t = r[1] or ""
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
        want.append((r[0], *(sum(f[2] == k for f in found) for k in ("assign", "access", "hex")), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r)[:5] for r in secret_scan.query(docs).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert sum(w[1] for w in want) == 2 and sum(w[2] for w in want) == 1


@pytest.mark.parametrize("piece", [1, 5, 1 << 20])
def test_postings_are_those_of_a_plain_search(piece, monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", piece)
    texts = ["", "to", "Token=abcdef", "\u00e9token\u00e9", "tok", "en to ken", "ak", "ia akia", "x" * 50 + "TOKEN", "\u212aen"]
    tris = ["tok", "oke", "ken", "aki", "n t", "zzz"]
    named = np.zeros(1 << 24, bool)
    named[[secret_scan.code(t) for t in tris]] = True
    for shard in (secret_scan.Shard(texts, named), secret_scan.Shard(texts)):
        for t in tris:
            assert shard(t).tolist() == [i for i, x in enumerate(texts) if t.encode() in x.encode().lower()]
    assert secret_scan.Shard([])("tok").tolist() == []


def test_very_long_text_with_secrets_at_both_ends():
    text = "password=hunter22 " + "plain words " * 400_000 + "api_key: abcdef1"
    (spans,) = secret_scan.scan([text])
    assert [(s, k, e) for s, _, k, e, _ in spans] == [(0, "assign", 17), (len(text) - 16, "assign", len(text))]


def test_secret_stage_changes_only_texts_with_secrets(docs, rows):
    out = secret_scan.stage(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert "[assign]" in got[95].text and "0641917ea" not in got[95].text and got[95].n_chars == len(got[95].text)
    assert got[88].text is None and got[0].text == rows[0][1]


@pytest.mark.parametrize("pattern,yes,no", [(r"abc[0-9]+", "xxabc1", "xxab1"), (r"(foo|bar)d?end", "bardend", "foodenx"), (r"x*secret", "secret", "secre"), (r"a[bc]{2}defg", "zdefg", "dxefg")])
def test_trigram_query(pattern, yes, no):
    shard = secret_scan.Shard([yes, no])
    at = secret_scan.evaluate(secret_scan.trigram_query(pattern), shard, np.arange(2))
    assert at.tolist() == [0]


def test_rules_without_mandatory_trigrams_scan_fully():
    assert secret_scan.trigram_query(r"[0-9a-f]{24,}") == secret_scan.ALL
    assert secret_scan.trigram_query(r"ab?c?") == secret_scan.ALL


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_vocabulary())
    want = collections.Counter()
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for i in range(0, len(ids), 4096):
            want[(r[0], i // 4096, i, len(ids[i:i + 4096]), zlib.crc32(ids[i:i + 4096].tobytes()))] += 1
    got = packing.query(docs).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    at = collections.defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 4096
    assert len(at) <= -(-sum(r.length for r in got) // 4096) + 1


@pytest.mark.parametrize("text", ["İstanbul ΣΑΣ. <|endoftext|> don't áb c", "x.,y !!!? 12a\t\tb\r\nc", "ﬁne Ǆ ẞ ＡＢ 한글", "a" * 300 + " it's ... we'll", " ".join("Word%d" % i for i in range(50))])
def test_words_encode_as_the_whole_text(text, monkeypatch):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_vocabulary())
    want = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert packing.encode([text], packing.default_vocabulary()) == [want]
    monkeypatch.setattr(packing, "SLICE", 7)
    assert packing.encode([text], packing.default_vocabulary()) == [want]


def test_patterns_place_every_piece():
    rng = np.random.default_rng(1)
    counts = dict(collections.Counter(rng.integers(1, 4097, 5000).tolist() + [1000] * 3000))
    found = packing.patterns(counts)
    used = collections.Counter()
    for use, times in found:
        assert sum(x * k for x, k in use.items()) <= 4096
        for x, k in use.items():
            used[x] += k * times
    assert used == collections.Counter(counts)
    assert sum(t for _, t in found) <= 1.03 * sum(x * k for x, k in counts.items()) / 4096


def test_repeated_strings(docs, rows):
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i:i + 400] for t in texts for i in range(len(t) - 399))
    want = collections.Counter()
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 399):
            if seen[t[i:i + 400]] > 1:
                gone[i:i + 400] = True
        gone = gone[:len(t)]
        left = bytes(b for b, g in zip(t, gone) if not g)
        want[(r[0], len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(left).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in suffixes.query(docs).collect()) == want
    assert sum(w[2] > 0 for w in want) > 20


def test_repeats_inside_one_text_and_small_shifts(spark):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghij "))
    make = lambda n: "".join(rng.choice(letters, n))
    p, q = make(400), make(399)
    rows = [(1, make(77) + p + make(5) + p), (2, make(3) + q), (3, q + make(9)), (4, "é" * 400), (5, make(450)), (6, "z" * 900), (7, p[:399])]
    texts = {i: t.encode() for i, t in rows}
    seen = collections.Counter(t[i:i + 400] for t in texts.values() for i in range(len(t) - 399))
    got = {r.doc_id: r for r in suffixes.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in texts.items():
        gone = set()
        for k in range(len(t) - 399):
            if seen[t[k:k + 400]] > 1:
                gone |= set(range(k, k + 400))
        assert got[i].n_removed == len(gone), i
        assert got[i].kept_sha256 == hashlib.sha256(bytes(b for k, b in enumerate(t) if k not in gone)).hexdigest()


def test_cover_is_a_perfect_difference_set():
    d = suffixes.cover()
    assert len(d) == 12
    assert collections.Counter(int((a - b) % 133) for a in d for b in d if a != b) == collections.Counter(range(1, 133))


def test_slices_give_the_same_names(monkeypatch):
    data = bytes(np.random.default_rng(3).integers(97, 101, 5000, dtype=np.uint8))
    whole, runs = suffixes.samples(data), suffixes.long_names(data, [(3, 4000)])
    monkeypatch.setattr(suffixes, "FILLED", 700)
    assert all((x == y).all() for x, y in zip(whole, suffixes.samples(data)))
    assert all((x == y).all() for x, y in zip(runs, suffixes.long_names(data, [(3, 4000)])))


def test_fingerprints(docs, rows):
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))
    want = collections.Counter()
    for k, (has, i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        half = len(t) // 2
        new = t[:len(t) - half] + after[:half]
        want[(i if has else None, len(t), hashlib.sha256(new.encode()).hexdigest(), merkle.fingerprint(t), merkle.fingerprint(new))] += 1
    got = merkle.query(docs).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 600 and r.near_next < 0.2]
    assert np.mean([r.near_edited for r in long]) > 0.3


def test_merkle_locates_edits():
    a = "\n".join(f"line {i} of the text" for i in range(50))
    b = a.replace("line 30 of", "line thirty of")
    s, e = merkle.differing(a, b)
    assert a[s:e] == "line 30 of the text" and merkle.differing(a, a) is None
    assert merkle.root(a) != merkle.root(b) and merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(a)) == 1
    assert 0.8 < merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) < 1
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint(" ")) == 1.0 and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("a")) == 0.0


def test_licences(docs):
    got = {r.doc_id: r for r in licenses.query(docs).collect()}
    assert (got[94].sentence_ids, got[94].licence, got[94].n_sentences) == ("apache2,allrights", "Apache-2.0,proprietary", 2)
    assert got[88].licence == "none" and got[89].n_sentences == 0


def test_licences_in_hard_wrapped_standard_texts(spark):
    apache = ('# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n'
              '#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an "AS IS" BASIS,\n'
              '# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language governing permissions and\n# limitations under the License.\n')
    gpl = (' * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU {}General Public License as published by\n * the Free Software Foundation; either version {} of the License, or\n'
           ' * (at your option) any later version.\n *\n * This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n'
           ' * GNU {}General Public License for more details.\n *\n * You should have received a copy of the GNU {}General Public License\n * along with this program.  If not, see <http://www.gnu.org/licenses/>.\n')
    mit = ('MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction.\n\n'
           'The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n')
    bsd = ('Copyright (c) 2010, Some One\nAll rights\nreserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n'
           '    * Redistributions of source code must retain the above copyright\n      notice, this list of conditions and the following disclaimer.\n    * Redistributions in binary form must reproduce the above copyright\n      notice.\n')
    name = '    * Neither the name of the holder nor the\n      names of its contributors may be used to endorse or promote products\n      derived from this software without specific prior written permission.\n'
    isc = 'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n'
    mpl = 'This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.\n'
    want = [(apache, "Apache-2.0"), (apache.replace("# ", "").replace("#", "").replace("\n", "\r\n"), "Apache-2.0"), (gpl.format("", "3", "", ""), "GPL-3.0-or-later"), (gpl.format("", "2", "", ""), "GPL-2.0-or-later"),
            (gpl.format("Lesser ", "2.1", "Lesser ", "Lesser "), "LGPL-2.1-or-later"), (gpl.format("Affero ", "3", "Affero ", "Affero "), "AGPL-3.0-or-later"),
            ("it under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", "GPL-2.0-only"), (mit, "MIT"), (bsd, "BSD-2-Clause"), (bsd + name, "BSD-3-Clause"), (isc, "ISC"), (mpl, "MPL-2.0"),
            ("words before\nthis work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"),
            ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("// SPDX-License-Identifier: GPL-2.0+\n// Copyright 2020 Some One\nint x;", "GPL-2.0-or-later"),
            ("/* SPDX-License-Identifier: BSD-3-Clause */\nint x;", "BSD-3-Clause"), ("# SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
            ("Licensed under either of the Apache License, Version 2.0\nor the MIT license at your option.", "MIT OR Apache-2.0"), ("Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "BSD"),
            ("This is not licensed under the MIT License.", "unknown"), ("The licence fee is due in May.", "unknown"), ("Apache 2.0 is a web server. BSD systems are old. The GPL.", "none")]
    got = licenses.query(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(want)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.licence, r.sentence_ids if r.licence != want[r.doc_id][1] else "") for r in got} == {(i, y, "") for i, (_, y) in enumerate(want)}


def test_segments_are_maximal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = np.round(rng.normal(-0.3, 1, rng.integers(1, 40)), 1)
        found = sorted(toxicity.segments(x), key=lambda s: -s[2])
        assert all(math.isclose(x[s:e].sum(), v, abs_tol=1e-9) and v > 0 for s, e, v in found)
        spans = sorted((s, e) for s, e, _ in found)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        best = max((x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1)))
        assert math.isclose(found[0][2], best, abs_tol=1e-9) if best > 0 else not found
        covered = {k for s, e, _ in found for k in range(s, e)}
        assert all(k in covered for k in np.flatnonzero(x > 0))


def test_segment_scan_is_linear_on_falling_runs():
    """Hits whose sums fall from one to the next leave every segment apart; a last high one then swallows none or all."""
    x = np.tile([1.0, -1.5], 100_000)
    assert len(toxicity.segments(x)) == 100_000
    assert toxicity.segments(np.r_[np.tile([1.0, -0.9], 100_000), 5.0])[0][:2] == (0, 200_001)


def test_no_token_of_the_lexicon_is_cut_before_its_corpus_count():
    rng = np.random.default_rng(11)
    n_bad, n_good = 2000, 38000
    y = np.concatenate([rng.integers(5, 40, 300), rng.integers(40, n_bad + 1, 300), [1000, 5, n_bad]]).astype(float)
    g = np.concatenate([rng.integers(0, 60, 300), rng.integers(0, n_good + 1, 300), [15000, 0, 0]]).astype(float)
    can = toxicity.can_stand_out(y, g, n_bad, n_good)
    best = np.full(len(y), -np.inf)
    for a in np.geomspace(1e-9, toxicity.PRIOR, 5000):
        odds = np.log((y + a) / np.maximum(n_bad + toxicity.PRIOR - y - a, .5)) - np.log((g + a) / np.maximum(n_good + toxicity.PRIOR - g - a, .5))
        best = np.maximum(best, odds / np.sqrt(1 / (y + a) + 1 / (g + a)))
    assert can[best >= toxicity.CLEAR].all() and can[600] and not can[best < toxicity.CLEAR - 1.5].any() and not can.all()


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    vocab = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(900):
        bad = i % 7 == 0
        w = list(rng.choice(vocab, 60))
        for _ in range(3 * bad):
            w[rng.integers(60)] = rng.choice(["vilest", "awfulness", "nastier"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    rows += [(None, None), (901, ""), (902, "vilest awfulness vilest nastier"), (902, "vilest awfulness vilest nastier")]
    d, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (901, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.query(d, m).collect()
    assert len(got) == len(rows)
    right = [r.predicted == int(r.doc_id % 7 == 0) for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert np.mean(right) > 0.97
    assert all(r.predicted == 1 for r in got if r.doc_id == 902) and [r.predicted for r in got if r.doc_id == 901] == [0]
    none = toxicity.query(d, m.where("toxic > 5")).collect()
    assert len(none) == len(rows) and not any(r.predicted for r in none)


def test_frequent_weak_words_do_not_hide_short_insults(spark):
    """Of two languages one holds more of the toxic texts, so all its words lean slightly: long texts in it must not outdo two insults."""
    rng = np.random.default_rng(8)
    vocab = [[f"{a}{b}{c}" for a in "bdfgklmnpr" for b in "aeiou"] for c in "xq"]
    rows, marks = [], []
    for i in range(4000):
        bad = i % 5 == 0
        w = list(rng.choice(vocab[int(rng.random() < (0.35 if bad else 0.6))], int(rng.choice([8, 15, 400]))))
        if bad and i % 2:
            w[3:5] = ["vilest", "awfulness"]
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    d, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = [r for r in toxicity.query(d, m).collect() if r.held_out]
    line = np.quantile([r.score for r in got if r.doc_id % 5], 0.9)
    assert np.mean([r.score > line for r in got if r.doc_id % 10 == 5]) > 0.9


def test_mixing(docs, rows):
    got = mixing.query(docs).collect()
    tokens = collections.Counter()
    for r in rows:
        tokens[r[3]] += len((r[1] or "").split())
    total = sum(tokens.values())
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.n_tokens
        assert 0 <= r.place < 1
    weights = {r.source: r.weight for r in got}
    assert math.isclose(sum(weights.values()), 1, abs_tol=1e-9)
    longest = max(len((r[1] or "").split()) for r in rows)
    for s, w in weights.items():
        assert w * total - 1e-6 <= taken[s] <= w * total + longest
        assert w * total <= 3.0 * tokens[s] + 1e-6
    # the exponent: weights are powers of the shares
    logs = [(math.log(tokens[s]), math.log(weights[s])) for s in weights]
    (x0, y0), (x1, y1) = min(logs), max(logs)
    a = (y1 - y0) / (x1 - x0)
    assert 0 <= a <= 1 and all(math.isclose(y, y0 + a * (x - x0), abs_tol=1e-6) for x, y in logs)


def test_mixing_exponent_meets_its_target(spark):
    s = spark.createDataFrame([("a", 800), ("b", 100), ("c", 60), ("d", 40)], "source string, tokens long")
    for share, reps in ((0.8, 50.0), (1.0, 2.0), (0.5, 50.0)):
        a = mixing.exponent(s, 1000.0, 1000.0, reps, share)
        p = np.array([.8, .1, .06, .04])
        h = lambda x: -(lambda w: (w * np.log(w)).sum())(p**x / (p**x).sum()) / math.log(4)
        rep = lambda x: ((p**x / (p**x).sum()) / p).max()
        assert a == 1.0 or (h(a) <= share + 1e-5 and rep(a) <= reps + 1e-4)
        assert a == 0.0 or h(a - 1e-3) > share or rep(a - 1e-3) > reps


def test_mixing_does_not_depend_on_partitions(spark, docs):
    """Quotas are whole tokens; rows, places and the stage's rows are the same for every number of partitions."""
    was, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            d = docs.repartition(n)
            seen.append((sorted(map(str, mixing.query(d).collect())), sorted(map(str, mixing.stage(d).collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1] == seen[2]


def test_mixing_quotas_add_up(spark):
    d = spark.createDataFrame([(f"s{i}", 7 * i * i + 1) for i in range(30)] + [(None, 5), ("none", 0)], "source string, n_tokens long")
    for budget, reps in ((None, 3.0), (1000, 0.5), (99_991, 50.0)):
        got = mixing.plan(d, budget, reps).collect()
        total = sum(r.tokens for r in got)
        assert sum(r.quota for r in got) == (budget or total)
        assert all(abs(r.quota - r.weight * (budget or total)) < 1 + 1e-6 for r in got)


def test_mixing_repeats_count_against_the_quota(spark):
    """A source of 90 % repeats of one row keeps to its quota, in the query and in the stage."""
    text = " ".join(["word"] * 10)
    rows = [(7, text, "big")] * 2700 + [(i, f"other {i} " + text, "big") for i in range(100, 400)] + [(i, f"small {i} text", "small") for i in range(1000, 1040)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    want = {r.source: r.quota for r in mixing.plan(d.select("source", mixing.tokens(d["text"]).alias("n_tokens"))).collect()}
    assert want["big"] < 2700 * 10 + 300 * 12
    for out in (mixing.query(d).select("source", "n_tokens"), mixing.stage(d).select("source", mixing.tokens(d["text"]).alias("n_tokens"))):
        got = {r.source: r.t for r in out.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
        assert all(want[s] <= got[s] < want[s] + 12 for s in want)


def test_mixing_stage(docs):
    out = mixing.stage(docs)
    assert out.columns == docs.columns and out.count() > 0


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (minhash.query, langid.query, secret_scan.query, packing.query, suffixes.query, merkle.query, licenses.query, mixing.query,
              lambda d: toxicity.query(d, labels), minhash.stage, langid.stage, secret_scan.stage, mixing.stage):
        assert f(empty).count() == 0
