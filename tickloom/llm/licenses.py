"""License scan by recognised sentences.

A text is cut into sentences: the lines of a paragraph are joined first, whatever comment signs they start with; a sentence
ends at a full stop before white space, at a colon that ends a line and at an empty line; an SPDX tag is a line of its own. Each is normalised (lower case,
anything but letters, digits and dots becomes one space), and known licence sentences are mapped to identifiers: tags, grants
and titles of the licences below, and `terms` for the standard sentences around them that name no licence of their own.
Patterns leave room for quotes, definitions and further clauses. Sentences that speak of a licence without being known become
`unknown`. The identifiers of a document, in order, are matched against ordered licence rules; a rule takes its identifiers
out of the sequence, so that what a more specific rule used cannot match a later one. Everything is DataFrame functions, and
only texts that hold one of a few words are cut into sentences at all.

Defined results: null, empty and other texts without licence sentences have an empty sequence and the licence `none`.
The registered SQL knows one-line sentences in one wording each (SQL_SENTENCES) and must agree on texts that hold no others.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# what comes before the name of a licence in a grant, or nothing in a title
_BY = r"(^|\b(under|governed by|covered by|terms of|conditions of|subject to|licen[sc]e|licen[sc]ed|licen[sc]ing)\b.{0,200})\b"
_UNDER = r"\b(under|licen[sc]ed?)( the| a| an| of| terms)*"
_L = r"licen[sc]e"
_V = r" ?(\b(version|ver|v)\b ?|v)?"
_LATER = r"\b.{0,200}\b(or later|or newer|or at your option any later|any later version|or any later|later versions?)\b"


def _gnu(key: str, name: str, short: str, versions: tuple[str, ...]) -> tuple[tuple[str, str], ...]:
    """Identifiers key+version(later) and key for a GNU licence; a grant may say the version before or after the name."""
    out = []
    for v in versions:
        n = v.replace(".", r"\.") if "." in v else rf"{v}(\.0)?"
        said = rf"({_BY}{name}\b(?! version).{{0,200}}?\b(version|v) ?{n}\b|{_BY}(version|v) ?{n} of the {name}\b|{_BY}{name}{_V}{n}\b|{_BY}{short} ?(version |v)?{n}\b)"
        k = key + v.replace(".", "")
        out += [(k + "later", rf"({said}{_LATER}|{_BY}{short} ?(version |v)?{n}( or later|\+))"), (k, said)]
    return (*out, (key, rf"{_BY}({name}|{short} {_L})\b"))


def _tag(expression: str) -> str:
    return rf"\bspdx {_L} identifier {expression}$"


# fixed values: sentence identifier and the pattern of the normalised sentence, the first that matches counts
SENTENCES = (
    ("unknown", rf"\b(not|never|no longer)( be| been)? ({_L}d|released|distributed|available|covered|governed)( [a-z]+)? (under|by)\b"),
    # standard sentences around a grant
    ("terms", r"^(the )?above copyright notice and this permission notice\b"),
    ("terms", rf"\b(may obtain|should have received|find) a copy of the (gnu (lesser |library |affero )?general public |apache |mozilla public )?{_L}\b"),
    ("terms", rf"\bunless required by applicable law\b.*\bunder the {_L}\b"),
    ("terms", rf"\bsee the (gnu (lesser |library |affero )?general public )?{_L} for (the specific language|more details)\b"),
    ("terms", rf"\b(if not )?see http(s)? www\.gnu\.org {_L}s\b"),
    ("terms", rf"^if a copy of the mpl was not distributed\b|^if not write to the free software foundation\b"),
    ("bsdname", r"\bneither the names? of\b.*\bmay be used to endorse or promote\b"),
    ("bsdsource", r"\bredistributions of source code must retain\b"),
    ("bsdbinary", r"\bredistributions in binary form must reproduce\b"),
    # tags
    ("apachemit", _tag(r"(mit or apache 2\.0|apache 2\.0 or mit)")),
    ("apache2", _tag(r"apache 2\.0")), ("mit", _tag("mit")), ("isc", _tag("isc")), ("bsd2", _tag("bsd 2 clause")), ("bsd3", _tag("bsd 3 clause")),
    ("mpl2", _tag(r"mpl 2\.0")), ("unlicense", _tag("unlicense")), ("cc0", _tag(r"cc0 1\.0")),
    *((f"{g}{v.replace('.0', '').replace('.', '')}{later}", _tag(rf"{g} {v}{end}".replace(".", r"\.")))
      for g, vs in (("agpl", ("3.0",)), ("lgpl", ("2.1", "3.0")), ("gpl", ("2.0", "3.0"))) for v in vs for later, end in (("later", "( or later)"), ("", "( only)?"))),
    *((f"cc{k.replace(' ', '')}{v[0]}{'' if v == '4.0' else '0'}", _tag(rf"cc {k} {v}".replace(".", r"\."))) for k in ("by nc sa", "by nc nd", "by nc", "by sa", "by nd", "by") for v in ("4.0", "3.0")),
    ("unknown", rf"\bspdx {_L} identifier\b"),
    # grants and titles
    ("apachemit", rf"{_UNDER}( either| both| dual)*( the| of)* (apache\b.{{0,80}}\b(or|and)\b.{{0,60}}\bmit|mit\b.{{0,60}}\b(or|and)\b.{{0,60}}\bapache( {_L})?{_V}2(\.0)?)\b"),
    *_gnu("agpl", "(gnu )?affero general public licen[sc]e", "(gnu )?agpl", ("3",)),
    *_gnu("lgpl", "(gnu )?(lesser|library) general public licen[sc]e", "(gnu )?lgpl", ("2.1", "3", "2")),
    *_gnu("gpl", "(gnu )?general public licen[sc]e", "(gnu )?gpl", ("3", "2")),
    ("gpl3later", rf"^either version 3 of the {_L} or at your option any later version$"),
    ("gpl2later", rf"^either version 2 of the {_L} or at your option any later version$"),
    ("apache2", rf"{_BY}apache( software)? {_L}{_V}2(\.0)?\b|{_BY}apache{_V}2(\.0)? {_L}\b|{_UNDER} apache{_V}2(\.0)?\b"),
    *((f"cc{k.replace(' ', '')}{v}{'' if v == '4' else '0'}", rf"{_BY}(cc {k}{_V}{v}\.0\b|creative commons {w}\b.*\b{v}\.0\b)|\bcreativecommons\.org licenses {k} {v}\.0\b")
      for k, w in (("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(ative)?s"), ("by nc", "attribution non ?commercial(?! (share|no))"),
                   ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(ative)?s"), ("by", "attribution(?! (non|share|no))")) for v in ("4", "3")),
    ("cc0", rf"{_BY}(cc0\b|creative commons (zero|cc0)\b)"),
    ("mpl2", rf"{_BY}(mozilla public {_L}|mpl){_V}2(\.0)?\b"),
    ("bsd3", rf"{_BY}((bsd )?(3|three) clause bsd|bsd (3|three) clause|(new|modified|revised) bsd)\b"),
    ("bsd2", rf"{_BY}((bsd )?(2|two) clause bsd|bsd (2|two) clause|(simplified|freebsd) bsd)\b"),
    ("bsd", rf"{_BY}bsd( style)? {_L}\b|{_UNDER} bsd\b"),
    ("mit", rf"{_BY}(mit|expat)( x11| expat)? {_L}\b|\b(released|licen[sc]ed|distributed|available|published) under( the)?( terms of)?( the)? mit\b"),
    ("isc", rf"{_BY}isc {_L}\b"),
    ("unlicense", rf"^this is free and unencumbered software released into the public domain$|{_BY}the unlicense\b"),
    ("mitgrant", r"\bpermission is hereby granted free of charge to any person obtaining a copy\b"),
    ("iscgrant", r"\bpermission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted\b"),
    ("bsdgrant", r"\bredistribution and use in source and binary forms\b.*\bare permitted\b"),
    ("allrights", r"\ball rights reserved\b"),
    ("terms", r"^https? (www\.)?(apache|gnu|opensource|mozilla|creativecommons)\.org\b"),
    ("terms", rf"\b(may not use this (file|work|software|program|project|package|library)|use of this file) .*\bin compliance with the {_L}\b"),
)


def _after(licence: str, title: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """A GNU version that is told in a sentence of its own after the name."""
    return ((f"{licence}-3.0-or-later", (title, "gpl3later")), (f"{licence}-2.0-or-later", (title, "gpl2later")))


# fixed values: licence and the sequence of identifiers it takes, the more specific rules first; without a name nothing is said
RULES = (
    ("GPL-3.0-or-later", ("gpl3", "gpl3later")),
    ("GPL-2.0-or-later", ("gpl2", "gpl2later")),
    *_after("AGPL", "agpl"), *_after("LGPL", "lgpl"), *_after("GPL", "gpl"),
    *(("BSD-3-Clause", (*head, "bsdgrant", "bsdsource", "bsdbinary", "bsdname")) for head in (("bsd3", "allrights"), ("bsd3",), ("bsd", "allrights"), ("bsd",), ("allrights",), ())),
    *(("BSD-2-Clause", (*head, "bsdgrant", "bsdsource", "bsdbinary")) for head in (("bsd2", "allrights"), ("bsd2",), ("bsd", "allrights"), ("bsd",), ("allrights",), ())),
    ("BSD", ("allrights", "bsdgrant")),
    ("MIT OR Apache-2.0", ("apachemit",)),
    ("Apache-2.0", ("apache2",)),
    ("AGPL-3.0-or-later", ("agpl3later",)),
    ("AGPL-3.0-only", ("agpl3",)),
    ("AGPL", ("agpl",)),
    ("LGPL-2.1-or-later", ("lgpl21later",)),
    ("LGPL-2.1-only", ("lgpl21",)),
    ("LGPL-3.0-or-later", ("lgpl3later",)),
    ("LGPL-3.0-only", ("lgpl3",)),
    ("LGPL-2.0-or-later", ("lgpl2later",)),
    ("LGPL-2.0-only", ("lgpl2",)),
    ("GPL-3.0-or-later", ("gpl3later",)),
    ("GPL-3.0-only", ("gpl3",)),
    ("GPL-2.0-or-later", ("gpl2later",)),
    ("GPL-2.0-only", ("gpl2",)),
    ("GPL", ("gpl",)),
    ("LGPL", ("lgpl",)),
    *((f"CC-{k}-{v}.0", (f"cc{k.replace('-', '').lower()}{v}{'' if v == '4' else '0'}",)) for k in ("BY-NC-SA", "BY-NC-ND", "BY-NC", "BY-SA", "BY-ND", "BY") for v in ("4", "3")),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl2",)),
    ("MIT", ("mit", "allrights", "mitgrant")),
    ("MIT", ("mit", "mitgrant")),
    ("MIT", ("mit",)),
    ("MIT", ("mitgrant",)),
    ("ISC", ("isc", "iscgrant")),
    ("ISC", ("isc",)),
    ("ISC", ("iscgrant",)),
    ("Unlicense", ("unlicense",)),
    ("BSD-3-Clause", ("bsd3",)),
    ("BSD-2-Clause", ("bsd2",)),
    ("BSD", ("bsd",)),
    ("BSD", ("bsdgrant",)),
    ("proprietary", ("allrights",)),
)
# fixed values: words of sentences that speak of a licence, and of those that do only in a known wording
HINT = r"licen[sc]|rights\s+reserved|permission|redistribution|\bgnu\b"
ALSO = r"creative\s+commons|\bcc0\b|\bcc[ -]by\b|\bbsd\b|\bmpl\b|\b[al]?gpl|public\s+domain|redistributions|copy\s+of\s+the|neither\s+the\s+name|free\s+software|either\s+version"
WORDS = ("licen", "rights", "permission", "redistribution", "gnu", "creative", "cc0", "cc by", "cc-by", "bsd", "mpl", "gpl", "public", "copy", "neither", "software", "either")
CUT = r"\.\s+|\n *\n|\.$"


# fixed values of the registered SQL
SQL_SENTENCES = (
    ("apache2", r"^licensed under the apache license version 2(\.0)?$"),
    ("gpl3", r"^this work is licensed under the gnu general public license version 3$"),
    ("gpl3later", r"^either version 3 of the license or at your option any later version$"),
    ("gpl2", r"^this work is licensed under the gnu general public license version 2$"),
    ("lgpl", r"^.*gnu lesser general public license.*$"),
    ("ccbync4", r"^licensed under cc by nc 4\.0$"),
    ("ccby4", r"^licensed under cc by 4\.0$"),
    ("mit", r"^released under the mit license$"),
    ("mitgrant", r"^permission is hereby granted free of charge to any person obtaining a copy.*$"),
    ("bsdgrant", r"^redistribution and use in source and binary forms.*are permitted.*$"),
    ("allrights", r"^all rights reserved$"),
)
SQL_RULES = (
    ("GPL-3.0-or-later", ("gpl3", "gpl3later")),
    ("BSD", ("allrights", "bsdgrant")),
    ("Apache-2.0", ("apache2",)),
    ("GPL-3.0-only", ("gpl3",)),
    ("GPL-2.0-only", ("gpl2",)),
    ("LGPL", ("lgpl",)),
    ("CC-BY-NC-4.0", ("ccbync4",)),
    ("CC-BY-4.0", ("ccby4",)),
    ("MIT", ("mit", "mitgrant")),
    ("MIT", ("mit",)),
    ("MIT", ("mitgrant",)),
    ("BSD", ("bsdgrant",)),
    ("proprietary", ("allrights",)),
)
SQL_HINT = r"licen[sc]e|rights reserved|permission|redistribution|gnu "
SQL_CUT = r"\. |\.?\n|\.$"


def normalised(text: Column) -> Column:
    """Lower case with one space between words; line ends stay, a colon before one becomes a full stop."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"\r\n?", "\n"), r":[ \t]*\n", ".\n")
    t = F.regexp_replace(t, r"spdx-license-identifier:[^\n]*", "\n\n$0\n\n")
    t = F.regexp_replace(F.regexp_replace(t, r"\b(v|ver|vers)\.\s*(?=[0-9])", "version "), r"(?<=gpl)([ -]?v?[0-9](\.[0-9])?)\+", "$1 or later")
    return F.regexp_replace(t, r"[^a-z0-9.\n]+", " ")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order."""
    parts = F.transform(F.split(normalised(text), CUT, -1), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    parts = F.filter(parts, lambda s: s.rlike(f"{HINT}|{ALSO}"))

    def name(s):
        out = F
        for key, pattern in SENTENCES:
            out = out.when(s.rlike(pattern), key)
        return out.when(s.rlike(HINT), "unknown")

    found = F.filter(F.transform(parts, name), lambda k: k.isNotNull())
    low, some = F.lower(text), F.lit(False)
    for w in WORDS:                                    # cheap, so that few texts meet the expressions
        some = some | low.contains(w)
    return F.when(some & low.rlike(f"{HINT}|{ALSO}"), found).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """Licences whose rules match the identifier sequence ';a;b;', in rule order, joined by commas."""
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit("".join(f";{k};" for k in seq)).alias("want")) for licence, seq in (*RULES, ("unknown", ("unknown",)))])
    start = F.struct(F.concat(F.lit(";"), F.array_join(ids, ";;"), F.lit(";")).alias("left"), F.array().cast("array<string>").alias("names"))

    def take(acc, rule):
        found = F.instr(acc["left"], rule["want"]) > 0
        return F.struct(F.replace(acc["left"], rule["want"], F.lit("|")).alias("left"), F.when(found, F.array_append(acc["names"], rule["licence"])).otherwise(acc["names"]).alias("names"))

    out = F.array_join(F.array_distinct(F.aggregate(rules, start, take)["names"]), ",")
    return F.when((F.size(ids) == 0) | (out == ""), "none").otherwise(out)


def query(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), licences(F.col("ids")).alias("licence"))


def oracle() -> str:
    """The registered SQL: one-line sentences in one wording each."""
    case = " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in SQL_SENTENCES)
    left, names = "concat(';', array_to_string(ids, ';;'), ';')", []
    steps = []
    for i, (licence, seq) in enumerate(SQL_RULES):
        want = "".join(f";{k};" for k in seq)
        steps.append(f"l{i + 1} AS (SELECT *, replace(x{i}, '{want}', '|') AS x{i + 1} FROM l{i})")
        names.append(f"CASE WHEN contains(x{i}, '{want}') THEN '{licence}' END")
    names.append(f"CASE WHEN contains(x{len(SQL_RULES)}, ';unknown;') THEN 'unknown' END")
    kept = f"list_filter([{', '.join(names)}], lambda x: x IS NOT NULL)"
    once = f"list_filter({kept}, lambda x, i: list_position({kept}, x) = i)"
    return f"""WITH cut AS (SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '{SQL_HINT}') THEN
 list_transform(list_filter(list_transform(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9.\\n]+', ' ', 'g'), '{SQL_CUT}'),
 lambda x: trim(x)), lambda x: regexp_matches(x, '{SQL_HINT}')), lambda s: CASE {case} ELSE 'unknown' END) ELSE [] END AS ids FROM documents),
 l0 AS (SELECT *, {left} AS x0 FROM cut), {', '.join(steps)}
 SELECT doc_id::BIGINT AS doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
 CASE WHEN len({kept}) = 0 THEN 'none' ELSE array_to_string({once}, ',') END AS licence FROM l{len(SQL_RULES)}"""
