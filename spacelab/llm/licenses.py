"""Licence recognition by sentence rules.

A text is cut into sentences and each sentence is normalised to words: lower case, no punctuation, no articles, one
spelling of "licence", "version 2.0", "v2" and "2" all written as 2.  Phrases that licence sentences are made of lie in
one table from word sequences to identifiers, expanded from the templates below: the sentences of licence texts, the
openings of grants ("licensed under", "subject to the terms of"), and the names of licences.  At each word the longest
phrase of the table is looked up; the identifiers of a sentence are then put together by the ordered ``GRANT_RULES``,
and the sequence of identifiers of the whole document is matched against the ordered ``RULES``, the first that fits at a
place consuming it.

A sentence ends at a stop before white space or at a line without words; line ends inside it do not matter, so wrapped
sentences and sentences behind comment signs are found, and so is a grant inside a sentence of any length, unless it is
denied ("not licensed under").  A sentence of licence texts may have any words, up to ``REACH``, where its template has a star.  A licence
named before "licensed", after "under" or by the address of its text is granted too.

One pass, no shuffle; a sentence is held in runs of at most ``RUN`` words, whatever its length.  Texts in which
``NEEDED`` finds nothing hold no known phrase and are not cut.

Defined results: a null or empty text, or one without licence sentences, has empty lists; repeated rows are scanned
each; a sentence that speaks of a licence but is unknown counts in n_unknown; bytes that are not UTF-8 read as
replacement characters; a null id is passed on; an empty table gives an empty result; extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import decoded, id_type, keyed_text, lean, portions

RUN = 4096
#: Words that a phrase, its stars, the names after it and their tails may take up beyond the place where it starts.
REACH = 4096

# ----- templates: (a|b) is a choice, (a|) may be left out -----

_CHOICE = re.compile(r"\(([^()]*)\)")


def expanded(template: str) -> list[tuple[str, ...]]:
    """All word sequences of a template."""
    parts = _CHOICE.split(template)
    return [tuple(" ".join(x).split()) for x in product(*(p.split("|") if i % 2 else [p] for i, p in enumerate(parts)))]


# Names of licences and the sentences that their texts consist of, in normalised words.
_GNU = {"GPL": ("", "gpl"), "LGPL": ("(lesser|library)", "lgpl"), "AGPL": ("affero", "agpl")}
_CC_WORDS = {"BY": "attribution", "NC": "non commercial", "SA": "share alike", "ND": "no derivatives"}
_CC_KINDS = ("BY-NC-SA", "BY-NC-ND", "BY-NC", "BY-SA", "BY-ND", "BY")
_CC_VERSIONS = ("4", "3", "2.5", "2", "1")


def _names() -> dict[tuple[str, ...], str]:
    """Word sequence -> licence identifier; names without a version stand for themselves."""
    found: dict[tuple[str, ...], str] = {}

    def add(name: str, *templates: str) -> None:
        for t in templates:
            for words in expanded(t):
                found.setdefault(words, name)

    for name, (kind, short) in _GNU.items():
        long = f"(gnu|) {kind} general public license ({short}|)"
        for version in ("3", "2.1", "2"):
            add(f"{name}-{version if '.' in version else version + '.0'}", f"{long} {version} (license|)", f"(gnu|) {short} {version} (license|)",
                f"{version} of {long}", f"{version} of (gnu|) {short}")
        add(name, f"gnu {kind} general public license ({short}|)", f"(gnu|) {short} (license|)", long)
    add("Apache-2.0", "apache (software|) (license|) 2 (license|)", "2 of apache (software|) license")
    add("Apache", "apache (software|) license")
    add("MPL-2.0", "mozilla public license (mpl|) 2", "mpl 2 (license|)", "2 of mozilla public license")
    add("MPL", "mozilla public license (mpl|)", "mpl")
    add("MIT", "(mit|expat) (x11|) (license|) (mit|expat|)", "mit expat license")
    for count, word in (("2", "two"), ("3", "three")):
        named = "simplified" if count == "2" else "(new or revised|new|revised|modified)"
        add(f"BSD-{count}-Clause", f"({count}|{word}) clause bsd (license|)", f"bsd ({count}|{word}) clause {named} (license|)", f"bsd ({count}|{word}) clause (license|)",
            f"{named} bsd (license|)")
    add("BSD-2-Clause", "freebsd (license|)")
    add("BSD", "bsd license")
    add("ISC", "isc (license|)")
    add("CC0-1.0", "(cc0|cc 0|cc zero|creative commons zero|creative commons cc0|creative commons 0) (1|) (universal|) (public domain dedication|)")
    for kind in _CC_KINDS:
        short = " ".join(kind.lower().split("-"))
        long = " ".join(_CC_WORDS[p] for p in kind.split("-"))
        for version in _CC_VERSIONS:
            name = f"CC-{kind}-{version if '.' in version else version + '.0'}"
            add(name, f"(cc|creative commons) ({short}|{long}) (license|) {version}", f"{long} {version} (international|unported|generic)")
        add(f"CC-{kind}", f"(cc|creative commons) ({short}|{long})")
    add("Unlicense", "unlicense")
    add("BSL-1.0", "boost software license (1|)", "bsl 1")
    add("Zlib", "zlib (libpng|) (license|)")
    return found


NAMES = _names()
#: Openings of grants; ``label`` counts at the start of a line, ``uses`` only before a name that says "license" or a version.
_TERMS = "(terms of|terms and conditions of|conditions of|) (either of|either|)"
GRANTS = {
    "grant": (f"(licensed|released|distributed|available|provided|published|shared|offered|redistributed|used|reused) (to you|) under {_TERMS}",
              f"(covered|governed) by {_TERMS}", f"(is|are) subject to {_TERMS}", f"bound by {_TERMS}",
              f"redistribute it and or modify it under {_TERMS}", "spdx license identifier",
              "(opensource.org|spdx.org|gnu.org) (licenses|license|licenses old licenses)"),
    "label": ("license",),
    "uses": ("(use|uses|using)", f"under {_TERMS}"),
}
#: Sentences of licence texts; a star stands for any words up to the next part.
SENTENCES = (
    ("mit:permission", "permission is hereby granted free of charge to any person obtaining copy of this software and associated documentation files"),
    ("mit:notice", "above copyright notice and this permission notice * shall be included in all copies or substantial portions of software"),
    ("mit:warranty", "software is provided as is without warranty of any kind"),
    ("bsd:start", "redistribution and use in source and binary forms with or without modification are permitted provided that following conditions are met"),
    ("bsd:source", "(redistributions|redistribution) of source code must retain (above|) copyright notice"),
    ("bsd:binary", "(redistributions|redistribution) in binary form must reproduce (above|) copyright notice"),
    ("bsd:endorse", "neither (name|names) of * may be used to endorse or promote products"),
    ("bsd:warranty", "this software is provided by * as is and any express or implied warranties"),
    ("isc:permission", "permission to use copy modify and (or|) distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl:hope", "distributed in hope that it will be useful but without any warranty"),
    ("gpl:copy", "you should have received copy of gnu (lesser|affero|library|) general public license along with"),
    ("apache:copyright", "subject to terms and conditions of this license each contributor hereby grants to you perpetual * copyright license to"),
    ("apache:patent", "subject to terms and conditions of this license each contributor hereby grants to you perpetual * patent license to"),
    ("apache:copy", "you may obtain copy of license at (http|https) (www.|) apache.org licenses license 2"),
    ("apache:basis", "unless required by applicable law or agreed to in writing software distributed under license is distributed on as is basis"),
    ("mpl:grant", "each contributor hereby grants you world wide royalty free non exclusive license"),
    ("mpl:copy", "if copy of mpl was not distributed with this file you can obtain one at (http|https) (www.|) mozilla.org mpl 2"),
    ("bsl:permission", "permission is hereby granted free of charge to any person or organization obtaining copy of software and accompanying documentation"),
    ("zlib:permission", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("domain", "this is free and unencumbered software released into public domain"),
    ("reserved", "all rights reserved"),
    ("copyright", "copyright (c|) (1|2)*"),
)
#: Ordered: identifiers in this order, with no other than copyright lines and warranties between, make the licence.
RULES = (
    ("MIT", ("mit:permission", "mit:notice", "mit:warranty")),
    ("MIT", ("mit:permission", "mit:notice")),
    ("MIT", ("mit:permission", "mit:warranty")),
    ("MIT", ("mit:permission",)),
    ("BSD-3-Clause", ("bsd:start", "bsd:source", "bsd:binary", "bsd:endorse")),
    ("BSD-2-Clause", ("bsd:start", "bsd:source", "bsd:binary")),
    ("ISC", ("isc:permission",)),
    ("Apache-2.0", ("apache:copyright", "apache:patent")),
    ("Apache-2.0", ("apache:copy", "apache:basis")),
    ("Apache-2.0", ("apache:copy",)),
    ("MPL-2.0", ("mpl:copy",)),
    ("BSL-1.0", ("bsl:permission",)),
    ("Zlib", ("zlib:permission",)),
    ("Unlicense", ("domain",)),
    *((name + later, (f"grant:{name}{later}",)) for name in dict.fromkeys(NAMES.values()) for later in ("", "+")),
)
_PASSED_OVER = frozenset(("copyright", "reserved", "gpl:hope", "gpl:copy", "bsd:warranty"))
_BY_FIRST: dict[str, list] = {}
for _rule in RULES:
    _BY_FIRST.setdefault(_rule[1][0], []).append(_rule)

#: What may follow a name: a later version, the publisher before the version, words that belong to the name.
LATER = dict.fromkeys((w for t in ("(of license|) or (at your option|) (any|) later (version|)", "(of license|) or newer") for w in expanded(t)), "+")
_PUBLISHED = tuple("as published by free software foundation".split())
_TAIL = frozenset("license international unported generic universal public".split())
_STYLED = frozenset("style styled like compatible type alike".split())
_MONTHS = frozenset("january february march april may june july august september october november december".split())
_AND = frozenset(expanded("(and or|and|or) (under|) (terms of|)"))
_DENIED = frozenset("not never neither cannot nor".split())

# ----- normalised words -----

_TOKEN = re.compile(r"[^\W_]+(?:\.\d+)*(?:\.org\b)?|\+|(?<!\bv)[.!?]+(?=[\"'”’)\]]*(?:\s|$))|\n")
_SAME = {
    "licence": ("license",), "licences": ("licenses",), "noncommercial": ("non", "commercial"), "sharealike": ("share", "alike"),
    "noderivatives": ("no", "derivatives"), "noderivs": ("no", "derivatives"), "derivs": ("derivatives",), "noderivative": ("no", "derivatives"),
    "+": ("or", "later"), **{w: () for w in ("the", "a", "an", "version", "v", "ver")},
}
_JOINED = re.compile(r"(gpl|lgpl|agpl|mpl|apache|bsd|by|sa|nc|nd)?v?(\d+(?:\.\d+)*)")


def _normal(token: str) -> tuple[str, ...]:
    if (same := _SAME.get(token)) is not None:
        return same
    if token[-1].isdigit() and (m := _JOINED.fullmatch(token)):
        number = m[2].removesuffix(".0")
        return (m[1], number) if m[1] else (number,)
    return (token,)


def normalise(sentence: str) -> list[str]:
    """The words of a sentence as the table has them."""
    return [w for m in _TOKEN.findall(sentence.lower()) if m[0] not in ".!?\n" for w in _normal(m)]


# ----- the table of phrases -----


class _Table:
    """Word sequences -> what they stand for; the longest that starts at a place is found by looking up its words."""

    def __init__(self, entries: dict[tuple[str, ...], object]):
        self.entries = entries
        self.lengths: dict[str, list[int]] = {}
        for words in entries:
            self.lengths.setdefault(words[0], []).append(len(words))
        self.lengths = {w: sorted(set(n), reverse=True) for w, n in self.lengths.items()}

    def at(self, words: list[str], i: int) -> tuple[object, int] | None:
        for n in self.lengths.get(words[i], ()) if i < len(words) else ():
            if i + n <= len(words) and (found := self.entries.get(tuple(words[i : i + n]))) is not None:
                return found, i + n
        return None


def _sentence_entries() -> dict[tuple[str, ...], object]:
    """First part of each sentence -> its identifier and the parts that have to follow."""
    out: dict[tuple[str, ...], object] = {}
    for name, template in SENTENCES:
        if name == "copyright":
            continue
        first, *rest = template.split("*")
        for words in expanded(first.replace("www.", "www")):
            out.setdefault(words, []).append((name, [expanded(r)[0] for r in rest]))
    return out


_NAME_TABLE, _LATER_TABLE, _AND_TABLE = _Table(NAMES), _Table(LATER), _Table(dict.fromkeys(_AND, True))
_SENTENCE_TABLE = _Table(_sentence_entries())
_GRANT_TABLE = _Table({w: kind for kind, templates in GRANTS.items() for t in templates for w in expanded(t)})
_ADDRESS_TABLE = _Table({
    ("creativecommons.org", "licenses", *kind.lower().split("-"), version): f"CC-{kind}-{version if '.' in version else version + '.0'}"
    for kind in _CC_KINDS for version in _CC_VERSIONS})
_STARTS = frozenset([*_ADDRESS_TABLE.lengths, *_NAME_TABLE.lengths, *_SENTENCE_TABLE.lengths, *_GRANT_TABLE.lengths, "copyright"])


def _sentence_at(words: list[str], i: int) -> tuple[str, int] | None:
    if words[i] == "copyright":  # a holder's line: a year, or the sign before one
        at = i + 1 + (words[i + 1 : i + 2] == ["c"])
        return ("copyright", at + 1) if at < len(words) and re.fullmatch(r"[12]\d{3}", words[at]) else None
    found = _SENTENCE_TABLE.at(words, i)
    for name, rest in found[0] if found else ():
        at = found[1]
        for part in rest:
            at = next((k + len(part) for k in range(at, min(at + REACH, len(words) - len(part) + 1)) if tuple(words[k : k + len(part)]) == part), None)
            if at is None:
                break
        if at is not None:
            return name, at
    return None


def _name_at(words: list[str], i: int) -> tuple[str, int, bool] | None:
    """The licence named at a place, the end of what belongs to the name, and whether it says "license" or a version."""
    found = _NAME_TABLE.at(words, i)
    if not found:
        return None
    name, at = found
    following = words[at] if at < len(words) else ""
    gnu = name in _GNU
    if gnu and tuple(words[at : at + len(_PUBLISHED)]) == _PUBLISHED:
        at += len(_PUBLISHED)
        at += words[at : at + 1] == ["either"]
        following = words[at] if at < len(words) else ""
        if following in ("2", "3", "2.1"):
            name, at, following = f"{name}-{following if '.' in following else following + '.0'}", at + 1, ""
    if following in _STYLED or following[:1].isdigit() and not any(c.isdigit() for c in name):
        return None
    while at < len(words) and words[at] in _TAIL:
        at += 1
    if at + 1 < len(words) and name.startswith("CC-") and words[at + 1] == "license":
        at += 2  # the country of a ported licence
    plain = "license" in words[i:at] or any(c.isdigit() for c in name)
    if later := _LATER_TABLE.at(words, at):
        name, at = name + "+", later[1]
    elif words[at : at + 1] == ["only"]:
        at += 1
    return name, at, plain


def _names_at(words: list[str], i: int) -> tuple[list[str], int, bool]:
    """The licences of an enumeration that starts at a place."""
    out, end, plain = [], i, False
    while found := _name_at(words, i):
        name, end, says = found
        out.append(name)
        plain = plain or says
        more = _AND_TABLE.at(words, end)
        i = more[1] if more else end
    return list(dict.fromkeys(out)), end, plain


#: How the identifiers of a sentence make grants, in order: openings, and what has to hold for the names after them.
GRANT_RULES = (
    ("grant", lambda plain, opens: True),
    ("label", lambda plain, opens: opens),
    ("uses", lambda plain, opens: plain),
)


def _denied(words: list[str], i: int) -> bool:
    return bool(_DENIED.intersection(words[max(0, i - 3) : i])) or words[max(0, i - 2) : i] == ["no", "longer"]


def _identified(words: list[str], starts: set[int], begins: bool, limit: int) -> tuple[list[str], int]:
    """Identifiers of the phrases that start before ``limit``, and the place after the last; starts: starts of lines."""
    out, i = [], 0
    while i < limit:
        if words[i] not in _STARTS:
            i += 1
            continue
        if found := _sentence_at(words, i):
            out.append(found[0])
            i = found[1]
            continue
        if grant := _GRANT_TABLE.at(words, i):
            kind, at = grant
            names, end, plain = _names_at(words, at)
            if names and any(kind == k and holds(plain, i in starts) for k, holds in GRANT_RULES):
                if not _denied(words, i):
                    out += [f"grant:{n}" for n in names]
                i = end
                continue
        if address := _ADDRESS_TABLE.at(words, i):
            out.append(f"grant:{address[0]}")
            i = address[1]
            continue
        if (named := _name_at(words, i)) and words[named[1] : named[1] + 1] == ["licensed"]:
            if not _denied(words, i):
                out.append(f"grant:{named[0]}")
            i = named[1] + 1
            continue
        if begins and i == 0 and (title := _name_at(words, 0)) and title[2]:
            name, end, _ = title
            if end == len(words) or end in starts or _dated(words, end):
                out.append(f"grant:{name}")
                i = end
                continue
        i += 1
    return out, i


def _dated(words: list[str], i: int) -> bool:
    i += words[i : i + 1] != [] and words[i].isdigit()
    return i + 1 < len(words) and words[i] in _MONTHS and words[i + 1].isdigit()


#: What is part of every known sentence, grant and title; a title without "license" has a version, so a name that takes one.
NEEDED = re.compile(
    "licen|copyright|permission|permitted|redistribut|warrant|domain|spdx|reserved|under|covered|governed|subject|bound|retain|endorse|portions|obtain|"
    r"contributor|gpl|mpl|attribution|creative|cc0|bsd|reproduce|apache|bsl|mozilla|\bcc\b")


def sentences(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """(normalised words, identifiers) of each sentence, a long one in runs."""
    words: list[str] = []
    starts: set[int] = set()
    begins = fresh = True  # at the start of a sentence; no word in this line yet

    def cut(limit: int):
        nonlocal words, starts, begins
        found, end = _identified(words, starts, begins, limit)
        done = words[:end]
        end = max(end, limit)
        words, starts, begins = words[end:], {s - end for s in starts if s >= end}, False
        return done, found

    for m in _TOKEN.finditer(text):
        token = m[0]
        if token == "\n":
            if fresh and words:  # a line without words ends what stands above
                yield cut(len(words))
            begins = begins or fresh and not words
            fresh = True
        elif token[0] in ".!?":
            if words:
                yield cut(len(words))
            begins, fresh = True, False
        else:
            if fresh:
                starts.add(len(words))
                fresh = False
            words += _normal(token)
            if len(words) >= RUN + REACH:
                yield cut(RUN)
    if words:
        yield cut(len(words))


def identifiers(sentence: str) -> list[str]:
    """What is known of a sentence."""
    return [i for _, found in sentences(sentence.lower()) for i in found]


def licences(found: list[str]) -> list[str]:
    """Licences that the ordered rules find in a sequence of identifiers, each once, in order."""
    out: list[str] = []
    seen = [i for i in found if i not in _PASSED_OVER]
    at = 0
    while at < len(seen):
        for name, want in _BY_FIRST.get(seen[at], ()):
            if tuple(seen[at : at + len(want)]) == want:
                out.append(name)
                at += len(want)
                break
        else:
            at += 1
    return list(dict.fromkeys(out))


_SPEAKS = frozenset((("licensed", "under"), ("license", "under")))


def scan(text: str | None) -> tuple[list[str], list[str], int]:
    """(licences, identifiers of known sentences, unknown sentences that speak of a licence)."""
    low = text.lower() if text else ""
    if not NEEDED.search(low):
        return [], [], 0
    known, unknown = [], 0
    for words, found in sentences(low):
        if found:
            known += found
        elif "spdx" in words or not _SPEAKS.isdisjoint(zip(words, words[1:])):
            unknown += 1
    return licences(known), known, unknown


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, licenses, sentence_ids (both lists), n_known, n_unknown."""
    names = T.ArrayType(T.StringType())
    schema = T.StructType([
        T.StructField("id", id_type(docs, id_col)), T.StructField("licenses", names), T.StructField("sentence_ids", names),
        T.StructField("n_known", T.LongType()), T.StructField("n_unknown", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                found = [scan(t) for t in decoded(part.column("text"))]
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.string())),
                    pa.array([len(f[1]) for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                ], names=["id", "licenses", "sentence_ids", "n_known", "n_unknown"])

    return keyed_text(docs, id_col, text_col).mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"), "n_known", "n_unknown")


#: The same for documents whose only licence sentences are these five.
ORACLE = r"""
WITH found AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''),
    'Licensed under the Apache License, Version 2\.0\.|This work is licensed under the GNU General Public License, version 3\.|Licensed under CC BY-NC 4\.0\.|Released under the MIT License\.|All rights reserved\.'),
    lambda s: CASE WHEN contains(s, 'Apache') THEN 'grant:Apache-2.0' WHEN contains(s, 'GNU') THEN 'grant:GPL-3.0' WHEN contains(s, 'CC BY') THEN 'grant:CC-BY-NC-4.0'
                   WHEN contains(s, 'MIT') THEN 'grant:MIT' ELSE 'reserved' END) AS f,
    len(regexp_extract_all(lower(coalesce(text, '')), '\blicen[cs]ed? under\b')) AS n FROM documents),
named AS (SELECT *, list_transform(list_filter(f, lambda x: x <> 'reserved'), lambda x: replace(x, 'grant:', '')) AS g FROM found)
SELECT doc_id, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), ',') AS licenses,
       array_to_string(f, ',') AS sentence_ids, CAST(len(f) AS BIGINT) AS n_known,
       CAST(n - len(list_filter(g, lambda x: x <> 'MIT')) AS BIGINT) AS n_unknown
FROM named
"""
