"""Licence scans by sentence rules.

A text is cut into sentences. Normalised sentences that the table knows become identifiers, and
rules are ordered sequences of identifiers: a rule matches where its sentences follow each other,
with at most some text between two of them. Of matches that share a sentence the longest stays.

Known sentences are whole ones, some with room for a name; grants, recognised by their parts (a verb
and "under", fill words, the name of a licence, more names); and SPDX tags with their expression.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from emberline.llm.common import col, map_batches

#: Characters that may stand between two sentences of a rule.
GAP = 400

# Names under which licences are granted, by SPDX identifier.
NAMES = {
    "0BSD": ("Zero-Clause BSD License", "0BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License", "Apache License v2.0", "Apache-2.0", "Apache 2.0"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD 3-Clause"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0"),
    "EPL-1.0": ("Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "ISC": ("ISC License", "ISC"),
    "MIT": ("MIT License", "MIT", "Expat License"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0", "MPLv2"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "Unlicense": ("Unlicense", "Unlicense License"),
    "Zlib": ("zlib License", "zlib/libpng License"),
}
# The licences of the GNU family, with their versions.
GNU = {
    "GPL": ("General Public License", ("2.0", "3.0")),
    "LGPL": ("Lesser General Public License", ("2.1", "3.0")),
    "AGPL": ("Affero General Public License", ("3.0",)),
}
# SPDX identifiers of further licences that tags may name.
TAGGED = (
    "AFL-3.0", "Apache-1.1", "BSD-3-Clause-Clear", "BSD-4-Clause", "CC-BY-3.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0",
    "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "ECL-2.0", "EUPL-1.1", "EUPL-1.2", "FSFAP", "HPND", "LPPL-1.3c", "MIT-0", "MPL-1.1", "MS-PL", "MS-RL",
    "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OpenSSL", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "UPL-1.0", "Vim", "WTFPL", "X11", "ZPL-2.1",
)
# The parts of a grant.
VERBS = ("licensed", "released", "distributed", "available", "published", "provided", "offered")
FILLERS = ("the", "a", "an", "terms", "of", "conditions", "either", "both", "and", "gnu", "your", "choice")
LATER = ("or later", "or newer", "or any later version", "or at your option any later version", "or any later")

# Sentences of licence texts and headers, by identifier.
SENTENCES = {
    "mit.grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation'
        ' files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,'
        ' modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the'
        " Software is furnished to do so, subject to the following conditions"
    ),
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.warranty": (
        'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the'
        " warranties of merchantability, fitness for a particular purpose and noninfringement"
    ),
    "isc.grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "bsd.grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met"
    ),
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution"
    ),
    "bsd.advert": (
        "All advertising materials mentioning features or use of this software must display the following acknowledgement"
    ),
    "bsd.names": (
        "Neither the name of * nor the names of * may be used to endorse or promote products"
        " derived from this software without specific prior written permission"
    ),
    "bsd.name": (
        "The name of * may not be used to endorse or promote products"
        " derived from this software without specific prior written permission"
    ),
    "asf.grant": (
        'The ASF licenses this file to you under the Apache License, Version 2.0 (the "License")'
    ),
    "apache.title": "Apache License Version 2.0, January 2004",
    "apache.grant": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache.comply": "You may not use this file except in compliance with the License",
    "apache.law": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'
    ),
    "gpl.2.title": "GNU General Public License Version 2, June 1991",
    "gpl.3.title": "GNU General Public License Version 3, 29 June 2007",
    "lgpl.2.1.title": "GNU Lesser General Public License Version 2.1, February 1999",
    "lgpl.3.title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "agpl.3.title": "GNU Affero General Public License Version 3, 19 November 2007",
    "mpl.form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense.free": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
}
#: Headers of the GNU family by the words that vary.
GNU_HEADER = (
    "* is free software you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software"
    " Foundation, {either}version {version} of the License"
)
#: Words that stand for a name in a sentence (``*``), at most.
ROOM = 12
# Licences by the sentences that make them up, in order.
RULES = (
    ("MIT", ("mit.grant", "mit.notice", "mit.warranty")),
    ("ISC", ("isc.grant",)),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.name")),
    ("BSD-4-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advert", "bsd.names")),
    ("BSD-4-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advert", "bsd.name")),
    ("Apache-2.0", ("asf.grant",)),
    ("Apache-2.0", ("apache.title",)),
    ("Apache-2.0", ("apache.grant", "apache.comply")),
    ("Apache-2.0", ("apache.grant", "apache.comply", "apache.law")),
    ("GPL-2.0-only", ("gpl.2.title",)),
    ("GPL-3.0-only", ("gpl.3.title",)),
    ("LGPL-2.1-only", ("lgpl.2.1.title",)),
    ("LGPL-3.0-only", ("lgpl.3.title",)),
    ("AGPL-3.0-only", ("agpl.3.title",)),
    ("MPL-2.0", ("mpl.form",)),
    ("Unlicense", ("unlicense.free",)),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
)
#: Rules that a further item of the same list makes another licence.
CLOSED = ("BSD-2-Clause",)
# Words of which every known sentence has one; a text without any has no match.
ANCHORS = ("licen", "permission", "copyright", "warrant", "redistribut", "reserved", "domain", "mit", "gpl", "cc0", "cc by", "cc-by", "mpl", "under isc", "under the isc", "apache", "spdx", "free software", "bsd", "advertising", "endorse")

_OTHER = re.compile(r"[^a-z0-9+]+")
#: A piece ends at such a mark before white space, or with its line. A sentence is a run of pieces.
_END = re.compile(r"[.!?;](?=\s)")
#: White space and comment marks in front of a piece.
_LEADER = re.compile(r"(?:\s|//+|/\*+|\*+/?|#+|--+|;+|%+|<!--|(?i:rem|dnl)\b)*")
_LINE = re.compile("\n")
_MARKS = ("rem", "dnl")
#: Lists by letters and the letter o as a bullet.
_ITEM = re.compile(r"[^a-z0-9+]*(?:(?:rem|dnl)\b[^a-z0-9+]*)?(?:[a-z]\)|o)\s", re.IGNORECASE)


def _words(line: str) -> list[str]:
    """Words of a line or a piece of one: lower case, one spelling of licence, no comment mark in front."""
    words = _OTHER.sub(" ", _ITEM.sub("", line.lower(), 1) if _ITEM.match(line) else line.lower()).replace("licence", "license").split()
    while words and words[0] in _MARKS:
        words.pop(0)
    return words


def _unnumbered(words: list[str]) -> list[str]:
    first = next((i for i, w in enumerate(words) if not w.isdigit() and w not in _MARKS), len(words))
    return words[first:]


def normalise(sentence: str) -> str:
    """Lower case, words only, one spelling of licence, no numbering in front and no comment marks."""
    return " ".join(_unnumbered([w for line in sentence.split("\n") for w in _words(line)]))


def _gnu_names() -> dict[str, list[str]]:
    found = {}
    for short, (long, versions) in GNU.items():
        for version in versions:
            for v in {version, version.removesuffix(".0")}:
                forms = [f"{n} {x}{v}" for n in (long, short) for x in ("", "v", "v ", "version ")] + [f"{short}v{v}"]
                found.setdefault(f"{short}-{version}", []).extend(forms)
    return found


def spdx_licenses(expression: str) -> list[str] | None:
    """The licences of an SPDX expression, in order; none if it is not one.

    An expression is an identifier with an optional ``+`` or ``WITH`` an exception, or expressions in parentheses or
    joined by ``AND`` and ``OR``.
    """
    tokens = re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*", expression)
    if "".join(tokens) != re.sub(r"\s+", "", expression):
        return None
    found, at = [], 0

    def one() -> bool:
        nonlocal at
        if at < len(tokens) and tokens[at] == "(":
            at += 1
            if not every() or at == len(tokens) or tokens[at] != ")":
                return False
            at += 1
            return True
        if at == len(tokens) or (name := _identifier(tokens[at])) is None:
            return False
        found.append(name)
        at += 1
        if at + 1 < len(tokens) and tokens[at].upper() == "WITH":
            at += 2
        return True

    def every() -> bool:
        nonlocal at
        if not one():
            return False
        while at < len(tokens) and tokens[at].upper() in ("AND", "OR"):
            at += 1
            if not one():
                return False
        return True

    return found if every() and at == len(tokens) else None


def _identifier(token: str) -> str | None:
    """The SPDX identifier of a token in present spelling; names of one's own stay as they are."""
    if token.startswith("LicenseRef-"):
        return token
    plain = token.removesuffix("+")
    for family, (_, versions) in GNU.items():
        for version in {*versions, "2.0", "1.0"}:
            for end, kind in (("", "or-later" if plain != token else "only"), ("-only", "only"), ("-or-later", "or-later")):
                if plain.lower() == f"{family}-{version}{end}".lower():
                    return f"{family}-{version}-{kind}"
    return _SPDX.get(plain.lower())


_SPDX = {x.lower(): x for x in (*NAMES, *TAGGED)}


@dataclass(frozen=True)
class Rule:
    license: str
    sentences: tuple[str, ...]


class Scanner:
    """Known sentences by their normal form, and rules by their first sentence."""

    def __init__(self):
        self.known, self.roomy = {}, {}
        whole = dict(SENTENCES)
        rules = [Rule(*r) for r in RULES]
        for short, (long, versions) in GNU.items():
            for version in versions:
                for either in ("either ", ""):
                    v = version.removesuffix(".0")
                    for given in {v, version}:
                        whole[f"gnu.{short}.{version}.{either}{given}"] = GNU_HEADER.format(name=long, either=either, version=given)
                        rules.append(Rule(f"{short}-{version}-only", (f"gnu.{short}.{version}.{either}{given}",)))
                        later = f"{whole[f'gnu.{short}.{version}.{either}{given}']}, or (at your option) any later version"
                        whole[f"gnu.{short}.{version}.{either}{given}+"] = later
                        rules.append(Rule(f"{short}-{version}-or-later", (f"gnu.{short}.{version}.{either}{given}+",)))
        for name, text in whole.items():
            parts = [normalise(x) for x in text.split("*")]
            if len(parts) == 1:
                self.known[parts[0]] = name
            else:
                room = rf"(?:[^ ]+ ){{1,{ROOM}}}"
                self.roomy[name] = re.compile(room.join((f"{x} " if x else "") for x in parts).strip())
        self.names: dict[tuple[str, ...], str] = {}
        for spdx, names in NAMES.items():
            for name in names:
                self.names[tuple(normalise(name).split())] = spdx
        for spdx, names in _gnu_names().items():
            for name in names:
                words = tuple(normalise(name).split())
                self.names[words] = f"{spdx}-only"
                self.names[(*words[:-1], words[-1] + "+")] = f"{spdx}-or-later"
                for later in LATER:
                    self.names[(*words, *later.split())] = f"{spdx}-or-later"
        # a licence's name may be followed by the word
        self.names |= {(*words, "license"): spdx for words, spdx in self.names.items() if words[-1] != "license" and len(words) > 1}
        assert all(any(a.replace("-", " ") in k for a in ANCHORS) for k in self.known)
        self.longest = max([len(k.split()) for k in self.known] + [len(whole[n].split()) + 2 * ROOM for n in self.roomy])
        self.first = {k.split()[0] for k in self.known}
        self.longest_name = max(map(len, self.names))
        self.rules: dict[str, list[Rule]] = {}
        granted = {f"grant.{x}" for x in (*self.names.values(), *NAMES, *TAGGED)}
        for rule in sorted([*rules, *[Rule(g.removeprefix("grant."), (g,)) for g in sorted(granted)]], key=lambda r: -len(r.sentences)):
            self.rules.setdefault(rule.sentences[0], []).append(rule)

    def granted(self, words: list[str]) -> list[tuple[int, int, str]]:
        """The licences that a sentence of ``words`` grants: the verb's place, the end of the name, and the licence."""
        found = []
        for i, word in enumerate(words):
            terms = word == "under" and words[i + 1 : i + 4] == ["the", "terms", "of"]
            if word in VERBS or word == "subject" or terms:
                at = i + 1
                while at < min(i + 4, len(words)) and words[at] in ("to", "you", "for", "use", "only"):
                    at += 1
                if at < len(words) and (words[at] == "under" or word == "subject" or terms):
                    at += words[at] == "under"
                    while found_here := self._name(words, at):
                        found.append((i, *found_here))
                        at = found_here[0]
                        if at >= len(words) or words[at] not in ("or", "and"):
                            break
                        at += 1
        return found

    def _name(self, words: list[str], at: int) -> tuple[int, str] | None:
        """The end and licence of the longest name after fill words from ``at``."""
        stop = min(len(words), at + 8)
        while at < stop:
            for n in range(min(self.longest_name, len(words) - at), 0, -1):
                spdx = self.names.get(tuple(words[at : at + n]))
                # a name of one word stands at the end or before such words
                if spdx and (n > 1 or at + 1 == len(words) or words[at + 1] in ("or", "and", "see", "as", "which", "license", "for")):
                    return at + n, spdx
            if words[at] not in FILLERS:
                return None
            at += 1
        return None

    def sentences(self, text: str) -> list[tuple[int, int, str]]:
        """Begin, end and identifier of the known sentences, in order; from each place the longest, none inside another.

        A sentence may begin and end at any line or stop, so comment marks, headings above and lists below do no harm.
        """
        low = text.lower()
        if not any(a in low for a in ANCHORS):
            return []
        found, pieces = [], _pieces(text)
        at = 0
        while at < len(pieces):
            end, here = self._tag(text, pieces, at) or self._whole(pieces, at) or self._grants(text, pieces, at) or (at, [])
            found += here
            at = end + 1
        return found

    def _tag(self, text: str, pieces: list, at: int):
        begin, end, words = pieces[at]
        if words[:3] != ["spdx", "license", "identifier"]:
            return None
        while at + 1 < len(pieces) and "\n" not in text[end : pieces[at + 1][0]]:  # the tag takes its whole line
            at, end = at + 1, pieces[at + 1][1]
        expression = re.sub(r"\s*(?:\*+/|-->|#+\}|\.)?\s*$", "", text[begin:end].partition(":")[2]).strip()
        return at, [(begin, end, f"grant.{x}") for x in dict.fromkeys(spdx_licenses(expression) or ())]

    def _whole(self, pieces: list, at: int):
        begin, words, best = pieces[at][0], _unnumbered(pieces[at][2]), None
        if not words:
            return None
        plain = words[0] in self.first
        near = [*words, *(pieces[at + 1][2] if at + 1 < len(pieces) else [])]
        roomy = words[:3] == ["neither", "the", "name"] or words[:3] == ["the", "name", "of"] or " is free software " in f" {' '.join(near)} "
        if not (plain or roomy):
            return None
        for nth in range(at, len(pieces)):
            if nth > at:
                words = words + pieces[nth][2]
            # a line without words ends a paragraph
            if not pieces[nth][2] or len(words) > self.longest:
                break
            joined = " ".join(words)
            name = self.known.get(joined) if plain else None
            if name is None and roomy:
                name = next((n for n, form in self.roomy.items() if form.fullmatch(joined)), None)
            if name:
                best = nth, [(begin, pieces[nth][1], name)]
        return best

    def _grants(self, text: str, pieces: list, at: int):
        """Grants in the sentence that begins here: it ends at a stop, at a line without words, or after as many words as a known one has."""
        words, ends = [], []
        for nth in range(at, len(pieces)):
            if not pieces[nth][2] or len(words) > self.longest:
                break
            words += pieces[nth][2]
            ends.append(len(words))
            if text[pieces[nth][1] : pieces[nth][1] + 1] in tuple(".!?"):
                break
        if "under" not in words and "subject" not in words:
            return None
        granted = self.granted(words)
        if not granted:
            return None
        # the grant goes from the line of its verb to that of its last name
        first = next(i for i, n in enumerate(ends) if n > granted[0][0])
        last = next(i for i, n in enumerate(ends) if n >= max(end for _, end, _ in granted))
        span = pieces[at + first][0], pieces[at + last][1]
        return at + last, [(*span, f"grant.{x}") for x in dict.fromkeys(x for *_, x in granted)]

    def matches(self, text: str) -> list[tuple[int, int, Rule]]:
        """Begin, end and rule of each match; of those that share a sentence the longest, then the first."""
        known = self.sentences(text)
        places: dict[str, list[int]] = {}
        for i, (_, _, name) in enumerate(known):
            places.setdefault(name, []).append(i)
        taken, out = set(), []
        candidates = [(rule, i) for i, (_, _, name) in enumerate(known) for rule in self.rules.get(name, ())]
        for rule, i in sorted(candidates, key=lambda c: (-len(c[0].sentences), c[1])):
            steps = [i]
            for name in rule.sentences[1:]:
                later = places.get(name, [])
                nth = bisect_right(later, steps[-1])
                if nth == len(later) or known[later[nth]][0] - known[steps[-1]][1] > GAP:
                    break
                steps.append(later[nth])
            else:
                if not taken & set(steps) and not (rule.license in CLOSED and _goes_on(text, known[steps[-1]])):
                    taken.update(steps)
                    out.append((known[i][0], known[steps[-1]][1], rule))
        return sorted(out, key=lambda m: (m[0], m[1], m[2].license))


def _goes_on(text: str, sentence: tuple[int, int, str]) -> bool:
    """Does another numbered or marked item of a list follow the sentence?"""
    begin, end, _ = sentence
    line = text.rfind("\n", 0, begin) + 1
    marked = re.search(r"(\(?(?:\d+|[a-z])[.)]|[*o-])\s+$", text[line:begin], re.IGNORECASE)
    if not marked:
        return False
    rest = text[end : end + GAP].lstrip(".;")
    following = re.match(r"\s*?\n(?:[^\S\n]*\n)*([^\n]*)", rest)
    if not following:
        return False
    leader = text[line : begin - len(marked[0])] if marked else ""
    item = following[1].removeprefix(leader.rstrip()).strip() if leader.strip() else following[1].strip()
    if marked[1].strip("()").rstrip(".").isalnum() and marked[1] != "o":
        return re.match(r"\(?(?:\d+|[a-z])[.)]\s+\S", item, re.IGNORECASE) is not None
    return re.match(re.escape(marked[1]) + r"\s+\S", item) is not None


def _spans(text: str, mark: re.Pattern) -> Iterator[tuple[int, int]]:
    at = 0
    for m in mark.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _pieces(text: str) -> list[tuple[int, int, list[str]]]:
    """Begin, end and words of the pieces of each line; a line without words is one piece."""
    out = []
    for a, b in _spans(text, _LINE):
        line = [(a + x, a + y, _words(text[a + x : a + y])) for x, y in _spans(text[a:b], _END)]
        worded = [(_LEADER.match(text, x, y).end(), y, words) for x, y, words in line if words]
        out += worded or [(a, b, [])]
    return out


MATCH = T.StructType(
    [
        T.StructField("license", T.StringType()),
        T.StructField("sentences", T.ArrayType(T.StringType())),
        T.StructField("begin", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)


def _scan(id: str) -> Callable:
    def each(batches):
        scanner = Scanner()
        match = pa.struct([("license", pa.string()), ("sentences", pa.list_(pa.string())), ("begin", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = [scanner.matches(t or "") for t in batch.column(1).to_pylist()]
            lists = [[{"license": r.license, "sentences": list(r.sentences), "begin": a, "end": b} for a, b, r in m] for m in found]
            names = [sorted({r.license for _, _, r in m}) for m in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(lists, pa.list_(match))], names=[id, "licenses", "matches"]
            )

    return each


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, licenses (different SPDX identifiers, sorted), matches (in order).

    ``begin`` and ``end`` count characters of the text. A null or empty text has no match. Repeated rows
    are scanned alike. Other columns, whatever their names, are not read. Empty in, empty out.
    """
    narrow = docs.select(col(id), col(text))
    out = [narrow.schema[0], T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(MATCH))]
    return map_batches(narrow, _scan(id), T.StructType(out))
