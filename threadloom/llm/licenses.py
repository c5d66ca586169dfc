"""License scans by sentence rules.

Text is cut into pieces (at line ends and after ``.``, ``;``, ``:``, ``!`` or ``?``
before white space; a dot inside a version number or between "v" and a number does not
cut), each normalised to lower-case words of letters, digits and dots. A sentence is one
piece, or several that only single line ends part: the longest run of pieces that the
catalogue knows becomes its sentence id, so titles and notices are found on lines of
their own and wrapped sentences across lines. Other pieces of a paragraph up to the next
cut inside it are one unknown sentence, a gap; pieces without a word are none. A ``*`` in
a catalogue sentence is a slot for one to ``SLOT`` words, such as a holder's name, whose
dots do not end the sentence. A piece that is not known from its beginning is tried again from
each of the ``OPENINGS`` inside it, so grants are found in texts without line ends;
sentences with an opening of ``ENDLESS`` may also end before their piece does. "Licence" is
read as "license". A reserved right is a licence only beside a copyright notice.

Ordered rules are matched against the id sequence: a rule is a list of ids in order, with
at most ``gap`` unknown sentences between two of them, of which a share of at least
``least`` must be there (all, for rules by hand). At each position the rule with the
largest share wins, then the longest, then the first; a matched stretch is used up.
``catalogue_of`` makes sentences and rules of whole licence texts, which are a parameter
and not kept here. A rule that ``YIELDS`` stands for a notice that other licences also
begin with: its match is dropped if another rule's begins within so many sentences.

Returned per document: licenses (distinct names in order of appearance, joined by
commas), n_matches, and matches as ``name:first sentence:last sentence``.

Edge cases: null or empty text has no sentences; marks before a line's words (comment
signs) are passed over; repeated rows repeat; null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .worker import map_arrow

_FSF = "you can redistribute it and or modify it under the terms of the {} as published by the free software foundation"
_FREE = "either version {} of the license or at your option any later version"
_AS_IS = "and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
_COPYLEFT = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}
#: Sentences of public licence texts and notices, by id.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-title": ("mit license", "the mit license", "the mit license mit", "released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "mit license http www opensource org licenses mit license.php"),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-keep": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    "as-is": (
        "the software is provided as is without warranty of any kind express or implied",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
        f"this software is provided by * as is {_AS_IS}",
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "isc-title": ("isc license", "the isc license", "licensed under the isc license"),
    "0bsd-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "apache-title": ("apache license version 2.0 january 2004", "apache license version 2.0 january 2004 http www apache org licenses", "apache license version 2.0 january 2004 https www apache org licenses"),
    "apache-notice": ("licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "released under the apache license version 2.0"),
    "apache-may-not": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2.0", "you may obtain a copy of the license at https www apache org licenses license 2.0"),
    "gpl3-notice": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"),
    "gpl2-notice": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"),
    "free": tuple(f"this {what} is free software" for what in ("program", "library", "file", "software")),
    **{f"{k}-free": tuple(f"this {what} is free software " + _FSF.format(name) for what in ("program", "library", "file", "software")) for k, name in _COPYLEFT.items()},
    **{f"{k}{v}-terms": (_FSF.format(name) + " " + _FREE.format(v),) for k, name in _COPYLEFT.items() for v in ("2", "2.1", "3")},
    **{f"{k}-terms": (_FSF.format(name),) for k, name in _COPYLEFT.items()},
    **{f"{v}-or-later": (_FREE.format(v),) for v in ("2", "2.1", "3")},
    "gpl3-title": ("gnu general public license version 3 29 june 2007",),
    "gpl2-title": ("gnu general public license version 2 june 1991",),
    "lgpl3-title": ("gnu lesser general public license version 3 29 june 2007",),
    "lgpl2.1-title": ("gnu lesser general public license version 2.1 february 1999",),
    "lgpl2-title": ("gnu library general public license version 2 june 1991",),
    "agpl3-title": ("gnu affero general public license version 3 19 november 2007",),
    "bsd-redistribute": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1"),
    "bsd-no-endorse": (
        f"neither the name of * nor the names of * contributors {_ENDORSE}", f"neither the name of * nor the names of * {_ENDORSE}", f"the name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
        f"the names of * {_ENDORSE}",
    ),
    "bsd-title": ("released under the bsd license", "licensed under the bsd license", "bsd license"),
    "mpl2-title": ("mozilla public license version 2.0",),
    "mpl1.1-title": ("mozilla public license version 1.1",),
    "mpl2-notice": ("this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0"),
    "epl2-title": ("eclipse public license v 2.0", "licensed under the eclipse public license version 2.0"),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "boost-title": ("boost software license version 1.0 august 17th 2003", "distributed under the boost software license version 1.0"),
    "psf-title": ("python software foundation license version 2",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "artistic-title": ("the artistic license",),
    "gfdl-title": ("gnu free documentation license version 1.2 november 2002", "gnu free documentation license version 1.3 3 november 2008"),
    "cc-by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "creative commons attribution 4.0 international"),
    "cc-by-sa": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "creative commons attribution sharealike 4.0 international"),
    "cc-by-nc": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "creative commons attribution noncommercial 4.0 international"),
    "cc0": ("to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "licensed under cc0 1.0", "cc0 1.0 universal"),
    "proprietary": ("copyright * all rights reserved", "all rights reserved copyright *", "proprietary and confidential"),
    **{f"{k}{v}-only": tuple(x + _FSF.format(f"{name} version {v}") for x in ("", *(f"this {what} is free software " for what in ("program", "library", "file", "software")))) for k, name in _COPYLEFT.items() for v in ("2", "2.1", "3")},
    **{f"{v}-exactly": (f"version {v} of the license", f"version {v}") for v in ("2", "2.1", "3")},
}
#: Fixed values: (name, sentence ids in order, unknown sentences allowed between two).
RULES: tuple[tuple, ...] = (
    ("MIT", ("mit-title", "mit-grant", "mit-keep", "as-is"), 4),
    ("MIT", ("mit-grant", "mit-keep", "as-is"), 4),
    ("MIT", ("mit-grant", "mit-keep"), 4),
    ("MIT", ("mit-title",), 0),
    ("ISC", ("isc-title", "isc-grant"), 4),
    ("ISC", ("isc-grant",), 0),
    ("ISC", ("isc-title",), 0),
    ("0BSD", ("0bsd-grant",), 0),
    ("Apache-2.0", ("apache-notice", "apache-may-not", "apache-copy"), 3),
    ("Apache-2.0", ("apache-notice",), 0),
    ("Apache-2.0", ("apache-title",), 0),
    *(
        (f"{k.upper()}-{v if '.' in v else v + '.0'}", ids, 3)
        for k in _COPYLEFT
        for v in ("3", "2.1", "2")
        for ids in ((f"{k}{v}-only",), ("free", f"{k}{v}-only"), (f"{k}-terms", f"{v}-exactly"), (f"{k}-free", f"{v}-exactly"), ("free", f"{k}{v}-terms"), ("free", f"{k}-terms", f"{v}-or-later"), (f"{k}-free", f"{v}-or-later"), (f"{k}{v}-terms",), (f"{k}-terms", f"{v}-or-later"))
    ),
    *((f"{k.upper()}-{v if '.' in v else v + '.0'}", (f"{k}{v}-title",), 0) for k, v in (("gpl", "3"), ("gpl", "2"), ("lgpl", "3"), ("lgpl", "2.1"), ("lgpl", "2"), ("agpl", "3"))),
    ("GPL-3.0", ("gpl3-notice",), 0),
    ("GPL-2.0", ("gpl2-notice",), 0),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-no-endorse", "as-is"), 8),
    ("BSD-2-Clause", ("bsd-redistribute", "as-is"), 8),
    ("BSD", ("bsd-title",), 0),
    ("MPL-2.0", ("mpl2-notice",), 0),
    ("MPL-2.0", ("mpl2-title",), 0),
    ("MPL-1.1", ("mpl1.1-title",), 0),
    ("EPL-2.0", ("epl2-title",), 0),
    ("Zlib", ("zlib-grant",), 0),
    ("BSL-1.0", ("boost-title",), 0),
    ("PSF-2.0", ("psf-title",), 0),
    ("Unlicense", ("unlicense",), 0),
    ("Artistic", ("artistic-title",), 0),
    ("GFDL", ("gfdl-title",), 0),
    ("CC-BY-4.0", ("cc-by",), 0),
    ("CC-BY-SA-4.0", ("cc-by-sa",), 0),
    ("CC-BY-NC-4.0", ("cc-by-nc",), 0),
    ("CC0-1.0", ("cc0",), 0),
    ("Proprietary", ("proprietary",), 0),
)
#: How notices call licences, by name; a name's own words (``MIT``, ``GPL 2.0 only``) come besides.
CALLED: dict[str, tuple[str, ...]] = {
    "MIT": ("mit license", "mit expat license", "expat license"),
    "ISC": ("isc license",),
    "0BSD": ("zero clause bsd license",),
    "Apache-2.0": ("apache license version 2.0", "apache license version 2", "apache license 2.0", "apache license v2.0", "apache 2.0 license", "apache software license 2.0", "apache 2", "asl 2.0"),
    **{
        f"{k.upper()}-{v if '.' in v else v + '.0'}": tuple(
            x for short in dict.fromkeys((v, v if "." in v else v + ".0"))
            for x in (f"{name} version {short}", f"{name} v{short}", f"{name} v {short}", f"{name} {short}", f"gnu {k} version {short}", f"gnu {k} v{short}", f"{k} version {short}", f"{k}v{short}", f"{k} v{short}", f"{k} {short}")
        )
        for k, name in _COPYLEFT.items() for v in ("2", "2.1", "3")
    },
    "BSD-3-Clause": ("3 clause bsd license", "bsd 3 clause license", "new bsd license", "modified bsd license"),
    "BSD-2-Clause": ("2 clause bsd license", "bsd 2 clause license", "simplified bsd license"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license v2.0", "mozilla public license v 2.0", "mozilla public license 2.0"),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license v2.0", "eclipse public license v 2.0", "eclipse public license 2.0"),
    "Zlib": ("zlib license",),
    "BSL-1.0": ("boost software license version 1.0", "boost software license 1.0"),
    "Unlicense": ("unlicense license",),
    "UPL-1.0": ("universal permissive license", "universal permissive license upl", "universal permissive license upl version 1.0", "universal permissive license v 1.0", "universal permissive license version 1.0"),
    **{f"EUPL-{v}": (f"european union public license version {v}", f"european union public license v {v}", f"european union public license v{v}", f"european union public license {v}", f"eupl v{v}", f"eupl v {v}", f"eupl version {v}") for v in ("1.1", "1.2")},
    "CC0-1.0": ("cc0 1.0 universal", "creative commons zero v1.0 universal", "creative commons cc0 1.0"),
    **{
        f"CC-{kind.upper()}-{v}": tuple(f"creative commons {words} {v}{end}" for end in ("", " license", " international", " international license", " unported", " unported license"))
        for kind, words in (
            ("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nd", "attribution noderivatives"), ("by-nc", "attribution noncommercial"),
            ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives"),
        )
        for v in ("2.0", "2.5", "3.0", "4.0")
    },
}
#: What notices begin with. The first are notices before any name, the others before a licence's words only.
NOTICES = ("licensed under", "released under", "distributed under", "available under", "published under", "spdx license identifier")
TAGS = ("license", "project license")
#: Beginnings of sentences that are looked for inside a piece, and those whose sentences may end inside one.
OPENINGS = (*NOTICES, "permission is hereby granted", "permission to use copy", "redistribution and use in", "the above copyright notice and", "the software is provided", "this software is provided", "this program is free", "this library is free", "this source code form is", "neither the name of", "copyright")
ENDLESS = (*NOTICES, *TAGS)


def notices() -> tuple[dict[str, tuple[str, ...]], tuple[tuple, ...]]:
    """(sentences, rules) of notices that name a licence, by ``CALLED``."""
    sentences, rules, taken = {}, [], {x for texts in SENTENCES.values() for x in texts}
    for name, called in CALLED.items():
        own = name.lower().replace("-", " ")
        names = dict.fromkeys([own, *(f"{own} {x}" for x in ("only", "or later", "license") if not own.startswith("cc")), *called])
        texts = [f"{begin} {article}{x}" for x in names for begin in NOTICES for article in ("", "the ", "a ", "the terms of the ")] + [f"{tag} {x}" for x in names for tag in TAGS]
        sentences[f"notice-{name}"] = tuple(x for x in texts if x not in taken)
        rules.append((name, (f"notice-{name}",), 0))
    return sentences, tuple(rules)


#: Sentences after a match of this name within which another licence's match replaces it.
YIELDS = {"Proprietary": 8}
SLOT = 12
_CUT = re.compile(r"((?<=[.;:!?])(?<!\b[vV]\.)(?<!(?i:dentifier:))(?<!(?i:icen[sc]e:))\s+|(?<=\b[vV]\.)\s+(?![\W_]*\d)|\n+)")
_ENDS = re.compile(r"[.;:!?]\Z")
_NUMBER = re.compile(r"[\W_]*\d")
_VERSION = re.compile(r"\b[vV]\.\Z")
_WORD = re.compile(r"[^\W_]+(?:\.(?=\d)[^\W_]+)*")
SCHEMA = "doc_id bigint, licenses string, n_matches bigint, matches string"


#: Names of one plain word: a notice goes on after them only past a mark.
BARE = {"mit", "isc", "zlib", "unlicense", "0bsd"}
_MARK = re.compile(r"\s*[^\w\s]")
_SPELLED = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense"}


def normalise(sentence: str) -> str:
    """Lower-case words joined by single spaces, in one spelling; dots stay only inside versions."""
    return " ".join(_SPELLED.get(w, w) for w in _WORD.findall(sentence.lower()))


def _phrases(openings: tuple[str, ...]) -> str:
    """A pattern of any of some beginnings, whatever marks are between their words, in both spellings."""
    return "|".join(r"[\W_]+".join(map(re.escape, x.split())).replace("license", "licen[sc]e") for x in sorted(openings, key=len, reverse=True))


_OPENING = re.compile(rf"(?<![^\W_])(?:{_phrases(OPENINGS)})(?![^\W_])", re.IGNORECASE)
_ENDLESS = re.compile(rf"[\W_]*(?:{_phrases(ENDLESS)})(?![^\W_])", re.IGNORECASE)


def _soft(parts: list[str], k: int) -> bool:
    """Whether only a single line end parts piece ``k`` from the next one."""
    if k + 1 >= len(parts) or parts[k + 1] != "\n":
        return False
    return not _ENDS.search(parts[k]) or bool(_VERSION.search(parts[k])) and bool(_NUMBER.match("".join(parts[k + 2 : k + 5])))


def _next(parts: list[str], k: int) -> int:
    """The piece that goes on after a single line end, past marks that begin its line, or -1."""
    if not _soft(parts, k):
        return -1
    k += 2
    while not _WORD.search(parts[k]):
        if k + 1 >= len(parts) or "\n" in parts[k + 1]:
            return -1
        k += 2
    return k


def _over(parts: list[str], k: int) -> int:
    """The piece after any cut inside a paragraph, past marks that begin its line, or -1."""
    while k + 1 < len(parts) and "\n\n" not in parts[k + 1].replace("\r", ""):
        k += 2
        if _WORD.search(parts[k]):
            return k
    return -1


def sentences_of(text: str) -> list[str]:
    """The normalised sentences of a whole text, in order."""
    parts, out, k = _CUT.split(text), [], 0
    while k < len(parts):
        if not _WORD.search(parts[k]):
            k += 2
            continue
        words = [normalise(parts[k])]
        while (more := _next(parts, k)) >= 0:
            k = more
            words.append(normalise(parts[k]))
        out.append(" ".join(words))
        k += 2
    return out


def catalogue_of(texts: dict[str, str], least: float = 0.8, gap: int = 6, words: int = 4) -> tuple[dict[str, tuple[str, ...]], tuple[tuple, ...]]:
    """(sentences, rules) of whole licence texts by name, to go with or instead of ``SENTENCES`` and ``RULES``.

    Every sentence of at least ``words`` words gets an id, the same in all texts that
    hold it; a text's rule is all its ids in order, of which a share of ``least`` has to be there.
    """
    ids: dict[str, str] = {}
    rules = []
    for name, text in texts.items():
        own = [x for x in sentences_of(text) if x.count(" ") >= words - 1]
        rules.append((name, tuple(ids.setdefault(x, f"text-{len(ids)}") for x in own), gap, least))
    return {i: (x,) for x, i in ids.items()}, tuple(rules)


class Catalogue:
    """Sentence ids by words, as a trie with slots, and rules by the ids that can begin them."""

    def __init__(self, sentences=SENTENCES, rules=RULES):
        if sentences is SENTENCES and rules is RULES:
            more = notices()
            sentences, rules = SENTENCES | more[0], (*RULES, *more[1])
        self.trie: dict = {}
        for name, texts in sentences.items():
            for text in texts:
                node = self.trie
                for n, fixed in enumerate(text.split("*")):
                    for word in (*(["*"] if n else []), *normalise(fixed).split()):
                        node = node.setdefault(word, {})
                node[""] = name
        self.rules: dict[str, list[tuple[str, tuple[str, ...], int, float]]] = {}
        for rule in rules:
            name, wanted, gap, least = (*rule, 1.0)[:4]
            missing = len(wanted) - -(-len(wanted) * least // 1)
            for first in dict.fromkeys(wanted[: int(missing) + 1]):
                self.rules.setdefault(first, []).append((name, wanted, gap, least))
        if "*" in self.trie:
            raise ValueError("a sentence begins with a slot")
        starts = "|".join(sorted(map(re.escape, self.trie), key=len, reverse=True)).replace("license", "licen[sc]e")
        self._start = re.compile(rf"[\W_]*(?:{starts})(?![^\W_])", re.IGNORECASE)

    def _known(self, parts: list[str], k: int, begin: int = 0) -> tuple[int, str | None]:
        """(last piece, id) of the longest known sentence that begins at character ``begin`` of piece ``k``."""
        states, best = [(self.trie, 0)], (k, None)  # (node, words that its slot may still take)
        endless = _ENDLESS.match(parts[k], begin) is not None
        while True:
            for m in _WORD.finditer(parts[k], begin):
                word, now = m[0].lower(), []
                word = _SPELLED.get(word, word)
                for node, left in states:
                    if (nxt := node.get(word)) is not None:
                        now.append((nxt, 0))
                    if (slot := node.get("*")) is not None:
                        now.append((slot, SLOT))
                    if left > 1:
                        now.append((node, left - 1))
                if not now:
                    return best
                states = now
                if endless and (word not in BARE or _MARK.match(parts[k], m.end())):
                    best = next(((k, node[""]) for node, _ in states if "" in node), best)
            best = next(((k, node[""]) for node, _ in states if "" in node), best)
            at, k, begin = k, _next(parts, k), 0
            if k < 0:
                states, k = [s for s in states if s[1]], _over(parts, at)
                if k < 0 or not states:
                    return best

    def _inside(self, parts: list[str], k: int) -> tuple[int, str | None]:
        """``_known`` from the first opening inside piece ``k`` that is known."""
        for m in _OPENING.finditer(parts[k]):
            last, name = self._known(parts, k, m.start())
            if name:
                return last, name
        return k, None

    def sentence_ids(self, text: str) -> list[tuple[int, str]]:
        """(sentence number, id) of the known sentences in order."""
        found, number, k, inside = [], -1, 0, False
        parts, openings = _CUT.split(text), _OPENING.search(text) is not None
        while k < len(parts):
            if not _WORD.search(parts[k]):
                inside = inside and k + 1 < len(parts) and "\n" not in parts[k + 1]
                k += 2
                continue
            last, name = self._known(parts, k) if self._start.match(parts[k]) else (k, None)
            if name is None and openings:
                last, name = self._inside(parts, k)
                number += name is not None and not inside  # what stands before it
            number += name is not None or not inside
            if name:
                found.append((number, name))
            inside = name is None and _soft(parts, k)
            k = last + 2
        return found

    @staticmethod
    def _fit(ids: list[tuple[int, str]], k: int, wanted: tuple[str, ...], gap: int, least: float) -> tuple[float, int] | None:
        """(share, last position) of a rule from position ``k`` on, or None."""
        most = int(len(wanted) - len(wanted) * least + 1e-9)  # ids that may be missing
        at, spot, hits = k, wanted.index(ids[k][1]), 1
        missing = spot
        if missing > most:
            return None
        for nxt in range(k + 1, len(ids)):
            if spot + 1 == len(wanted) or ids[nxt][0] - ids[at][0] > gap + 1:
                break
            ahead = wanted[spot + 1 : spot + 2 + most - missing]
            if ids[nxt][1] in ahead:
                skipped = ahead.index(ids[nxt][1])
                at, spot, hits, missing = nxt, spot + 1 + skipped, hits + 1, missing + skipped
        return (hits / len(wanted), at) if hits >= len(wanted) - most else None

    def match(self, ids: list[tuple[int, str]]) -> list[tuple[str, int, int]]:
        """(license, first sentence, last sentence) of the rules that fire."""
        out, k = [], 0
        while k < len(ids):
            fits = [(f[0], len(wanted), -n, name, f[1]) for n, (name, wanted, gap, least) in enumerate(self.rules.get(ids[k][1], ())) if (f := self._fit(ids, k, wanted, gap, least))]
            if fits:
                *_, name, at = max(fits)
                out.append((name, ids[k][0], ids[at][0]))
                k = at
            k += 1
        kept = []
        for n, (name, first, last) in enumerate(out):
            replaced = name in YIELDS and n + 1 < len(out) and out[n + 1][0] != name and out[n + 1][1] - last <= YIELDS[name]
            if not replaced:
                kept.append((name, first, last))
        return kept


def scan_licenses(docs: DataFrame, sentences=SENTENCES, rules=RULES) -> DataFrame:
    """One row per document: doc_id, licenses, n_matches, matches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalogue = Catalogue(sentences, rules)
        for batch in batches:
            names, counts, spans = [], [], []
            for text in batch.column(1):
                hits = catalogue.match(catalogue.sentence_ids(text.as_py() or ""))
                names.append(",".join(dict.fromkeys(h[0] for h in hits)))
                counts.append(len(hits))
                spans.append(",".join(f"{n}:{a}:{b}" for n, a, b in hits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())], names=["doc_id", "licenses", "n_matches", "matches"])

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
