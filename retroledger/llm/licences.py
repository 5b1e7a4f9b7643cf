"""License scans by ordered signature rules, in DataFrame functions only.

A text is reduced to its words (lower case, one space between). Each rule is a regular expression over such text with
keywords, a label and a tier. Rules that lack a keyword in the text are left out, text by text; each rule left reports all
its matches as intervals of words. Overlaps are resolved by priority and containment: a detection goes if its interval lies
within that of another of the same or a stronger tier (of equal intervals in one tier the rule that comes first stays; rules
stand longest pattern first). Intervals that merely cross both stay. Base phrases are found apart from the rules and always
stay.

As no rule accepts more than ``REACH`` words, what may contain a detection stands among those that start shortly before it,
so each is compared with a bounded number of neighbours, and the work is linear in the text.

Rules come from a table of licenses and a few templates (notice, identifier, title, tag), and a list of single clauses.

Edge cases: null and empty texts have no words, no labels and the score 0; every place of a match stands in ``found``;
repeated rows are scanned alike; an empty table gives an empty result; other columns pass through except those added.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Bytes that separate words, once text is lower-case.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, keyword (or several, one of which stands in whatever the name accepts), name (pattern over words), identifier words.
LICENSES = (
    ("apache-2.0", "apache", "apache(?: software)? license(?: version)? 2(?: 0)?", "apache 2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)? license(?: version)? 1 1", "apache 1 1"),
    ("mit", "mit", "mit license", "mit"),
    ("mit-0", "mit no attribution", "mit no attribution(?: license)?", "mit 0"),
    ("isc", "isc", "isc license", "isc"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause)(?: license)?", "0bsd"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd 4 clause"),
    ("bsd", "bsd", "bsd(?: style)? license", "bsd"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license(?: version| v)? ?3?(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public license(?: version| v) ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public license(?: version| v) ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", ("lesser", "library"), "(?:gnu )?(?:lesser|library) general public license", "lgpl"),
    ("gpl-1.0", "general public", "(?:gnu )?general public license(?: version| v) ?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public license(?: version| v) ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general public", "(?:gnu )?general public license(?: version| v) ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "general public", "(?:gnu )?general public license", "gpl(?: v ?[123])?"),
    ("gfdl-1.3", "free documentation", "(?:gnu )?free documentation license(?: version 1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? ?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)? ?2 0", "mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public license(?: version| v)? ?1 0", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? ?2 0", "epl 2 0"),
    ("edl-1.0", "eclipse", "eclipse distribution license(?: version| v)? ?1 0", "edl 1 0"),
    ("cddl-1.0", "development and distribution", "common development and distribution license(?! version 1 1)(?: version)?(?: 1 0)?", "cddl 1 0"),
    ("cddl-1.1", "development and distribution", "common development and distribution license version 1 1", "cddl 1 1"),
    ("cpl-1.0", "common public", "common public license(?: version)?(?: 1 0)?", "cpl 1 0"),
    ("eupl-1.1", "european union", "european union public licen[cs]e(?: version)? 1 1", "eupl 1 1"),
    ("eupl-1.2", "european union", "european union public licen[cs]e(?: version)? 1 2", "eupl 1 2"),
    ("osl-3.0", "open software", "open software license(?: version| v)? ?3 0", "osl 3 0"),
    ("afl-3.0", "academic free", "academic free license(?: version| v)? ?3 0", "afl 3 0"),
    ("artistic-1.0", "artistic", "artistic license 1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic license 2 0", "artistic 2 0"),
    ("bsl-1.0", "boost", "boost software license(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("busl-1.1", "business source", "business source license(?: version)?(?: 1 1)?", "busl 1 1"),
    ("sspl-1.0", "server side", "server side public license(?: version)?(?: v? ?1)?", "sspl 1 0"),
    ("elastic-2.0", "elastic", "elastic license(?: version)?(?: 2 0)?", "elastic 2 0"),
    ("zlib", "zlib", "zlib(?: libpng)? license", "zlib"),
    ("libpng-2.0", ("png reference library", "libpng"), "(?:png reference library|libpng) license(?: version)?(?: 2)?", "libpng 2 0"),
    ("ijg", "jpeg", "independent jpeg group license", "ijg"),
    ("openssl", "openssl", "openssl license", "openssl"),
    ("curl", "curl", "curl license", "curl"),
    ("ntp", "ntp", "ntp license", "ntp"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql"),
    ("php-3.01", "php", "php license(?: version)?(?: 3 01)?", "php 3 01"),
    ("python-2.0", "python", "python software foundation license(?: version)?(?: 2)?", "python 2 0"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("perl", ("perl itself", "perl license"), "(?:same terms as perl itself|perl license)", "artistic 1 0 perl"),
    ("ofl-1.1", "open font", "(?:sil )?open font license(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license", "ncsa"),
    ("w3c", "w3c", "w3c software(?: notice and)? license", "w3c"),
    ("unicode", "unicode", "unicode(?: inc)? license(?: agreement)?", "unicode dfs 20(?:15|16)"),
    ("upl-1.0", "universal permissive", "universal permissive license(?: version)?(?: v? ?1 0)?", "upl 1 0"),
    ("unlicense", "unlicense", "unlicense(?: license)?", "unlicense"),
    ("wtfpl", "what the", "do what the \\w+ you want to public license", "wtfpl"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("apsl-2.0", "apple", "apple public source license(?: version)?(?: 2 0)?", "apsl 2 0"),
    ("ipl-1.0", "ibm", "ibm public license(?: version)?(?: 1 0)?", "ipl 1 0"),
    ("qpl-1.0", "q public", "q public license(?: version)?(?: 1 0)?", "qpl 1 0"),
    ("mulan-2.0", "mulan", "mulan permissive software license(?: version)?(?: v? ?2)?", "mulanpsl 2 0"),
    ("cecill-2.1", "cecill", "cecill(?: free software)? license(?: agreement)?(?: version)?(?: 2 1)?", "cecill 2 1"),
    ("vim", "vim", "vim license", "vim"),
    ("beerware", "beer", "beer ?ware license", "beerware"),
    ("json", "json", "json license", "json"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: public domain dedication)?(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1234] [05])?", "cc by nc nd [1234] [05]"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1234] [05])?", "cc by nc sa [1234] [05]"),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1234] [05])?", "cc by nc [1234] [05]"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1234] [05])?", "cc by nd [1234] [05]"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1234] [05])?", "cc by sa [1234] [05]"),
    ("cc-by", "cc by", "cc by(?: [1234] [05])?", "cc by [1234] [05]"),
    ("cc-by-nc-sa", "attribution", "(?:creative commons )?attribution non ?commercial share ?alike(?: [1234] [05])?", "ccbyncsa"),
    ("cc-by-nc", "attribution", "(?:creative commons )?attribution non ?commercial(?: [1234] [05])?", "ccbync"),
    ("cc-by-sa", "attribution", "(?:creative commons )?attribution share ?alike(?: [1234] [05])?", "ccbysa"),
    ("cc-by-nd", "attribution", "(?:creative commons )?attribution no ?deriv(?:ative)?s(?: [1234] [05])?", "ccbynd"),
    ("odbl-1.0", "open database", "open database license(?: v? ?1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "open data commons", "open data commons attribution license(?: v? ?1 0)?", "odc by 1 0"),
    ("pddl-1.0", "public domain dedication", "public domain dedication and license(?: v? ?1 0)?", "pddl 1 0"),
    ("ogl-uk-3.0", "open government", "open government licen[cs]e(?: v? ?3 0)?", "ogl uk 3 0"),
    ("openrail", ("openrail", "open rail"), "(?:bigscience |creativeml )?open ?rail(?: m)?(?: license)?", "openrail"),
    ("llama", "llama", "llama \\d community license(?: agreement)?", "llama\\d"),
)
#: Label, keyword or several, pattern, tier: clauses that name no license.
CLAUSES = (
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy", 1),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 1),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification", 1),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it", 1),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 1),
    ("public-domain", "public domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 2),
    ("public-domain", "rights reserved", "no rights reserved", 2),
    ("reserved", "reserved", "all rights (?:are )?reserved", 2),
    ("reserved", "rechte vorbehalten", "alle rechte vorbehalten", 2),
    ("reserved", "droits réservés", "tous droits réservés", 2),
    ("reserved", "derechos reservados", "todos los derechos reservados", 2),
    ("proprietary", "proprietary", "proprietary and confidential|confidential and proprietary", 2),
    ("proprietary", "internal use", "for internal use only", 2),
    ("proprietary", "redistribut", "(?:may|must|do) not (?:be )?(?:copied or )?redistribut(?:e|ed)", 2),
    ("proprietary", "written permission", "without (?:the )?(?:prior )?(?:express )?written permission", 3),
    ("non-commercial", "commercial use only", "(?:for )?non ?commercial use only", 2),
    ("no-warranty", "warrant", "without (?:any )?warrant(?:y|ies)(?: of any kind)?|as is without warranty", 3),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)?\\d\\d)?", 3),
    ("copyright", "copyright", "copyright (?:c|by|of)", 3),
    ("copyleft", "copyleft", "copyleft", 3),
    ("terms", "terms of use", "terms of use", 3),
    ("mit", "shall be included in all copies", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1),
    ("mit-0", "without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 2),
    ("isc", "above copyright notice", "provided that the above copyright notice and this permission notice appear in all copies", 1),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice", 1),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice", 1),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission", 1),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1),
    ("apache-2.0", "apache org", "(?:http|https) www apache org licenses license 2 0(?: txt| html)?", 1),
    ("apache-2.0", "compliance with the license", "you may not use this file except in compliance with the license", 1),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation", 2),
    ("gpl", "received a copy of the gnu", "you should have received a copy of the gnu general public license", 1),
    ("lgpl", "received a copy of the gnu", "you should have received a copy of the gnu (?:lesser|library) general public license", 1),
    ("agpl-3.0", "received a copy of the gnu", "you should have received a copy of the gnu affero general public license", 1),
    ("gpl", "either version", "either version [123](?: 0)? of the license or (?:at your option )?any later version", 2),
    ("gpl", "gnu org", "(?:http|https) www gnu org licenses(?: gpl(?: [123] 0)?(?: html| txt)?)?", 2),
    ("lgpl", "gnu org", "(?:http|https) www gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?", 2),
    ("agpl-3.0", "gnu org", "(?:http|https) www gnu org licenses agpl(?: 3 0)?(?: html| txt)?", 2),
    ("gfdl-1.3", "invariant sections", "with no invariant sections no front cover texts and no back cover texts", 1),
    ("mpl-2.0", "subject to the terms of the mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 1),
    ("mpl-2.0", "mozilla org", "(?:http|https) (?:www )?mozilla org mpl 2 0", 1),
    ("epl-2.0", "eclipse org", "(?:http|https) www eclipse org legal epl 2 0", 1),
    ("epl-1.0", "eclipse org", "(?:http|https) www eclipse org legal epl v10(?: html)?", 1),
    ("eclipse", "accompanying materials", "this program and the accompanying materials are made available under the terms of the", 2),
    ("bsl-1.0", "boost org", "(?:http|https) www boost org license 1 0 txt", 1),
    ("zlib", "express or implied warranty", "this software is provided as is without any express or implied warranty", 1),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented", 1),
    ("unlicense", "unlicense org", "(?:http|https) unlicense org", 1),
    ("cc0-1.0", "publicdomain", "creativecommons org publicdomain zero 1 0", 1),
    ("public-domain", "publicdomain", "creativecommons org publicdomain mark 1 0", 1),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1234] [05]", 1),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1234] [05]", 1),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1234] [05]", 1),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1234] [05]", 1),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1234] [05]", 1),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1234] [05]", 1),
    ("cc-by", "creative commons attribution", "creative commons attribution(?: [1234] [05])?(?: international| generic| unported)?(?: license)?", 2),
    ("ofl-1.1", "sil org", "(?:http|https) scripts sil org ofl", 1),
    ("wtfpl", "wtfpl", "(?:http|https) www wtfpl net", 1),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 1),
    ("python-2.0", "psf is making", "psf is making python available to licensee on an as is basis", 1),
    ("proprietary", "trade secret", "(?:contains|constitutes) (?:confidential )?trade secrets?(?: and confidential information)?", 2),
    ("proprietary", "is confidential", "this (?:document|file|software) is confidential", 2),
    ("proprietary", ("unauthorized", "unauthorised"), "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: of this (?:file|software|document))?(?: via any medium)? is (?:strictly )?prohibited", 2),
    ("proprietary", "reverse engineer", "you may not (?:copy modify )?(?:or )?reverse engineer", 2),
    ("proprietary", "license agreement", "end user license agreement", 2),
    ("proprietary", "evaluation purposes", "for evaluation purposes only", 2),
    ("proprietary", "not for distribution", "not for distribution", 3),
    ("non-commercial", "commercial use", "for (?:your )?personal (?:and )?non ?commercial use(?: only)?", 2),
    ("non-commercial", ("use only", "purposes only"), "for (?:academic and |non ?commercial )?research (?:and educational )?(?:use|purposes) only", 2),
    ("no-derivatives", "derivative works", "(?:no|may not create|not create) derivative works", 2),
    ("share-alike", "same license", "distribute (?:your contributions|the resulting work) under the same license", 2),
    ("attribution", "appropriate credit", "you must give appropriate credit", 2),
    ("no-warranty", "merchantability", "(?:implied )?warrant(?:y|ies) of merchantability(?: (?:and|or) fitness for a particular purpose)?", 3),
    ("no-liability", "in no event shall", "in no event shall (?:the )?(?:authors?|copyright holders?|contributors)(?: or (?:the )?(?:authors?|copyright holders?|contributors))? be liable", 3),
    ("patent", "patent license", "(?:royalty free|irrevocable) patent license", 3),
    ("trademark", "registered trademark", "registered trademarks? of", 3),
    ("reserved", "rights reserved", "some rights reserved", 2),
    ("reserved", "diritti riservati", "tutti i diritti riservati", 2),
    ("reserved", "direitos reservados", "todos os direitos reservados", 2),
    ("reserved", "rechten voorbehouden", "alle rechten voorbehouden", 2),
    ("copyright", "urheberrecht", "urheberrechtlich geschützt", 3),
    ("public-domain", "gemeinfrei", "gemeinfrei", 3),
    ("public-domain", "domaine public", "(?:dans le |du )?domaine public", 3),
    ("public-domain", "dominio público", "(?:de |en el )?dominio público", 3),
)


@dataclass(frozen=True)
class Rule:
    """needs: groups of keywords; what the pattern accepts holds one of each group."""

    name: str
    label: str
    needs: tuple[tuple[str, ...], ...]
    pattern: str
    tier: int


def _several(keyword: str | tuple[str, ...]) -> tuple[str, ...]:
    return (keyword,) if isinstance(keyword, str) else keyword


def rules() -> list[Rule]:
    """All rules in the order in which they are tried."""
    out = []
    grant = "(?:licen[sc]ed|released|distributed|available|published|shared|provided) under (?:the )?(?:terms of )?(?:the )?"
    for n, (label, keyword, name, spdx) in enumerate(LICENSES):
        own, begin = _several(keyword), re.match("[a-z0-9 ]+", spdx)[0]
        out.append(Rule(f"notice-{n}", label, (own,), grant + name, 1))
        out.append(Rule(f"identifier-{n}", label, (("spdx",), (begin,)), f"spdx license identifier {spdx}", 1))
        out.append(Rule(f"title-{n}", label, (own,), f"(?:the )?{name}", 2))
        out.append(Rule(f"tag-{n}", label, (("licen",), (begin,)), f"(?:licen[cs]e|licen[sc]ed under)(?: the)? {spdx}", 3))
    out += [Rule(f"clause-{n}", label, (_several(keyword),), pattern, tier) for n, (label, keyword, pattern, tier) in enumerate(CLAUSES)]
    return sorted(out, key=lambda r: (r.tier, -len(r.pattern), r.name))


#: No rule accepts more words: a space in a pattern stands for one at most.
REACH = max(r.pattern.count(" ") for r in rules()) + 1


def _always(pattern: str) -> str:
    """What is left of a pattern without its groups, optional or not, and optional letters: all that it accepts holds this."""
    while (bare := re.sub(r"\((?:[^()\\]|\\.)*\)\??", "\0", pattern)) != pattern:
        pattern = bare
    return re.sub(r".\?", "\0", pattern) if "|" not in pattern else ""


def gate() -> list[str]:
    """Any text with a match of a rule, or with a base phrase, holds one of these: "licen" stands for the rules that always
    have it, as many of their keywords are common words; the others have their keywords."""
    words = {p for p, _ in BASE}.union(*(("licen",) if "licen" in _always(r.pattern) else r.needs[0] for r in rules()))
    return sorted(w for w in words if not any(x in w for x in words - {w}))


CONFIDENCE = {1: 1.0, 2: 0.8, 3: 0.5}


def words_text(text: Column) -> Column:
    """The words of text, lower-case, with one space before and after each."""
    lower = F.lower(F.coalesce(text, F.lit("")))  # beyond A-Z this changes letters, never where words begin or end
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, _BETWEEN, " ")), F.lit(" "))


def _active(text: Column, every: list[Rule]) -> Column:
    """The rules that may match: one keyword of each of their groups stands in the text."""
    words = sorted({k for r in every for g in r.needs for k in g})
    kept = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.tier).alias("tier"), F.lit(n).alias("rank"), F.array(*(F.array(*map(F.lit, g)) for g in r.needs)).alias("needs"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern")) for n, r in enumerate(every)))
    return _bound(F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(text, k)), lambda have: F.filter(kept, lambda r: F.forall(r["needs"], lambda g: F.arrays_overlap(g, have))))


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


_FOUND = "array<struct<start:int,rest:int,tier:int,rank:int,end:int,rule:string,label:string>>"


def _places(text: Column):
    """All matches of a rule as intervals of words: the matched words are bracketed, and the brackets looked up."""
    begin, end = "\u0001", "\u0002"

    def intervals(marks: Column, r: Column) -> Column:
        at = lambda side: F.transform(F.filter(marks, lambda m: m[side]), lambda m: m["i"])
        one = lambda a, b: F.struct(a.alias("start"), (-b).alias("rest"), r["tier"].alias("tier"), r["rank"].alias("rank"), (b + 1).alias("end"), r["rule"].alias("rule"), r["label"].alias("label"))
        return F.zip_with(at("a"), at("b"), one).cast(_FOUND)

    def of(r: Column) -> Column:
        marked = F.regexp_replace(text, r["pattern"], F.lit(f"{begin}$0{end}"))
        struct = lambda w, i: F.struct(w.startswith(begin).alias("a"), w.endswith(end).alias("b"), (i - 1).alias("i"))
        marks = lambda m: F.filter(F.transform(F.split(m, " "), struct), lambda x: x["a"] | x["b"])
        return _bound(marked, lambda m: F.when(F.contains(m, F.lit(begin)), _bound(marks(m), lambda x: intervals(x, r))).otherwise(F.array().cast(_FOUND)))

    return of


def _kept(found: Column, active: Column) -> Column:
    """Sorted detections without those that lie within another of the same or a stronger tier. All that could contain one
    stand before it, and start at most REACH words earlier, where each rule starts once a word at most."""
    back = F.size(active) * REACH

    def free(d: Column, i: Column) -> Column:
        near = F.slice(found, F.greatest(i - back, F.lit(0)) + 1, F.least(back, i))
        return ~F.exists(near, lambda e: (e["end"] >= d["end"]) & (e["tier"] <= d["tier"]))

    return F.filter(found, free)


def _stands(phrase: str):
    """Whether a phrase's words stand in _words from place i on."""
    first, *others = phrase.split(" ")

    def here(i: Column) -> Column:
        out = F.get("_words", i) == first
        for k, word in enumerate(others, 1):
            out = out & F.coalesce(F.get("_words", i + k) == word, F.lit(False))
        return out

    return here


def _of_tier(tier: int):
    return lambda f: f["tier"] == tier


def scan(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs (without the text) with n_words, n_base, first_word, last_word, base_labels (array), found (array of rule,
    label, tier, start and end in words, in the order of the text), labels (array: both, distinct, sorted) and score: the confidence of the
    strongest tier with a match, 0.4 for a base phrase alone, else 0."""
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "found", "labels", "score", column)
    rest = [c for c in docs.columns if c not in added]
    text = docs.select(*rest, words_text(F.col(column)).alias("_w"))
    may = F.lit(False)
    for x in gate():
        may = may | F.contains("_w", F.lit(x))
    spaces = F.length("_w") - F.length(F.replace("_w", F.lit(" "), F.lit("")))
    gated = text.select(*rest, F.when(F.col("_w") == "  ", 0).otherwise(spaces - 1).cast("long").alias("n_words"), F.when(may, F.col("_w")).alias("_t1"))
    none = F.array().cast("array<int>")
    places = [F.when(F.contains("_t1", F.lit(f" {p} ")), F.filter(F.sequence(F.lit(0), F.size("_words") - 1), _stands(p))).otherwise(none) for p, _ in BASE]
    any_base = F.lit(False)
    for phrase, _ in BASE:
        any_base = any_base | F.contains("_t1", F.lit(f" {phrase} "))
    split = gated.withColumn("_words", F.when(any_base, F.split(F.trim("_t1"), " ")))
    placed = split.select(*rest, "n_words", "_t1", F.concat(*places).alias("_places"), F.array_compact(F.array(*(F.when(F.contains("_t1", F.lit(f" {p} ")), F.lit(x)) for p, x in BASE))).alias("base_labels"))
    text = F.col("_t1")
    now = placed.withColumn("_active", F.when(text.isNotNull(), _active(text, rules())))
    every = now.withColumn("_all", F.when(F.size("_active") > 0, F.array_sort(F.flatten(F.transform("_active", _places(text))))))
    shown = lambda d: F.struct(d["rule"].alias("rule"), d["label"].alias("label"), d["tier"].alias("tier"), d["start"].alias("start"), d["end"].alias("end"))
    left = F.when(F.size("_all") > 0, F.transform(_kept(F.col("_all"), F.col("_active")), shown))
    now = every.withColumn("found", F.coalesce(left, F.array().cast("array<struct<rule:string,label:string,tier:int,start:int,end:int>>")))
    labels = F.array_sort(F.array_union("base_labels", F.array_compact(F.transform("found", lambda f: f["label"]))))
    score = F.lit(0.0)
    score = F.when(F.size("base_labels") > 0, 0.4).otherwise(score)
    for tier, value in sorted(CONFIDENCE.items(), reverse=True):
        score = F.when(F.exists("found", _of_tier(tier)), value).otherwise(score)
    return now.select(
        *rest, "n_words", F.size("_places").cast("long").alias("n_base"), F.array_min("_places").cast("long").alias("first_word"), F.array_max("_places").cast("long").alias("last_word"),
        F.array_sort("base_labels").alias("base_labels"), "found", labels.alias("labels"), score.alias("score"),
    )
