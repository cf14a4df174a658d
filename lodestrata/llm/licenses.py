r"""License scan: ordered signature rules behind a keyword prefilter.

Rules are regular expressions: signatures of the licenses' own wording, written one by one, and rules made from families
(names, versions, identifiers, addresses) and forms of a notice. A rule runs only on texts that hold keywords which each
of its matches contains, so the prefilter loses nothing; words of a rule may stand on several lines with comment marks
between. Detections carry a priority; one that lies inside a detection of the same or a higher priority is suppressed, by
a sweep in order of start.

All of it is SQL expressions within a row: no shuffle, no Python on the executors. Every pattern is a literal of the plan,
so each is compiled once a task. Sums and maxima that run along a text's detections take n log n steps for n of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases (words that stand consecutively) and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Non-words of a text whose A-Z are lower case; WORD is a word of a text as it is.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: White space between two words of a rule, with the comment marks that begin a line; possessive, so it is never read twice.
SPACE = r"(?:(?:[\x20\t\r\x0B\f\u00A0]++|\n[\x20\t\r\x0B\f\u00A0]*+(?:[*#;!|>%]++|//++|--++|dnl\b|rem\b)?+)++)"

#: Family label, keywords of the name (lower case; all are needed, of a|b one), pattern of the name (a space
#: stands for SPACE), versions, address.
FAMILIES = (
    ("agpl", "affero general public", r"(?:gnu )?affero general public licen[sc]e", ("1.0", "3.0"), r"gnu\.org/licenses/agpl"),
    ("lgpl", "lesser|library general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", ("2.0", "2.1", "3.0"), r"gnu\.org/licenses/lgpl"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", ("1.0", "2.0", "3.0"), r"gnu\.org/licenses/gpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", ("1.1", "1.2", "1.3"), r"gnu\.org/licenses/fdl"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", ("1.0", "1.1", "2.0"), r"apache\.org/licenses"),
    ("mit", "mit", r"mit(?:/x11)? licen[sc]e", (), r"opensource\.org/licenses/mit"),
    ("bsd", "bsd", r"(?:new |modified |simplified |original |revised )?(?:[0-4]-clause )?bsd(?:[- ][0-4][- ]clause)? licen[sc]e", (), r"opensource\.org/licenses/bsd"),
    ("mpl", "mozilla public", r"mozilla public licen[sc]e", ("1.0", "1.1", "2.0"), r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", "eclipse public", r"eclipse public licen[sc]e", ("1.0", "2.0"), r"eclipse\.org/legal/epl"),
    ("eupl", "european union public", r"european union public licen[sc]e", ("1.1", "1.2"), r"joinup\.ec\.europa\.eu"),
    ("cddl", "common development", r"common development and distribution licen[sc]e", ("1.0", "1.1"), r"opensource\.org/licenses/cddl"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[sc]e", ("1.0", "2.0"), r"opensource\.org/licenses/artistic"),
    ("bsl", "boost software", r"boost software licen[sc]e", ("1.0",), r"boost\.org/license"),
    ("isc", "isc", r"isc licen[sc]e", (), r"opensource\.org/licenses/isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", (), r"zlib\.net/zlib_license"),
    ("wtfpl", "what want public", r"do what the f\S{1,40} you want to public licen[sc]e", ("1.0", "2.0"), r"wtfpl\.net"),
    ("unlicense", "unlicense", r"the unlicense", (), r"unlicense\.org"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", ("1.0", "1.1"), r"scripts\.sil\.org/ofl"),
    ("psf", "python software foundation", r"python software foundation licen[sc]e", ("2.0",), r"docs\.python\.org/3/license"),
    ("odbl", "open database", r"open (?:data commons open )?database licen[sc]e", ("1.0",), r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "data commons attribution", r"open data commons attribution licen[sc]e", ("1.0",), r"opendatacommons\.org/licenses/by"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", (), r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", (), r"opensource\.org/licenses/ms-rl"),
    ("cpl", "common public", r"common public licen[sc]e", ("1.0",), r"opensource\.org/licenses/cpl"),
    ("ipl", "ibm public", r"ibm public licen[sc]e", ("1.0",), r"opensource\.org/licenses/ipl"),
    ("cecill", "cecill", r"cecill(?:-[bc])?(?: free software)? licen[sc]e", ("1.0", "2.0", "2.1"), r"cecill\.info"),
    ("qpl", "q public", r"q public licen[sc]e", ("1.0",), r"opensource\.org/licenses/qpl"),
    ("sspl", "server side public", r"server side public licen[sc]e", ("1.0",), r"mongodb\.com/licensing"),
    ("busl", "business source", r"business source licen[sc]e", ("1.0", "1.1"), r"mariadb\.com/bsl"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", (), r"opensource\.org/licenses/postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e", (), r"opensource\.org/licenses/ncsa"),
    ("openrail", "open rail", r"(?:bigscience |creativeml )?open ?rail(?:-?\+?\+?m)? licen[sc]e", (), r"huggingface\.co/spaces/\S{1,200}/license"),
)
#: Label, priority, keywords (lower case; all are needed, of a|b one) and a signature of the license's wording.
#: A comma or full stop may be missing; a space stands for SPACE.
SIGNATURES = (
    ("mit", 3, "permission charge", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 3, "copyright permission", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions of the software"),
    ("mit-0", 3, "sublicense and/or", r"publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided"),
    ("x11", 3, "advertising otherwise", r"shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software without prior written authorization"),
    ("bsd", 3, "redistribution binary", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", 3, "neither endorse", r"neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|any|the) (?:\S+ )?contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 3, "advertising mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", 3, "views conclusions", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("0bsd", 3, "permission fee", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software"),
    ("isc", 3, "permission fee", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("hpnd", 3, "permission fee documentation", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("postgresql", 3, "purpose written agreement", r"for any purpose, without fee, and without a written agreement is hereby granted"),
    ("apache-2.0", 3, "apache compliance", r"you may not use this file except in compliance with the license\. you may obtain a copy of the license at https?://www\.apache\.org/licenses/license-2\.0"),
    ("apache-2.0", 3, "reproduce irrevocable", r"perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works of"),
    ("apache-1.1", 3, "developed apache", r"this product includes software developed by the apache software foundation"),
    ("gpl", 3, "redistribute general", r"this (?:program|library|file|software) is free software[;:,]? you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", 4, "general option", r"gnu general public license as published by the free software foundation[;,]? either version 2(?:\.0)? of the license, or \(at your option\) any later version"),
    ("gpl-3.0-or-later", 4, "general option", r"gnu general public license as published by the free software foundation[;,]? either version 3(?:\.0)? of the license, or \(at your option\) any later version"),
    ("gpl-2.0-only", 4, "general published", r"gnu general public license version 2(?:\.0)? as published by the free software foundation"),
    ("gpl", 2, "warranty merchantability general", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license"),
    ("lgpl", 3, "redistribute lesser|library", r"this (?:program|library|file|software) is free software[;:,]? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1-or-later", 4, "lesser option", r"gnu lesser general public license as published by the free software foundation[;,]? either version 2\.1 of the license, or \(at your option\) any later version"),
    ("lgpl-3.0-or-later", 4, "lesser option", r"gnu lesser general public license as published by the free software foundation[;,]? either version 3(?:\.0)? of the license, or \(at your option\) any later version"),
    ("agpl-3.0-or-later", 4, "affero option", r"gnu affero general public license as published by the free software foundation[;,]? either version 3(?:\.0)? of the license, or \(at your option\) any later version"),
    ("agpl", 3, "remotely network", r"all users interacting with it remotely through a computer network"),
    ("gfdl", 3, "document documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", 4, "source mozilla", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-1.1", 4, "contents mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-2.0", 3, "secondary incompatible", r"incompatible with secondary licenses"),
    ("epl-1.0", 4, "accompanying eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1\.0"),
    ("epl-2.0", 4, "accompanying eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v(?:ersion)?\.?)? ?2\.0"),
    ("cddl", 3, "contents development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("bsl-1.0", 3, "solely machine-executable", r"unless such copies or derivative works are solely in the form of machine-executable object code"),
    ("bsl-1.0", 3, "charge organization", r"free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", 3, "misrepresented origin", r"the origin of this software must not be misrepresented[;,]? you must not claim that you wrote the original software"),
    ("zlib", 3, "altered plainly", r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("unlicense", 3, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 3, "what want", r"you just do what the f\S{1,40} you want to"),
    ("artistic-2.0", 3, "verbatim preamble", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed\. preamble this license establishes the terms under which a given free software package"),
    ("ofl-1.1", 4, "font licensed", r"this font software is licensed under the sil open font license, version 1\.1"),
    ("ofl", 3, "reserved font name", r"no modified version of the font software may use the reserved font names?"),
    ("psf-2.0", 3, "psf nonexclusive", r"psf hereby grants licensee a nonexclusive, royalty-free, world-?wide license"),
    ("ncsa", 3, "restriction deal", r"to deal with the software without restriction, including without limitation the rights to use"),
    ("eupl", 3, "eupl licen", r"licen[sc]ed under the eupl"),
    ("cecill", 3, "cecill governed", r"governed by the cecill(?:-[bc])? license under french law"),
    ("openssl", 3, "openssl product|toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php", 3, "php freely", r"this product includes php software, freely available from"),
    ("json", 3, "evil good", r"the software shall be used for good, not evil"),
    ("beerware", 3, "beer", r"(?:you can|and you think this stuff is worth it, you can) buy me a beer in return"),
    ("curl", 3, "shall advertising holder", r"except as contained in this notice, the name of a copyright holder shall not be used in advertising"),
    ("unicode", 3, "unicode data", r"obtaining a copy of the unicode data files and any associated documentation"),
    ("ijg", 3, "jpeg independent", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", 3, "freetype portions", r"portions of this software are copyright \S{1,40}(?: \S{1,20})? the freetype project"),
    ("w3c", 3, "w3c documentation|document|software", r"w3c(?:\x28r\x29|®)? software(?: and document)? notice and license"),
    ("sspl-1.0", 3, "service functionality third", r"if you make the functionality of the program or a modified version available to third parties as a service, you must make the service source code available"),
    ("busl-1.1", 3, "licensor grants", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work"),
    ("elastic-2.0", 3, "hosted managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 3, "grant sell", r"the license does not grant to you, the right to sell the software"),
    ("ms-pl", 3, "contributor reproduce", r"each contributor grants you a non-exclusive, worldwide, royalty-free copyright license to reproduce its contribution"),
    ("afl", 3, "academic licensed", r"licensed under the academic free license version [0-9]\.[0-9]"),
    ("osl", 3, "open licensed", r"licensed under the open software license version [0-9]\.[0-9]"),
    ("cc0-1.0", 3, "affirmer waives", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("cc-by-4.0", 4, "creative attribution", r"this work is licensed under (?:a|the) creative commons attribution 4\.0 international license"),
    ("cc-by-sa-4.0", 4, "creative attribution", r"this work is licensed under (?:a|the) creative commons attribution-share ?alike 4\.0 international license"),
    ("cc-by-nc-4.0", 4, "creative attribution", r"this work is licensed under (?:a|the) creative commons attribution-non ?commercial 4\.0 international license"),
    ("cc-by-nc-sa-4.0", 4, "creative attribution", r"this work is licensed under (?:a|the) creative commons attribution-non ?commercial-share ?alike 4\.0 international license"),
    ("cc-by-nc-nd-4.0", 4, "creative attribution", r"this work is licensed under (?:a|the) creative commons attribution-non ?commercial-no ?derivatives 4\.0 international license"),
    ("openrail", 3, "use-based restrictions", r"use-based restrictions as referenced in paragraph 5"),
    ("llama", 3, "llama licensed", r"llama [0-9.]{1,4} is licensed under the llama [0-9.]{1,4} community license"),
    ("proprietary", 3, "confidential proprietary", r"(?:unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|material|document)|(?:this|these) (?:file|software|material|document)s? (?:is|are|contains?) confidential and proprietary)"),
)
#: Creative Commons suites and versions.
CC_SUITES = ("by-nc-nd", "by-nc-sa", "by-nc", "by-nd", "by-sa", "by", "zero")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Beginnings one of which is in any short name of a Creative Commons license.
CC_SHORT = ("cc-", "cc0", "cc ", "cc\n", "cc\t", "cc\r", "cc\x0b", "cc\f", "cc\u00a0")

_NOTICE = r"(?:licen[sc]ed|released|distributed|published|available|made available|covered|provided|redistributed)(?: to you)? under (?:the )?(?:terms of )?(?:the )?"
_VERSION = r",? ?(?:\(?(?:version|v\.?|ver\.?) ?)?"


def _spaced(pattern: str) -> str:
    """A pattern with SPACE for its spaces."""
    return pattern.replace("[- ]", f"(?:-|{SPACE})").replace(" ", SPACE)


def _worded(signature: str) -> str:
    """A signature whose commas and full stops may be missing, bounded by word ends."""
    return rf"\b{re.sub(r', ', ',? ', re.sub(r'\\. ', r'\\.? ', signature))}(?!\w)"


def _host(address: str) -> str:
    """The literal beginning of an address rule."""
    return re.split(r"\(|\\S", address)[0].replace("\\", "")


def rules() -> list[dict]:
    """Groups as {"gate", "rules": [{"label", "priority", "pattern"}]}; a few hundred rules in all.

    gate is a list of lists of keywords: every match of the group's rules contains a word of each list.
    """
    groups: list[tuple] = []
    spdx = []
    for label, keywords, name, versions, address in FAMILIES:
        own = [(label, 1, rf"\b{name}\b"), (label, 2, rf"\b{_NOTICE}{name}\b")]
        spdx.append((label, 4, rf"spdx-license-identifier: ?{re.escape(label)}\b"))
        for v in versions:
            number = re.escape(v.removesuffix(".0")) + (r"(?:\.0)?" if v.endswith(".0") else "") + r"(?![0-9]|\.[0-9])"
            own += [(f"{label}-{v}", 3, rf"\b{name}{_VERSION}{number}"), (f"{label}-{v}", 4, rf"\b{_NOTICE}{name}{_VERSION}{number}")]
            spdx.append((f"{label}-{v}", 4, rf"spdx-license-identifier: ?{re.escape(label)}-{number}(?:-or-later|-only)?"))
        groups += [([k.split("|") for k in ("licen", *keywords.split())], own), ([[_host(address)]], [(label, 2, address)])]
    groups += [([k.split("|") for k in keywords.split()], [(label, priority, _worded(signature))]) for label, priority, keywords, signature in SIGNATURES]
    groups.append(([["spdx-license-identifier"]], spdx))
    short, long = [], []
    for suite in CC_SUITES:
        said = r"(?:cc0|cc[- ]zero)" if suite == "zero" else "cc[- ]" + suite.replace("-", "[- ]")
        parts = {"by": "attribution", "nc": "non-?commercial", "nd": "no-?deriv(?:ative|s|atives)(?: works)?", "sa": "share-?alike", "zero": "zero"}
        full = r"creative commons " + r"[- ]".join(parts[p] for p in suite.split("-"))
        short.append((f"cc-{suite}", 2, rf"\b{said}(?![a-z])"))
        long.append((f"cc-{suite}", 2, rf"\b{full}\b"))
        for v in CC_VERSIONS:
            number = re.escape(v) + r"(?![0-9])"
            short.append((f"cc-{suite}-{v}", 3, rf"\b{said}[- ]{number}"))
            long.append((f"cc-{suite}-{v}", 3, rf"\b{full}(?: licen[sc]e)?{_VERSION}{number}"))
    groups += [
        ([CC_SHORT], short),
        ([["creative"], ["commons"]], long),
        ([["domain"], ["public"]], [("public-domain", 2, r"\b(?:dedicated to|placed in|released into|in) the public domain\b")]),
        ([["reserved"], ["rights"]], [("proprietary", 2, r"\ball rights reserved\b"), ("proprietary", 3, r"copyright (?:\(c\)|©)?[^\n]{0,80}all rights reserved\b")]),
    ]
    return [{"gate": [list(any_of) for any_of in gate], "rules": [{"label": label, "priority": p, "pattern": _spaced(x)} for label, p, x in own]} for gate, own in groups]


def gates() -> list[str]:
    """Words one of which a text must hold for any rule to match: of each group those of its gate's first list."""
    words = {w for f in rules() for w in f["gate"][0]}
    return sorted(w for w in words if not any(o != w and o in w for o in words))


_FOUND = "array<struct<start: int, back: int, rank: int, label: string>>"
_PARTS = "array<struct<label: string, rank: int, parts: array<string>>>"

def _running(values: str, combine: str) -> str:
    """SQL of running results over an array: combine (of y, the results up to some item before, and x, those since) is associative.

    Every round doubles how many items a result covers, so n items take n log n steps; appending results one after
    another to an array would copy it for each of them.
    """
    rounds = "sequence(0, cast(ceil(log2(size(v))) as int) - 1)"
    reach = "cast(shiftleft(1, k) as int)"
    one = f"transform(a, (x, i) -> if(i < {reach}, x, transform(array(a[i - {reach}]), y -> {combine})[0]))"
    return f"transform(array({values}), v -> if(size(v) < 2, v, aggregate({rounds}, v, (a, k) -> {one})))[0]"


def _gate(words_lists: list[list[str]]) -> str:
    quoted = lambda w: "'" + "".join(c if " " < c < "\x7f" and c not in "'\\" else f"\\u{ord(c):04x}" for c in w) + "'"
    return " and ".join("(" + " or ".join(f"contains(low, {quoted(w)})" for w in words) + ")" for words in words_lists)


def detect(text: str, gated: bool = True) -> Column:
    """array<struct<start, end, priority, label>> of the column's detections that aren't suppressed; code points of the lower-cased text.

    Without gates every rule runs on every text; the result is the same. Of detections over the same code points with the
    same priority the first label in order of name stays.
    """
    # a rule's matches: the text is split at marks around them, so that odd parts are matches
    run = lambda r: f"named_struct('label', '{r['label']}', 'rank', {-r['priority']}, 'parts', split(regexp_replace(low, r'{r['pattern']}', '\\u0001$0\\u0001'), '\\u0001', -1))"
    groups = [(f"if({_gate(g['gate'])}, " if gated else "(") + f"array({', '.join(map(run, g['rules']))})" + (f", from_json('[]', '{_PARTS}'))" if gated else ")") for g in rules()]
    every = f"filter(flatten(array({', '.join(groups)})), m -> size(m.parts) > 1)"
    ends = _running("transform(p, t -> length(t))", "x + y")
    one = f"transform(array(m.parts), p -> transform(array({ends}), at -> transform(sequence(1, size(p) - 2, 2), i -> named_struct('start', at[i - 1], 'back', -at[i], 'rank', m.rank, 'label', m.label)))[0])[0]"
    found = f"array_sort(cast(flatten(transform({every}, m -> {one})) as {_FOUND}))"
    levels = (4, 3, 2, 1)
    reaches = ", ".join(f"'m{p}', if(-x.rank >= {p}, -x.back, -1)" for p in levels)
    furthest = _running(f"transform(f, x -> named_struct({reaches}))", "named_struct(" + ", ".join(f"'m{p}', greatest(x.m{p}, y.m{p})" for p in levels) + ")")
    inside = "i > 0 and case -x.rank " + " ".join(f"when {p} then b[i - 1].m{p}" for p in levels) + " end >= -x.back"
    kept = f"filter(transform(array({furthest}), b -> transform(f, (x, i) -> if({inside}, null, named_struct('start', x.start, 'end', -x.back, 'priority', -x.rank, 'label', x.label))))[0], x -> x is not null)"
    shaped = f"transform(array(translate(lower(coalesce({text}, '')), '\\u0001', '\\u0002')), low -> transform(array({found}), f -> {kept})[0])[0]"
    any_gate = _gate([gates()]).replace("low,", f"lower(coalesce({text}, '')),") if gated else "true"
    return F.expr(f"if({any_gate}, {shaped}, from_json('[]', 'array<struct<start: int, end: int, priority: int, label: string>>'))")


def _words_in(spaced: Column) -> Column:
    """Words of a string in which every word has one space on either side."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    A null text counts as empty: no words, no places, no labels, score 0. Very long texts are scanned whole. Repeated rows
    and null ids are rows of their own; ties between detections are settled as in detect(). An empty table gives no rows;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low = F.lower("text")
    may = F.contains(low, F.lit("license")) | (F.contains(low, F.lit("cc")) & F.contains(low, F.lit("by")))
    words = F.trim(F.regexp_replace(low, NON_WORD, " "))
    spaced = F.when(may, F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))).otherwise(F.lit(""))
    rows = rows.select("doc_id", "text", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), spaced.alias("spaced"), detect("text").alias("detections"))
    firsts, lasts, counts, labels = [], [], [], []
    for phrase, label in BASE:
        own = F.lit(" " + phrase.replace(" ", "  ") + " ")
        n = ((F.length("spaced") - F.length(F.replace("spaced", own, F.lit("")))) / F.length(own)).cast("long")
        there = F.contains("spaced", own)
        counts.append(F.when(there, n).otherwise(F.lit(0)))
        firsts.append(F.when(there, _words_in(F.substring_index(F.col("spaced"), own_text(phrase), 1))))
        lasts.append(F.when(there, F.col("n_words") - _words_in(F.substring_index(F.col("spaced"), own_text(phrase), -1)) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    base = F.array_sort(F.array_compact(F.array(*labels)))
    best = F.coalesce(F.array_max(F.transform("detections", lambda x: x["priority"])), F.lit(0))
    n_base = sum(counts[1:], counts[0])
    return rows.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("detections", lambda x: x["label"]))), ",").alias("labels"),
        F.greatest(best / 4.0, F.when(n_base > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"), "detections",
    )


def own_text(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "
