"""Licence signatures: hand-written patterns, in order, on text with A-Z lower-cased.

A rule is (label, rank, keyword, pattern). The keyword says when the pattern is tried: alternatives stand
between bars, and the text must hold all words of one, in any place. A match holds them all, whatever its
blanks, so no match goes untried. Two sentences that several licences share (``SHARED``) also need the
licence's name somewhere in the text. Blanks in a pattern stand for any run of blanks and comment marks.
Lower ranks win. A match's place is that of its group ``id`` where it has one: each identifier of an SPDX
expression is a detection of its own, so the licences of a choice stand beside each other.
"""

from __future__ import annotations

#: Ranks and what a detection of each is worth.
TAG, GRANT, VERSION, TITLE, LINK, MENTION = range(6)
WORTH = {TAG: 1.0, GRANT: 1.0, VERSION: 0.9, TITLE: 0.8, LINK: 0.8, MENTION: 0.6}

#: Words of keywords that need not be in the sentence: MPL, CDDL and ECL notices, and all GNU ones, have the same.
SHARED = {"you may not use this file": "apache", "either version": "gnu"}

#: What stands before an identifier in an SPDX expression: the tag and any operands before it; its blanks are plain ones.
_TAGGED = (
    r"spdx-license-identifier: ?(?:[(\"'<\x20]*[\w.+:-]+(?:[)\x20]+(?:and|or|with)(?=[(\x20])|[)\x20]*[,/;|]))*?"
    r"[(\"'<\x20]*(?P<id>"
)

#: label, SPDX stem, keyword, title, versions (empty: none are written), link
_FAMILIES = [
    ("agpl", "agpl", "affero", r"(?:gnu )?affero (?:general )?public licen[sc]e", ["1.0", "3.0", "3"], r"gnu\.org/licenses/agpl"),
    ("lgpl", "lgpl", "gnu", r"gnu (?:lesser|library) (?:general )?public licen[sc]e", ["2.0", "2.1", "3.0", "2", "3"], r"gnu\.org/licenses/lgpl"),
    ("gpl", "gpl", "gnu", r"gnu general public licen[sc]e", ["1.0", "2.0", "3.0", "1", "2", "3"], r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("gfdl", "gfdl", "gnu", r"gnu free documentation licen[sc]e", ["1.1", "1.2", "1.3"], r"gnu\.org/licenses/fdl"),
    ("apache", "apache", "apache", r"apache(?: software)? licen[sc]e", ["1.0", "1.1", "2.0", "2"], r"apache\.org/licenses"),
    ("mit", "mit", "mit", r"mit(?: |-)licen[sc]e", [], r"opensource\.org/licenses?/mit"),
    ("mit-0", "mit-0", "mit", r"mit no attribution(?: licen[sc]e)?", [], r"opensource\.org/licenses?/mit-0"),
    ("bsd", "bsd", "bsd", r"bsd licen[sc]e", [], r"opensource\.org/licenses?/bsd"),
    ("bsd-2-clause", "bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|(?:2|two)[- ]clause bsd|bsd (?:2|two)[- ]clause)(?: licen[sc]e)?", [], r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd-3-clause", "bsd", r"(?:(?:new|modified|revised) bsd|(?:3|three)[- ]clause bsd|bsd (?:3|three)[- ]clause)(?: licen[sc]e)?", [], r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd-4-clause", "bsd-4-clause", "bsd", r"(?:original bsd|(?:4|four)[- ]clause bsd|bsd (?:4|four)[- ]clause)(?: licen[sc]e)?", [], r"spdx\.org/licenses/bsd-4-clause"),
    ("0bsd", "0bsd", "bsd", r"(?:zero[- ]clause bsd|bsd zero[- ]clause)(?: licen[sc]e)?", [], r"opensource\.org/licenses?/0bsd"),
    ("isc", "isc", "isc", r"isc licen[sc]e", [], r"opensource\.org/licenses?/isc"),
    ("mpl", "mpl", "mozilla", r"mozilla public licen[sc]e", ["1.0", "1.1", "2.0"], r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", "epl", "eclipse", r"eclipse public licen[sc]e", ["1.0", "2.0"], r"eclipse\.org/(?:legal|org/documents)/epl"),
    ("edl", "bsd-3-clause", "eclipse", r"eclipse distribution licen[sc]e", ["1.0"], r"eclipse\.org/org/documents/edl"),
    ("eupl", "eupl", "european", r"european union public licen[sc]e", ["1.0", "1.1", "1.2"], r"joinup\.ec\.europa\.eu/.{0,80}eupl"),
    ("cddl", "cddl", "common", r"common development and distribution licen[sc]e", ["1.0", "1.1"], r"opensource\.org/licenses?/cddl"),
    ("cpl", "cpl", "common", r"common public licen[sc]e", ["0.5", "1.0"], r"opensource\.org/licenses?/cpl"),
    ("cpal", "cpal", "common", r"common public attribution licen[sc]e", ["1.0"], r"opensource\.org/licenses?/cpal"),
    ("osl", "osl", "open", r"open software licen[sc]e", ["1.0", "2.0", "2.1", "3.0"], r"opensource\.org/licenses?/osl"),
    ("afl", "afl", "academic", r"academic free licen[sc]e", ["1.1", "1.2", "2.0", "2.1", "3.0"], r"opensource\.org/licenses?/afl"),
    ("artistic", "artistic", "artistic", r"artistic licen[sc]e", ["1.0", "2.0", "1", "2"], r"opensource\.org/licenses?/artistic"),
    ("bsl", "bsl", "boost", r"boost software licen[sc]e", ["1.0"], r"boost\.org/license_1_0"),
    ("busl", "busl", "business", r"business source licen[sc]e", ["1.0", "1.1"], r"mariadb\.com/bsl"),
    ("sspl", "sspl", "server", r"server side public licen[sc]e", ["1", "1.0"], r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic", "elastic", "elastic", r"elastic licen[sc]e", ["1.0", "2.0"], r"elastic\.co/licensing/elastic-license"),
    ("zlib", "zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", [], r"opensource\.org/licenses?/zlib"),
    ("libpng", "libpng", "libpng", r"libpng licen[sc]e", ["2.0", "2"], r"libpng\.org/pub/png/src/libpng-license"),
    ("unlicense", "unlicense", "unlicen", r"the unlicen[sc]e", [], r"unlicense\.org"),
    ("wtfpl", "wtfpl", "fuck", r"do what the fuck you want to public licen[sc]e", [], r"wtfpl\.net"),
    ("python", "python", "python", r"python(?: software foundation)? licen[sc]e", ["2.0", "2"], r"python\.org/.{0,20}license"),
    ("php", "php", "php", r"php licen[sc]e", ["3.0", "3.01"], r"php\.net/license"),
    ("ruby", "ruby", "ruby", r"ruby licen[sc]e", [], r"ruby-lang\.org/.{0,20}license"),
    ("postgresql", "postgresql", "postgresql", r"postgresql licen[sc]e", [], r"opensource\.org/licenses?/postgresql"),
    ("openssl", "openssl", "openssl", r"openssl licen[sc]e", [], r"openssl\.org/source/license"),
    ("ofl", "ofl", "font", r"(?:sil )?open font licen[sc]e", ["1.0", "1.1"], r"scripts\.sil\.org/ofl"),
    ("ms-pl", "ms-pl", "microsoft", r"microsoft public licen[sc]e", [], r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", "ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", [], r"opensource\.org/licenses?/ms-rl"),
    ("apsl", "apsl", "apple", r"apple public source licen[sc]e", ["1.0", "1.1", "1.2", "2.0"], r"opensource\.apple\.com/license/apsl"),
    ("ecl", "ecl", "educational", r"educational community licen[sc]e", ["1.0", "2.0"], r"opensource\.org/licenses?/ecl"),
    ("upl", "upl", "universal", r"universal permissive licen[sc]e", ["1.0"], r"opensource\.org/licenses?/upl"),
    ("ncsa", "ncsa", "ncsa|illinois", r"(?:university of illinois/)?(?:ncsa|illinois) open source licen[sc]e", [], r"opensource\.org/licenses?/ncsa"),
    ("ipl", "ipl", "ibm", r"ibm public licen[sc]e", ["1.0"], r"opensource\.org/licenses?/ipl"),
    ("qpl", "qpl", "public licen", r"q public licen[sc]e", ["1.0"], r"opensource\.org/licenses?/qpl"),
    ("sleepycat", "sleepycat", "sleepycat", r"sleepycat licen[sc]e", [], r"opensource\.org/licenses?/sleepycat"),
    ("vim", "vim", "vim", r"vim licen[sc]e", [], r"vimdoc\.sourceforge\.net/.{0,40}license"),
    ("x11", "x11", "x11", r"x11 licen[sc]e", [], r"xfree86\.org/.{0,40}license"),
    ("w3c", "w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[sc]e", [], r"w3\.org/consortium/legal"),
    ("odbl", "odbl", "database", r"open database licen[sc]e", ["1.0"], r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "odc-by", "attribution", r"open data commons attribution licen[sc]e", ["1.0"], r"opendatacommons\.org/licenses/by"),
    ("pddl", "pddl", "public domain", r"public domain dedication and licen[sc]e", ["1.0"], r"opendatacommons\.org/licenses/pddl"),
    ("cecill", "cecill", "cecill", r"cecill(?:-[bc])?(?: free software)? licen[sc]e", ["1.0", "1.1", "2.0", "2.1"], r"cecill\.info/licen"),
    ("openrail", "openrail", "rail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?:\+\+)?(?:-[ms])?(?: licen[sc]e)?", [], r"huggingface\.co/spaces/.{0,40}license"),
    ("ogl", "ogl", "government", r"open government licen[sc]e", ["1.0", "2.0", "3.0"], r"nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("mulanpsl", "mulanpsl", "mulan", r"mulan permissive software licen[sc]e", ["1", "2"], r"license\.coscl\.org\.cn/mulanpsl"),
    ("ncgl", "ncgl", "non-commercial", r"non-commercial government licen[sc]e", [], r"nationalarchives\.gov\.uk/doc/non-commercial-government-licence"),
    ("zpl", "zpl", "zope", r"zope public licen[sc]e", ["1.1", "2.0", "2.1"], r"opensource\.org/licenses?/zpl"),
    ("lppl", "lppl", "latex", r"latex project public licen[sc]e", ["1.0", "1.1", "1.2", "1.3c"], r"latex-project\.org/lppl"),
    ("naist", "naist-2003", "naist", r"naist licen[sc]e", [], r"spdx\.org/licenses/naist-2003"),
    ("blueoak", "blueoak", "blue oak", r"blue oak model licen[sc]e", ["1.0.0"], r"blueoakcouncil\.org/license"),
    ("parity", "parity", "parity", r"parity public licen[sc]e", ["6.0.0", "7.0.0"], r"paritylicense\.com"),
    ("polyform", "polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|free trial)(?: licen[sc]e)?", ["1.0.0"], r"polyformproject\.org/licenses"),
    ("commons-clause", "commons-clause", "commons clause", r"commons clause(?: licen[sc]e)?(?: condition)?", ["1.0"], r"commonsclause\.com"),
]

#: label, parts of a Creative Commons licence as written out, as letters
_CREATIVE = [
    ("cc-by-nc-nd", r"attribution[- ]non-?commercial[- ]no ?derivati?ve?s?", "by-nc-nd"),
    ("cc-by-nc-sa", r"attribution[- ]non-?commercial[- ]share ?alike", "by-nc-sa"),
    ("cc-by-nc", r"attribution[- ]non-?commercial", "by-nc"),
    ("cc-by-nd", r"attribution[- ]no ?derivati?ve?s?", "by-nd"),
    ("cc-by-sa", r"attribution[- ]share ?alike", "by-sa"),
    ("cc-by", r"attribution", "by"),
]

#: label, keyword, sentence of the licence text or of its usual notice
_GRANTS = [
    ("mit", "permission hereby documentation", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "merchantability", r"the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("isc", "permission distribute purpose", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("bsd-3-clause", "endorse promote", r"neither the names? of [\s\S]{1,200}? may be used to endorse or promote products derived from"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache", "apache", r"licensed under the apache licen[sc]e, version 2\.0"),
    ("apache", "apache compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache", "conditions reproduction", r"terms and conditions for use, reproduction, and distribution"),
    ("gpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gpl", "gnu option", r"either version [123] of the licen[sc]e, or \(at your option\) any later version"),
    ("gfdl", "permission gnu", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("bsl", "permission hereby organization", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("cc0", "waive", r"waive[sd]? all (?:of (?:his|her|their) )?(?:copyright and related|rights to the work)"),
    ("wtfpl", "everyone permitted", r"everyone is permitted to copy and distribute verbatim or modified copies"),
    ("epl", "accompanying", r"the accompanying program is provided under the terms of this (?:eclipse|common) public licen[sc]e"),
    ("ofl", "font software", r"permission is hereby granted, free of charge, to any person obtaining a copy of the font software"),
    ("artistic", "package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("postgresql", "permission distribute documentation", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee"),
    ("elastic", "hosted managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("busl", "additional grant", r"additional use grant"),
    ("all-rights-reserved", "rights reserved", r"all rights reserved"),
    ("proprietary", "confidential proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|use|distribution) [\s\S]{1,80}? is (?:strictly )?prohibited"),
]


def rules() -> list[tuple[str, int, str, str]]:
    """All rules, in order of rank and of the lists above."""
    out = []
    for label, keyword, sentence in _GRANTS:
        out.append((label, GRANT, keyword, sentence))
    for label, stem, keyword, title, versions, link in _FAMILIES:
        spdx = stem.replace("-", r"-").replace(".", r"\.")
        out.append((label, TAG, "spdx-license-identifier", rf"{_TAGGED}{spdx}(?:-[0-9][0-9.]*)?(?:-only|-or-later|\+)?)(?![\w-])"))
        for v in versions:
            number = v.replace(".", r"\.")
            out.append((f"{label}-{v}", VERSION, keyword, rf"\b{title},? ?\(?(?:v|ver\.?|version)? ?{number}(?![\w]|\.[0-9])"))
        out.append((label, TITLE, keyword, rf"\b{title}(?!\w)"))
        out.append((label, MENTION, "licen", rf"\blicen[sc]ed? (?:under|with|by) (?:the )?(?:terms of )?(?:the )?{spdx}(?![\w-])"))
        out.append((label, LINK, link.split(r"\.")[0].split("(")[0].split("?")[0], link))
    for label, words, letters in _CREATIVE:
        out.append((label, TAG, "spdx-license-identifier", rf"{_TAGGED}cc-{letters}(?:-[0-9.]+)?)(?![\w-])"))
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = v.replace(".", r"\.")
            out.append((f"{label}-{v}", VERSION, "cc", rf"\bcc[- ]{letters}[- ]{number}(?![\w]|\.[0-9])"))
            out.append((f"{label}-{v}", VERSION, "commons", rf"\bcreative commons {words} {number}(?![\w]|\.[0-9])"))
        out.append((label, TITLE, "cc", rf"\bcc[- ]{letters}(?![\w])"))
        out.append((label, TITLE, "commons", rf"\bcreative commons {words}(?!\w)"))
        out.append((label, LINK, "creativecommons", rf"creativecommons\.org/licenses/{letters}/"))
    out.append(("cc0", TITLE, "cc0", r"\bcc0(?:[- ]1\.0)?(?:[- ]universal)?(?!\w)"))
    out.append(("cc0", LINK, "creativecommons", r"creativecommons\.org/publicdomain/zero"))
    out.append(("cc", MENTION, "commons", r"\bcreative commons licen[sc]e"))
    return sorted(out, key=lambda rule: rule[1])
