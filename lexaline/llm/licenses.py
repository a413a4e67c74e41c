"""License scan with ordered signature rules, in DataFrame functions only.

A text becomes its lower-case words with one space between them. Each rule is a regular expression over these words with
a keyword that must occur before the expression is tried, a priority (1 is strongest) and a weight. The first word of the
keyword is a word of every match, so one look at a text's words tells which rules can be left out. Rules are ordered by
priority and then as written. A detection that lies inside one of the same or a stronger priority is suppressed; of
equal intervals and priorities that of the first rule stays. Of what stays, the labels are reported.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaline.llm.expressions import ascii_lower, let, matches

#: What stands between words once A-Z is in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count as places, with their labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Names of licenses as words, the keyword each needs, and their label.
_NAMES = (
    ("apache", "apache", "apache"),
    ("mit", "mit", "mit"),
    ("expat", "expat", "mit"),
    ("bsd", "bsd", "bsd"),
    ("isc", "isc", "isc"),
    ("gnu general public", "general public", "gpl"),
    ("gpl", "gpl", "gpl"),
    ("gnu lesser general public", "lesser", "lgpl"),
    ("gnu library general public", "library", "lgpl"),
    ("lgpl", "lgpl", "lgpl"),
    ("gnu affero general public", "affero", "agpl"),
    ("agpl", "agpl", "agpl"),
    ("gnu free documentation", "documentation", "gfdl"),
    ("gfdl", "gfdl", "gfdl"),
    ("mozilla public", "mozilla", "mpl"),
    ("mpl", "mpl", "mpl"),
    ("eclipse public", "eclipse", "epl"),
    ("epl", "epl", "epl"),
    ("common development and distribution", "distribution", "cddl"),
    ("cddl", "cddl", "cddl"),
    ("european union public", "european", "eupl"),
    ("eupl", "eupl", "eupl"),
    ("artistic", "artistic", "artistic"),
    ("boost software", "boost", "bsl"),
    ("bsl", "bsl", "bsl"),
    ("zlib", "zlib", "zlib"),
    ("unlicense", "unlicense", "unlicense"),
    ("python software foundation", "python", "psf"),
    ("open software", "open software", "osl"),
    ("academic free", "academic", "afl"),
    ("microsoft public", "microsoft", "ms-pl"),
    ("do what the fuck you want to public", "want to public", "wtfpl"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("open database", "open database", "odbl"),
    ("odbl", "odbl", "odbl"),
    ("creative commons attribution", "creative commons", "cc-by"),
    ("creative commons attribution share ?alike", "creative commons", "cc-by-sa"),
    ("creative commons attribution non ?commercial", "creative commons", "cc-by-nc"),
    ("creative commons attribution no ?deriv(?:ative)?s", "creative commons", "cc-by-nd"),
    ("creative commons attribution non ?commercial share ?alike", "creative commons", "cc-by-nc-sa"),
    ("creative commons zero", "creative commons", "cc0"),
    ("cc0", "cc0", "cc0"),
    ("cc by", "cc by", "cc-by"),
    ("cc by sa", "cc by", "cc-by-sa"),
    ("cc by nc", "cc by", "cc-by-nc"),
    ("cc by nd", "cc by", "cc-by-nd"),
    ("cc by nc sa", "cc by", "cc-by-nc-sa"),
    ("cc by nc nd", "cc by", "cc-by-nc-nd"),
)

_VERSION = r"(?:(?: version| v| ver)? v?[0-9]+(?: [0-9]+)*(?: or later| or any later version| only)?)?"
#: Wordings around a name: pattern with {n} for the name and {v} for a version, what every match has beside the name,
#: priority, weight.
_FORMS = (
    (r"spdx license identifier {n}{v}", "spdx license identifier ", 1, 1.0),
    (r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of |terms and conditions of )?(?:the |a )?{n}(?: licen[sc]e)?{v}", " under ", 1, 1.0),
    (r"under (?:the )?terms of (?:the )?{n}(?: licen[sc]e)?{v}", "terms of ", 1, 0.95),
    (r"licen[sc]e {n}{v}", " licen", 2, 0.8),
    (r"{n} licen[sc]e{v}", " licen", 2, 0.9),
    (r"{n}(?:(?: version| v| ver) v?[0-9]+(?: [0-9]+)*| [0-9]+ [0-9]+(?: [0-9]+)?)", "", 3, 0.6),
)
#: Sentences and short forms of single licenses: pattern, keyword, label, priority, weight.
_NOTICES = (
    # notices of permission and whole license texts
    (r"licen[sc]ed under the apache licen[sc]e(?: version)? 2 0(?: the licen[sc]e)?", "apache", "apache", 1, 1.0),
    (r"you may not use this file except in compliance with the licen[sc]e", "except in compliance", "apache", 1, 0.9),
    (r"unless required by applicable law or agreed to in writing", "agreed to in writing", "apache", 1, 0.9),
    (r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", "mit", 1, 1.0),
    (r"the above copyright notice and this permission notice shall be included in all copies", "this permission notice shall", "mit", 1, 1.0),
    (r"the software is provided as is without warranty of any kind", "without warranty of any kind", "mit", 1, 0.8),
    (r"the software shall be used for good not evil", "for good not evil", "json", 1, 1.0),
    (r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", "bsd", 1, 1.0),
    (r"redistributions of source code must retain the above copyright notice", "redistributions of source", "bsd", 1, 0.95),
    (r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary", "bsd", 1, 0.95),
    (r"neither the name of [^ ]+(?: [^ ]+){{0,8}} nor the names of its contributors may be used", "nor the names of", "bsd", 1, 0.95),
    (r"all advertising materials mentioning features or use of this software", "advertising materials mentioning", "bsd-advertising", 1, 1.0),
    (r"this software is provided by the (?:copyright holders|regents|author)(?: and contributors)? as is", "this software is provided by", "bsd", 1, 0.9),
    (r"permission to use copy modify and or distribute this software for any purpose", "permission to use copy", "isc", 1, 1.0),
    (r"permission to use copy modify and distribute this software and its documentation for any purpose", "permission to use copy", "hpnd", 1, 1.0),
    (r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "authors be held liable", "zlib", 1, 1.0),
    (r"altered source versions must be plainly marked as such", "plainly marked as such", "zlib", 1, 1.0),
    (r"this is free and unencumbered software released into the public domain", "unencumbered", "unlicense", 1, 1.0),
    (r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy", "unlicense", 1, 0.95),
    (r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", "this program is free software", "gpl", 1, 1.0),
    (r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", "this library is free software", "lgpl", 1, 1.0),
    (r"you should have received a copy of the gnu general public licen[sc]e", "you should have received", "gpl", 1, 1.0),
    (r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", "you should have received", "lgpl", 1, 1.0),
    (r"you should have received a copy of the gnu affero general public licen[sc]e", "you should have received", "agpl", 1, 1.0),
    (r"either version [0-9]+ of the licen[sc]e or at your option any later version", "at your option any later", "gpl", 2, 0.7),
    (r"without even the implied warranty of merchantability or fitness for a particular purpose", "without even the implied", "gpl", 2, 0.7),
    (r"this source code form is subject to the terms of the mozilla public licen[sc]e", "subject to the terms", "mpl", 1, 1.0),
    (r"if a copy of the mpl was not distributed with this file", "copy of the mpl", "mpl", 1, 1.0),
    (r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "accompanying materials", "epl", 1, 1.0),
    (r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "common development", "cddl", 1, 1.0),
    (r"this package is free software you can redistribute it and or modify it under the same terms as perl", "same terms as perl", "artistic", 1, 1.0),
    (r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", "modify this document", "gfdl", 1, 1.0),
    (r"permission is hereby granted to use reproduce prepare derivative works of", "prepare derivative works", "bsl", 1, 0.9),
    (r"as long as you retain this notice you can do whatever you want with this stuff", "retain this notice", "beerware", 1, 1.0),
    (r"do what the fuck you want to public licen[sc]e", "want to public", "wtfpl", 1, 1.0),
    (r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "without royalty", "fsfap", 1, 1.0),
    (r"this font software is licen[sc]ed under the sil open font licen[sc]e", "font software", "ofl", 1, 1.0),
    (r"this product includes software developed by the openssl project", "openssl project", "openssl", 1, 1.0),
    (r"this product includes php software", "php software", "php", 1, 1.0),
    (r"this software and or documentation is based in part on the work of the independent jpeg group", "independent jpeg group", "ijg", 1, 1.0),
    (r"this file is part of the freetype project", "freetype project", "ftl", 1, 1.0),
    (r"unicode data files and software", "unicode data files", "unicode", 1, 0.9),
    (r"the commons clause licen[sc]e condition", "commons clause", "commons-clause", 1, 1.0),
    (r"the person who associated a work with this deed has dedicated the work to the public domain", "with this deed", "cc0", 1, 1.0),
    (r"to the extent possible under law the (?:author|person)(?: s)? (?:have|has|who)", "extent possible under law", "cc0", 1, 0.95),
    (r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", "public domain", "public-domain", 1, 0.95),
    # addresses
    (r"opensource org licenses mit(?: license(?: php)?)?", "opensource org", "mit", 1, 1.0),
    (r"opensource org licenses bsd [23] clause", "opensource org", "bsd", 1, 1.0),
    (r"opensource org licenses apache 2 0", "opensource org", "apache", 1, 1.0),
    (r"opensource org licenses isc", "opensource org", "isc", 1, 1.0),
    (r"apache org licenses licen[sc]e 2 0", "apache org licenses", "apache", 1, 1.0),
    (r"gnu org (?:licenses|copyleft) gpl", "gnu org", "gpl", 1, 1.0),
    (r"gnu org (?:licenses|copyleft) lgpl", "gnu org", "lgpl", 1, 1.0),
    (r"gnu org licenses agpl", "gnu org", "agpl", 1, 1.0),
    (r"gnu org (?:licenses|copyleft) fdl", "gnu org", "gfdl", 1, 1.0),
    (r"mozilla org mpl(?: 2 0)?", "mozilla org", "mpl", 1, 1.0),
    (r"eclipse org legal epl", "eclipse org", "epl", 1, 1.0),
    (r"boost org licen[sc]e 1 0", "boost org", "bsl", 1, 1.0),
    (r"unlicense org", "unlicense org", "unlicense", 1, 1.0),
    (r"wtfpl net", "wtfpl net", "wtfpl", 1, 1.0),
    (r"scripts sil org ofl", "scripts sil", "ofl", 1, 1.0),
    (r"creativecommons org publicdomain zero 1 0", "creativecommons org", "cc0", 1, 1.0),
    (r"creativecommons org publicdomain mark 1 0", "creativecommons org", "public-domain", 1, 1.0),
    (r"creativecommons org licenses by(?: [0-9] [0-9])?", "creativecommons org", "cc-by", 1, 1.0),
    (r"creativecommons org licenses by sa(?: [0-9] [0-9])?", "creativecommons org", "cc-by-sa", 1, 1.0),
    (r"creativecommons org licenses by nc(?: [0-9] [0-9])?", "creativecommons org", "cc-by-nc", 1, 1.0),
    (r"creativecommons org licenses by nd(?: [0-9] [0-9])?", "creativecommons org", "cc-by-nd", 1, 1.0),
    (r"creativecommons org licenses by nc sa(?: [0-9] [0-9])?", "creativecommons org", "cc-by-nc-sa", 1, 1.0),
    (r"creativecommons org licenses by nc nd(?: [0-9] [0-9])?", "creativecommons org", "cc-by-nc-nd", 1, 1.0),
    # short identifiers and names that only one license has
    (r"gpl [123] 0 (?:only|or later)", "gpl", "gpl", 2, 0.95),
    (r"lgpl (?:2 [01]|3 0) (?:only|or later)", "lgpl", "lgpl", 2, 0.95),
    (r"agpl [13] 0 (?:only|or later)", "agpl", "agpl", 2, 0.95),
    (r"bsd [0234] clause(?: licen[sc]e)?", "clause", "bsd", 2, 0.9),
    (r"(?:new|modified|simplified|revised) bsd licen[sc]e", "bsd licen", "bsd", 2, 0.9),
    (r"mit 0", "mit 0", "mit-0", 3, 0.7),
    (r"mit x11(?: licen[sc]e)?", "mit x11", "mit", 2, 0.9),
    (r"x11 licen[sc]e", "x11 licen", "x11", 2, 0.9),
    (r"gpl v ?[123]", "gpl v", "gpl", 3, 0.8),
    (r"gplv2(?: or later)?", "gplv2", "gpl", 3, 0.8),
    (r"gplv3(?: or later)?", "gplv3", "gpl", 3, 0.8),
    (r"lgplv2(?: or later)?", "lgplv2", "lgpl", 3, 0.8),
    (r"lgplv3(?: or later)?", "lgplv3", "lgpl", 3, 0.8),
    (r"agplv3", "agplv3", "agpl", 3, 0.8),
    (r"dual licen[sc]ed under (?:the )?mit and gpl(?: licenses)?", "dual licen", "gpl", 1, 0.9),
    (r"dual licen[sc]ed under (?:the )?(?:apache|mit)(?: 2 0)? (?:or|and) (?:apache|mit)(?: 2 0)?", "dual licen", "mit", 1, 0.9),
    (r"sil open font licen[sc]e(?: version)?(?: 1 [01])?", "sil open font", "ofl", 2, 0.95),
    (r"ofl 1 [01]", "ofl 1", "ofl", 2, 0.8),
    (r"business source licen[sc]e(?: 1 1)?", "business source", "busl", 2, 0.9),
    (r"server side public licen[sc]e", "server side public", "sspl", 2, 0.95),
    (r"elastic licen[sc]e(?: 2 0)?", "elastic licen", "elastic", 2, 0.9),
    (r"polyform (?:noncommercial|small business|shield|strict)(?: licen[sc]e)?", "polyform", "polyform", 2, 0.9),
    (r"postgresql licen[sc]e", "postgresql licen", "postgresql", 2, 0.9),
    (r"openssl licen[sc]e", "openssl licen", "openssl", 2, 0.9),
    (r"php licen[sc]e(?: version)?(?: 3 0[01]?)?", "php licen", "php", 2, 0.9),
    (r"ruby licen[sc]e", "ruby licen", "ruby", 2, 0.8),
    (r"vim licen[sc]e", "vim licen", "vim", 2, 0.9),
    (r"curl licen[sc]e", "curl licen", "curl", 2, 0.8),
    (r"libpng licen[sc]e", "libpng licen", "libpng", 2, 0.9),
    (r"w3c software (?:notice and )?licen[sc]e", "w3c software", "w3c", 2, 0.95),
    (r"university of illinois (?:ncsa )?open source licen[sc]e", "university of illinois", "ncsa", 2, 0.95),
    (r"nasa open source agreement", "nasa open source", "nasa", 2, 0.95),
    (r"intel open source licen[sc]e", "intel open source", "intel", 2, 0.9),
    (r"sun public licen[sc]e", "sun public", "spl", 2, 0.9),
    (r"ibm public licen[sc]e", "ibm public", "ipl", 2, 0.95),
    (r"common public licen[sc]e", "common public licen", "cpl", 2, 0.9),
    (r"common public attribution licen[sc]e", "common public attribution", "cpal", 2, 0.95),
    (r"q public licen[sc]e", "q public", "qpl", 2, 0.95),
    (r"cecill(?: [bc])?", "cecill", "cecill", 2, 0.8),
    (r"open data commons(?: attribution| open database)? licen[sc]e", "open data commons", "odc", 2, 0.9),
    (r"open government licen[sc]e(?: v?[0-9](?: 0)?)?", "open government", "ogl", 2, 0.9),
    (r"openrail(?: [ms])?", "openrail", "openrail", 2, 0.8),
    (r"llama [0-9](?: [0-9])? community licen[sc]e", "community licen", "llama", 2, 0.9),
    (r"beerware(?: licen[sc]e)?", "beerware", "beerware", 2, 0.9),
    # other statements about rights
    (r"all rights reserved", "rights reserved", "reserved", 2, 0.7),
    (r"no rights reserved", "rights reserved", "public-domain", 2, 0.8),
    (r"some rights reserved", "rights reserved", "some-reserved", 2, 0.6),
    (r"public domain", "public domain", "public-domain", 3, 0.5),
    (r"copyright (?:c )?[0-9]{{4}}(?: [0-9]{{4}})*", "copyright", "copyright", 3, 0.5),
    (r"general public license", "general public license", "gpl", 3, 0.8),
    (r"confidential and proprietary", "proprietary", "proprietary", 2, 0.7),
    (r"proprietary and confidential", "proprietary", "proprietary", 2, 0.7),
    (r"unauthori[sz]ed (?:copying|reproduction|distribution)(?: of this [^ ]+)?(?: via any medium)? is (?:strictly )?prohibited", "prohibited", "proprietary", 1, 0.9),
    (r"no part of this (?:publication|book|work|document) may be reproduced", "may be reproduced", "reserved", 1, 0.9),
    (r"without (?:the )?(?:prior )?written permission of the (?:publisher|author|owner|copyright holder)", "written permission", "reserved", 2, 0.8),
    (r"(?:reprinted|reproduced|used) (?:with|by) permission", "permission", "by-permission", 2, 0.7),
    (r"for (?:personal|educational|academic|research|internal|non ?commercial) use only", "use only", "restricted-use", 2, 0.8),
    (r"not for (?:commercial use|resale|redistribution|distribution)", "not for", "restricted-use", 2, 0.75),
    (r"free for (?:personal|non ?commercial|educational) use", "free for", "restricted-use", 2, 0.75),
    (r"royalty free", "royalty free", "royalty-free", 3, 0.4),
    (r"open access article distributed under", "open access article", "open-access", 2, 0.8),
    (r"licen[sc]ed under the", "under the", "unknown-license", 3, 0.3),
)


def rules() -> list[dict]:
    """All rules in their order: by priority and then as written, single sentences before forms with a name."""
    found = []
    for pattern, keyword, label, priority, weight in _NOTICES:
        found.append({"label": label, "priority": priority, "weight": weight, "keyword": keyword, "beside": "", "regex": pattern.format()})
    for pattern, beside, priority, weight in _FORMS:
        for name, keyword, label in _NAMES:
            found.append({"label": label, "priority": priority, "weight": weight, "keyword": keyword, "beside": beside, "regex": pattern.format(n=name, v=_VERSION)})
    found.sort(key=lambda r: r["priority"])
    for nth, rule in enumerate(found):
        rule |= {"nth": nth, "word": rule["keyword"].split(" ")[0], "regex": f"(?<= ){rule['regex']}(?= )"}
    return found


#: One of these must be a word of a text before any rule is tried in it: the first word of every rule's keyword.
GATE = tuple(sorted({rule["word"] for rule in rules()}))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def words_text(text: Column) -> Column:
    """The words in lower case, a space before, between and after them; one space for a text without words."""
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SEPARATORS), F.lit(" ")))
    return F.when(plain == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def _key_words(words: Column) -> Column:
    """Those of GATE that are words of the text."""
    return F.array_intersect(F.split(words, " ", -1), F.array(*[F.lit(w) for w in GATE]))


def _detections(words: Column, key_words: Column) -> Column:
    """Structs (start, -stop, priority, nth, weight, label) of all rules' matches, containing intervals first."""
    schema = "array<struct<label:string,priority:int,nth:int,weight:double,word:string,keyword:string,beside:string,regex:string>>"
    table = F.from_json(F.lit(json.dumps(rules())), schema)
    usable = F.filter(table, lambda r: F.array_contains(key_words, r["word"]) & F.contains(words, r["keyword"]) & F.contains(words, r["beside"]))
    found = F.flatten(F.transform(usable, lambda r: F.transform(matches(words, r["regex"]), lambda m: F.struct(m["start"].alias("start"), (-m["stop"]).alias("back"), r["priority"].alias("priority"), r["nth"].alias("nth"), r["weight"].alias("weight"), r["label"].alias("label")))))
    return F.array_sort(found)


def _resolved(detections: Column) -> Column:
    """Struct (labels, weight, n) of the detections that stay."""
    start = F.struct(F.lit(0).alias("e1"), F.lit(0).alias("e2"), F.lit(0).alias("e3"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"), F.lit(0).alias("n"))

    def step(acc: Column, d: Column) -> Column:
        stop = -d["back"]
        reach = F.when(d["priority"] == 1, acc["e1"]).when(d["priority"] == 2, acc["e2"]).otherwise(acc["e3"])
        stays = stop > reach
        grown = [F.when(stays & (d["priority"] <= p), F.greatest(acc[f"e{p}"], stop)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in (1, 2, 3)]
        return F.struct(*grown, F.when(stays, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"), F.when(stays, F.greatest(acc["weight"], d["weight"])).otherwise(acc["weight"]).alias("weight"), F.when(stays, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

    return F.aggregate(detections, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["weight"].alias("weight"), acc["n"].alias("n")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections), one for each row of ``docs``.

    Null and empty texts, and texts without words, have no words, no places, empty labels and score 0. Repeated rows
    and null ids come back as they are; other columns are ignored. No row leaves its task: there is no shuffle.
    """

    # each step names what it reads more than once, which keeps it from being computed twice
    worded = docs.select(F.col(id_col).alias("_id"), words_text(F.col(text_col)).alias("w"))
    words = F.col("w")
    none = F.array().cast("array<string>")
    pieces = [F.when(F.contains(words, F.lit(f" {phrase} ")), F.split(words, f"(?<= ){phrase}(?= )", -1)).otherwise(none).alias(f"s{i}") for i, (phrase, _) in enumerate(BASE)]
    nothing = F.struct(none.alias("labels"), F.lit(0.0).alias("weight"), F.lit(0).alias("n"))
    found = let(_key_words(words), lambda keys: F.when(F.size(keys) > 0, _resolved(_detections(words, keys))).otherwise(nothing))
    looked = worded.select("_id", (_spaces(words) - 1).cast("long").alias("n_words"), *pieces, found.alias("found"))

    n = [F.greatest(F.size(f"s{i}") - 1, F.lit(0)).cast("long") for i in range(len(BASE))]
    first = [_spaces(F.get(f"s{i}", F.lit(0))) - 1 for i in range(len(BASE))]
    # the spaces before the last place, and those inside the places before it
    last = [F.when(n[i] > 0, F.aggregate(F.transform(F.slice(f"s{i}", 1, n[i].cast("int")), _spaces), F.lit(0), lambda acc, x: acc + x) + (n[i] - 1) * phrase.count(" ") - 1) for i, (phrase, _) in enumerate(BASE)]
    base = F.array_compact(F.array(*[F.when(x > 0, F.lit(label)) for x, (_, label) in zip(n, BASE)]))
    n_base = n[0]
    for x in n[1:]:
        n_base = n_base + x
    return looked.select(
        F.col("_id").alias(id_col),
        "n_words",
        n_base.alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("found.labels"))), ",").alias("labels"),
        F.greatest(F.col("found.weight"), F.when(n_base > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
        F.col("found.n").cast("long").alias("n_detections"),
    )
