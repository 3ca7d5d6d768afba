"""License scans by ordered signature rules, in DataFrame functions alone.

A text is folded (A-Z to a-z) and cut into words. Rules are regexes over the
words joined by single spaces: hand-written signatures of license bodies, file
headers and joined forms, and families of hand-written name patterns in the forms
a license is stated in (SPDX tag, address, notice, title with version, name). A
rule is tried only where all its keywords are among the text's words. Of overlapping detections one that lies within another of the same or a
higher priority is suppressed (equal intervals: the rule earlier in order stays).
Everything happens within a document's row: no shuffle, no Python.

Defined results: a null or wordless text has no words, places or labels and
score 0; a phrase's places may overlap. Columns of docs with a result's name are
replaced; others stay, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import table

# Phrases whose consecutive words are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
VERSION = r"(?:version |v |v|ver )?"

# family label: keyword, name pattern, versions (pattern: label suffix), SPDX words, address words
FAMILIES = {
    "agpl": ("affero", r"(?:gnu )?affero (?:general public license|gpl)", {"3(?: 0)?": "3.0", "1(?: 0)?": "1.0"}, "agpl", "www gnu org licenses agpl"),
    "agpl-short": ("agpl", r"(?:gnu )?agpl", {"v?3(?: 0)?": "3.0"}, "agpl", ""),
    "lgpl": ("lesser", r"(?:gnu )?(?:lesser|library) general public license", {"3(?: 0)?": "3.0", "2 1": "2.1", "2(?: 0)?": "2.0"}, "lgpl", "www gnu org licenses lgpl"),
    "lgpl-short": ("lgpl", r"(?:gnu )?lgpl", {"v?3(?: 0)?": "3.0", "v?2 1": "2.1", "v?2(?: 0)?": "2.0"}, "lgpl", ""),
    "gpl": ("gnu", r"gnu (?:general public license|gpl)", {"3(?: 0)?": "3.0", "2(?: 0)?": "2.0", "1(?: 0)?": "1.0"}, "gpl", "www gnu org licenses gpl"),
    "gpl-short": ("gpl", r"gpl", {"v?3(?: 0)?": "3.0", "v?2(?: 0)?": "2.0"}, "gpl", ""),
    "gfdl": ("documentation", r"(?:gnu )?free documentation license", {"1 3": "1.3", "1 2": "1.2", "1 1": "1.1"}, "gfdl", "www gnu org licenses fdl"),
    "apache": ("apache", r"apache (?:software )?license", {"2(?: 0)?": "2.0", "1 1": "1.1", "1 0": "1.0"}, "apache", "www apache org licenses license"),
    "mit": ("mit", r"(?:the )?mit(?: x11)? license", {}, "mit", "opensource org licenses mit"),
    "expat": ("expat", r"expat license", {}, "mit", ""),
    "bsd-2-clause": ("bsd", r"(?:simplified bsd|freebsd|2 clause bsd|two clause bsd|bsd 2 clause) license", {}, "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    "bsd-3-clause": ("bsd", r"(?:new bsd|modified bsd|3 clause bsd|three clause bsd|bsd 3 clause) license", {}, "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    "bsd-4-clause": ("bsd", r"(?:original bsd|4 clause bsd|four clause bsd|bsd 4 clause) license", {}, "bsd 4 clause", ""),
    "bsd": ("bsd", r"bsd(?: style)? license", {}, "0bsd", ""),
    "isc": ("isc", r"isc license", {}, "isc", "opensource org licenses isc"),
    "mpl": ("mozilla", r"mozilla public license", {"2(?: 0)?": "2.0", "1 1": "1.1", "1 0": "1.0"}, "mpl", "mozilla org mpl"),
    "epl": ("eclipse", r"eclipse public license", {"2(?: 0)?": "2.0", "1(?: 0)?": "1.0"}, "epl", "www eclipse org legal epl"),
    "edl": ("eclipse", r"eclipse distribution license", {"1(?: 0)?": "1.0"}, "edl", "www eclipse org org documents edl"),
    "cddl": ("cddl", r"(?:common development and distribution license|cddl)", {"1 1": "1.1", "1(?: 0)?": "1.0"}, "cddl", ""),
    "cpl": ("common", r"common public license", {"1(?: 0)?": "1.0"}, "cpl", ""),
    "eupl": ("european", r"european union public licen[cs]e", {"1 2": "1.2", "1 1": "1.1"}, "eupl", ""),
    "artistic": ("artistic", r"(?:perl )?artistic license", {"2(?: 0)?": "2.0", "1(?: 0)?": "1.0"}, "artistic", ""),
    "boost": ("boost", r"boost software license", {"1(?: 0)?": "1.0"}, "bsl", "www boost org license"),
    "zlib": ("zlib", r"zlib(?: libpng)? license", {}, "zlib", ""),
    "unlicense": ("unlicense", r"(?:the )?unlicense", {}, "unlicense", "unlicense org"),
    "wtfpl": ("wtfpl", r"(?:do what the fuck you want to public license|wtfpl)", {"2(?: 0)?": "2.0"}, "wtfpl", ""),
    "python": ("python", r"python software foundation license", {"2(?: 0)?": "2.0"}, "psf", "docs python org license"),
    "postgresql": ("postgresql", r"postgresql license", {}, "postgresql", ""),
    "ofl": ("font", r"(?:sil )?open font license", {"1 1": "1.1", "1 0": "1.0"}, "ofl", "scripts sil org ofl"),
    "odbl": ("database", r"open (?:data commons open )?database license", {"1(?: 0)?": "1.0"}, "odbl", "opendatacommons org licenses odbl"),
    "ms-pl": ("microsoft", r"microsoft public license", {}, "ms pl", ""),
    "ms-rl": ("microsoft", r"microsoft reciprocal license", {}, "ms rl", ""),
    "afl": ("academic", r"academic free license", {"3(?: 0)?": "3.0", "2 1": "2.1"}, "afl", ""),
    "osl": ("open", r"open software license", {"3(?: 0)?": "3.0", "2 1": "2.1"}, "osl", ""),
    "cecill": ("cecill", r"cecill(?: free software)? license", {"2 1": "2.1", "2(?: 0)?": "2.0"}, "cecill", ""),
    "elastic": ("elastic", r"elastic license", {"2(?: 0)?": "2.0"}, "elastic", ""),
    "busl": ("business", r"business source license", {"1 1": "1.1"}, "busl", ""),
    "sspl": ("server", r"server side public license", {"1(?: 0)?": "1.0"}, "sspl", ""),
    "openrail": ("rail", r"(?:creativeml |bigscience )?open rail(?: m)?(?: license)?", {}, "openrail", ""),
    "cc0": ("cc0", r"cc0(?: public domain dedication)?", {"1(?: 0)?": "1.0"}, "cc0", "creativecommons org publicdomain zero"),
    "cc-by-nc-nd": ("cc", r"cc by nc nd", {"4(?: 0)?": "4.0", "3(?: 0)?": "3.0", "2 5": "2.5", "2(?: 0)?": "2.0"}, "cc by nc nd", "creativecommons org licenses by nc nd"),
    "cc-by-nc-sa": ("cc", r"cc by nc sa", {"4(?: 0)?": "4.0", "3(?: 0)?": "3.0", "2 5": "2.5", "2(?: 0)?": "2.0"}, "cc by nc sa", "creativecommons org licenses by nc sa"),
    "cc-by-nc": ("cc", r"cc by nc", {"4(?: 0)?": "4.0", "3(?: 0)?": "3.0", "2 5": "2.5", "2(?: 0)?": "2.0"}, "cc by nc", "creativecommons org licenses by nc"),
    "cc-by-nd": ("cc", r"cc by nd", {"4(?: 0)?": "4.0", "3(?: 0)?": "3.0", "2 5": "2.5", "2(?: 0)?": "2.0"}, "cc by nd", "creativecommons org licenses by nd"),
    "cc-by-sa": ("cc", r"cc by sa", {"4(?: 0)?": "4.0", "3(?: 0)?": "3.0", "2 5": "2.5", "2(?: 0)?": "2.0"}, "cc by sa", "creativecommons org licenses by sa"),
    "cc-by": ("cc", r"cc by", {"4(?: 0)?": "4.0", "3(?: 0)?": "3.0", "2 5": "2.5", "2(?: 0)?": "2.0"}, "cc by", "creativecommons org licenses by"),
    "cc-by-long": ("creative", r"creative commons attribution", {"4(?: 0)?": "4.0", "3(?: 0)?": "3.0", "2(?: 0)?": "2.0"}, "", ""),
    "cc-by-sa-long": ("creative", r"creative commons attribution share ?alike", {"4(?: 0)?": "4.0", "3(?: 0)?": "3.0", "2(?: 0)?": "2.0"}, "", ""),
    "cc-by-nc-long": ("creative", r"creative commons attribution non ?commercial", {"4(?: 0)?": "4.0", "3(?: 0)?": "3.0", "2(?: 0)?": "2.0"}, "", ""),
    "public-domain": ("domain", r"(?:dedicated to|released into|placed in|in) the public domain", {}, "", ""),
    "all-rights-reserved": ("reserved", r"all rights reserved", {}, "", ""),
}
NOTICE = r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:an? )?"


# label, keywords (all must be among the words), pattern: bodies, headers and joined forms
SIGNATURES = [
    ("mit", "permission hereby obtaining", r"permission is hereby granted(?: free of charge)? to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "copyright permission substantial", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("x11", "except advertising otherwise", r"except as contained in this notice the names? of (?:\S+ ){1,12}shall not be used in advertising or otherwise to promote the sale"),
    ("boost-1.0", "permission organization accompanying", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("isc", "permission distribute fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "permission distribute fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?= the software is provided)"),
    ("postgresql", "permission documentation agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission documentation fee", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("bsd", "redistribution binary permitted", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd-3-clause", "neither endorse contributors", r"neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising acknowledgement features", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", "freebsd views conclusions", r"the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("apache-2.0", "apache compliance except", r"licensed under the apache license version 2(?: 0)?(?: the license)? you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache asf contributor", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "perpetual worldwide apache", r"hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce"),
    ("gpl-2.0-or-later", "redistribute gnu later", r"(?:you can )?redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "redistribute gnu later", r"(?:you can )?redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "redistribute gnu foundation", r"(?:you can )?redistribute it and or modify it under the terms of (?:version 2 of the gnu general public license|the gnu general public license version 2) as published by the free software foundation"),
    ("gpl-3.0", "redistribute gnu foundation", r"(?:you can )?redistribute it and or modify it under the terms of (?:version 3 of the gnu general public license|the gnu general public license version 3) as published by the free software foundation"),
    ("lgpl-2.1-or-later", "redistribute lesser later", r"(?:you can )?redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "redistribute lesser later", r"(?:you can )?redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0-or-later", "redistribute affero later", r"(?:you can )?redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "preamble software freedom", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("lgpl", "lesser supplements version", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("gfdl", "permission invariant sections", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "mozilla subject form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla contents subject", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "eclipse accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("epl-1.0", "eclipse accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl-1.0", "contents common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "unencumbered domain released", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "compile anyone publish", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "authors liable warranty", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "misrepresented origin claim", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("wtfpl", "copy verbatim changing", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc0-1.0", "associated deed dedicated", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "waives copyright related", r"to the extent possible under law (?:\S+ ){1,12}(?:has|have) waived all copyright and related or neighboring rights"),
    ("ofl-1.1", "ofl fonts redistributed", r"the ofl allows the licensed fonts to be used studied modified and redistributed freely"),
    ("ofl-1.1", "font licensed sil", r"this font software is licensed under the sil open font license version 1 1"),
    ("python-2.0", "psf licensee python", r"psf is making python available to licensee on an as is basis"),
    ("artistic-1.0", "intent package copied", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "everyone package verbatim", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
    ("ms-pl", "microsoft accept contributor", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("sspl-1.0", "service functionality offering", r"if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("elastic-2.0", "hosted substantial features", r"you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "licensor production nonproduction", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("llama", "llama materials agreement", r"llama \d+(?: \d+)? community license(?: agreement)?"),
    ("openrail", "rail use restrictions", r"use based restrictions (?:\S+ ){0,12}rail license"),
    *[(f"gpl-{v}.0", f"gplv{v}", rf"(?:gnu )?gplv{v}(?: 0)?(?: or later)?") for v in (1, 2, 3)],
    *[(f"lgpl-{v.replace(' ', '.') if ' ' in v else v + '.0'}", f"lgplv{v[0]}", rf"(?:gnu )?lgplv{v}(?: or later)?") for v in ("2 1", "3", "2")],
    ("agpl-3.0", "agplv3", r"(?:gnu )?agplv3(?: or later)?"),
    ("gpl-2.0", "gpl2", r"gpl2"),
    ("gpl-3.0", "gpl3", r"gpl3"),
    ("lgpl-3.0", "lgpl3", r"lgpl3"),
    ("agpl-3.0", "agpl3", r"agpl3"),
    ("apache-2.0", "apachev2", r"apachev2(?: 0)?"),
    ("apache-2.0", "apache2", r"apache2(?: 0)?(?: license)?"),
    ("apache-2.0", "asl apache", r"apache asl 2(?: 0)?|asl 2 0"),
    ("mpl-2.0", "mplv2", r"mplv2(?: 0)?"),
    ("mpl-2.0", "mpl", r"mpl(?: v)? ?2 0"),
    ("epl-2.0", "eplv2", r"eplv2(?: 0)?"),
    ("bsd-3-clause", "bsd3", r"bsd3"),
    ("bsd-2-clause", "bsd2", r"bsd2"),
    ("cc0-1.0", "cc0", r"cc0 1 0 universal"),
]


def rules() -> list[dict]:
    """Ordered rules: label, keywords, regex, priority (level 0 to 4, 4 highest) and weight."""
    out: list[dict] = []

    def add(label, keys, rx, level, weight):
        out.append({"label": label, "keys": keys, "rx": rf"(?<= )(?:{rx})(?= )", "level": level, "weight": weight})

    for label, keys, rx in SIGNATURES:
        joined = " " not in keys  # a single keyword: a short form of the name, not a text
        add(label, keys.split(), rx, 1 if joined else 3, 0.8 if joined else 0.97)
    for family, (key, name, versions, spdx, url) in FAMILIES.items():
        label = family.removesuffix("-short").removesuffix("-long")
        every = {**{rf" {VERSION}{v}": f"{label}-{s}" for v, s in versions.items()}, "": label}
        for v, lab in every.items():
            weight = 0.0 if v else -0.05
            if spdx and not family.endswith("-short"):
                number = v.replace(f" {VERSION}", " ")
                add(lab, ["spdx"], rf"spdx license identifier {spdx}{number}(?: only| or later)?", 4, 0.99 + weight)
            if url:
                add(lab, [url.split()[0 if url.split()[0] != "www" else 1]], f"{url}{v.replace(f' {VERSION}', ' ')}", 3, 0.9 + weight)
            add(lab, [key, "under"], rf"{NOTICE}{name}{v}(?: or later| or any later version)?", 2, 0.95 + weight)
            add(lab, [key], rf"{name}{v}", 1 if v else 0, (0.8 if v else 0.6) + weight)
    return out


RULES = rules()
LEVELS = 5


def _spans(text: Column, rx: Column, level: Column, order: Column, label: Column, weight: Column) -> Column:
    """All matches of rx as intervals of characters."""
    pieces, found = F.split(text, rx, -1), F.regexp_extract_all(text, rx, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,level:int,ord:int,label:string,weight:double>>").alias("out"))

    def step(acc, m):
        a = acc["at"] + F.length(m["p"])
        b = a + F.length(m["m"])
        one = F.struct(a.alias("s"), b.alias("e"), level.alias("level"), order.alias("ord"), label.alias("label"), weight.alias("weight"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    zipped = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.when(F.size(found) > 0, F.aggregate(zipped, start, step, lambda acc: acc["out"]))


def _unsuppressed(spans: Column) -> Column:
    """Drop intervals that lie within one of the same or a higher level, in one sweep by start."""
    keys = F.transform(spans, lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("ne"), (-d["level"]).alias("nl"), d["ord"].alias("ord"), d["label"].alias("label"), d["weight"].alias("weight")))
    start = F.struct(F.array_repeat(F.lit(-1), LEVELS).alias("reach"), F.array().cast("array<struct<s:int,ne:int,nl:int,ord:int,label:string,weight:double>>").alias("out"))

    def step(acc, d):
        far = F.array_max(F.slice(acc["reach"], 1 - d["nl"], LEVELS + d["nl"]))  # of levels from the interval's own up
        reach = F.transform(acc["reach"], lambda x, i: F.when(i == -d["nl"], F.greatest(x, -d["ne"])).otherwise(x))
        return F.struct(reach.alias("reach"), F.when(far >= -d["ne"], acc["out"]).otherwise(F.concat(acc["out"], F.array(d))).alias("out"))

    return F.aggregate(F.array_sort(keys), start, step, lambda acc: acc["out"])


def _bind(value: Column, f) -> Column:
    """f(value), with the value evaluated once even where f uses it in lambdas."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def _starts(ws: list[str]):
    """Whether the words ws stand at place k of the words w, counted from 1."""

    def at(w, k):
        hit = F.element_at(w, k) == ws[0]
        for j, x in enumerate(ws[1:], 1):
            hit = hit & F.coalesce(F.get(w, k - 1 + j) == x, F.lit(False))
        return hit

    return at


def scan(docs: DataFrame, text: str = "text", signatures: list[dict] | None = None) -> DataFrame:
    """Rows of docs with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    detections are the intervals left (s, e: characters of the joined words; rule
    number, label, weight); score is the largest weight among them.
    """
    table_ = RULES if signatures is None else signatures
    spec = "array<struct<label:string,keys:array<string>,rx:string,level:int,weight:double,ord:int>>"
    known = F.from_json(F.lit(json.dumps([{**r, "ord": i} for i, r in enumerate(table_)])), spec)
    keywords = sorted({k for r in table_ for k in r["keys"]} | {w for p in PHRASES for w in p.split()})
    x = "_"
    while any(c.startswith(x) for c in docs.columns):  # names of our own that no column has
        x += "_"
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    base = [c for c in docs.columns if c not in new]
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    d = docs.withColumn(f"{x}w", F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))).select(*base, f"{x}w")
    d = d.withColumn(f"{x}k", F.array_intersect(F.array(*[F.lit(k) for k in keywords]), F.col(f"{x}w")))
    # the joined words, only for texts with a keyword
    d = d.withColumn(f"{x}t", F.when(F.size(f"{x}k") > 0, F.concat(F.lit(" "), F.array_join(f"{x}w", " "), F.lit(" "))))
    for i, phrase in enumerate(PHRASES):
        ws = phrase.split()
        there = F.col(f"{x}t").contains(f" {phrase} ")

        d = d.withColumn(f"{x}p{i}", F.when(there, _bind(F.col(f"{x}w"), lambda w, starts=_starts(ws): F.filter(F.sequence(F.lit(1), F.size(w)), lambda k: starts(w, k)))))
    d = d.withColumn(f"{x}places", F.concat(*[F.coalesce(F.col(f"{x}p{i}"), F.array().cast("array<int>")) for i in range(len(PHRASES))]))
    d = d.withColumn(f"{x}base", F.array_compact(F.array(*[F.when(F.size(f"{x}p{i}") > 0, F.lit(lab)) for i, lab in enumerate(PHRASES.values())])))
    active = _bind(F.col(f"{x}k"), lambda ks: F.filter(known, lambda r: F.forall(r["keys"], lambda k: F.array_contains(ks, k))))
    spelled = F.regexp_replace(f"{x}t", " licence(?= )", " license")  # as long as it was
    spans = _bind(F.col(f"{x}s"), lambda t: F.flatten(F.array_compact(F.transform(active, lambda r: _spans(t, r["rx"], r["level"], r["ord"], r["label"], r["weight"])))))
    d = d.withColumn(f"{x}s", spelled).withColumn(f"{x}all", F.when(F.col(f"{x}s").isNotNull(), spans))
    d = d.withColumn(f"{x}kept", F.when(F.size(f"{x}all") > 0, _unsuppressed(F.col(f"{x}all"))))
    kept = F.coalesce(f"{x}kept", F.array().cast("array<struct<s:int,ne:int,nl:int,ord:int,label:string,weight:double>>"))
    labels = F.array_sort(F.array_distinct(F.concat(f"{x}base", F.transform(kept, lambda y: y["label"]))))
    return d.select(
        *base,
        F.size(f"{x}w").cast("long").alias("n_words"),
        F.size(f"{x}places").cast("long").alias("n_base"),
        (F.array_min(f"{x}places") - 1).cast("long").alias("first_word"),
        (F.array_max(f"{x}places") - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(f"{x}base")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda y: y["weight"])), F.lit(0.0)).alias("score"),
        F.transform(kept, lambda y: F.struct(y["s"].alias("s"), (-y["ne"]).alias("e"), y["ord"].alias("rule"), y["label"].alias("label"), y["weight"].alias("weight"))).alias("detections"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")
