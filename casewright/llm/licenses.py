r"""License scans: ordered signature rules over normalised words, in DataFrame operations alone.

Rules are regexes without repetition over words joined by single spaces: names of licenses in a few templates (grant,
identifier, reference, bare name), phrases of the license texts themselves, and addresses.  What a rule matches can be
written out, and from that its keywords are derived: words of which every match holds at least one.  A text is
normalised only if it holds a gate word; the gate words are derived in the same way from all rules together.  So
neither prefilter can lose a detection.

Detections are ordered by start, the longer first, then by priority; one that lies inside an earlier kept one of the
same or a higher priority is suppressed.  The three base phrases are rules of the highest priority and are never
suppressed.  The score is the highest kept priority as a share of 100, at most 1.

Defined results: a null text counts as empty; without a base phrase first_word and last_word are null and
base_labels is empty; without any detection labels is empty and score 0; detections of one start, length and priority
go by label; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.columns import let, scan
from casewright.llm.decontaminate import WORD, words_of


@dataclass(frozen=True)
class Rule:
    """Every match of ``pattern`` holds one of ``keywords``."""

    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str
    base: bool = False


#: Phrase and label of the base detections.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Label, names (regexes over normalised words), identifier.
FAMILIES = [
    ("mit", r"mit(?: x11)? licen[cs]e", "mit"),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("apache-1.1", r"apache(?: software)? licen[cs]e(?: version)? 1 1", "apache 1 1"),
    ("apache-2", r"apache(?: software)? licen[cs]e(?: version)? 2(?: 0)?", "apache 2 0"),
    ("bsd-2", r"(?:2|two) clause bsd(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e", "bsd 2 clause"),
    ("bsd-3", r"(?:3|three) clause bsd(?: licen[cs]e)?|(?:new|revised|modified) bsd licen[cs]e", "bsd 3 clause"),
    ("bsd-4", r"(?:4|four) clause bsd(?: licen[cs]e)?|original bsd licen[cs]e", "bsd 4 clause"),
    ("bsd-0", r"(?:0|zero) clause bsd(?: licen[cs]e)?", "0bsd"),
    ("bsd", r"bsd(?: style)? licen[cs]e", "bsd"),
    ("gpl-1", r"gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 1(?: 0)?", "gpl 1 0"),
    ("gpl-2", r"gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 2(?: 0)?", "gpl 2 0"),
    ("gpl-3", r"gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?", "gpl 3 0"),
    ("gpl", r"gnu general public licen[cs]e", "gpl"),
    ("lgpl-2.1", r"gnu lesser general public licen[cs]e(?: version)? 2 1", "lgpl 2 1"),
    ("lgpl-3", r"gnu lesser general public licen[cs]e(?: version)? 3(?: 0)?", "lgpl 3 0"),
    ("lgpl", r"gnu (?:lesser|library) general public licen[cs]e", "lgpl"),
    ("agpl-3", r"gnu affero general public licen[cs]e(?: version)? 3(?: 0)?", "agpl 3 0"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "agpl"),
    ("gfdl", r"gnu free documentation licen[cs]e(?: version 1 [123])?", "gfdl 1 3"),
    ("mpl-1.1", r"mozilla public licen[cs]e(?: version)? 1 1", "mpl 1 1"),
    ("mpl-2", r"mozilla public licen[cs]e(?: version)? 2(?: 0)?", "mpl 2 0"),
    ("mpl", r"mozilla public licen[cs]e", "mpl"),
    ("epl-1", r"eclipse public licen[cs]e(?: version)?(?: v)? ?1(?: 0)?", "epl 1 0"),
    ("epl-2", r"eclipse public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?", "epl 2 0"),
    ("cddl-1", r"common development and distribution licen[cs]e(?: version 1 [01])?", "cddl 1 0"),
    ("cpl-1", r"common public licen[cs]e(?: version 1 0)?", "cpl 1 0"),
    ("artistic-1", r"artistic licen[cs]e(?: version)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2", r"artistic licen[cs]e(?: version)? 2(?: 0)?", "artistic 2 0"),
    ("isc", r"isc licen[cs]e", "isc"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("boost-1", r"boost software licen[cs]e(?: version 1 0)?", "bsl 1 0"),
    ("unlicense", r"the unlicense|unlicense org", "unlicense"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e", "wtfpl"),
    ("ms-pl", r"microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "ms rl"),
    ("afl-3", r"academic free licen[cs]e(?: version 3 0)?", "afl 3 0"),
    ("osl-3", r"open software licen[cs]e(?: version 3 0)?", "osl 3 0"),
    ("eupl-1.2", r"european union public licen[cs]e(?: version 1 2)?", "eupl 1 2"),
    ("psf-2", r"python software foundation licen[cs]e(?: version 2)?", "psf 2 0"),
    ("php-3", r"php licen[cs]e(?: version 3 0?1?)?", "php 3 01"),
    ("ruby", r"ruby licen[cs]e", "ruby"),
    ("openssl", r"openssl licen[cs]e", "openssl"),
    ("curl", r"curl licen[cs]e", "curl"),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", "ncsa"),
    ("ofl-1.1", r"sil open font licen[cs]e(?: version 1 1)?", "ofl 1 1"),
    ("odbl", r"open (?:data commons open )?database licen[cs]e", "odbl 1 0"),
    ("pddl", r"public domain dedication and licen[cs]e", "pddl 1 0"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("public-domain", r"(?:in|into|to) the public domain", "public domain"),
    ("cc-by", r"creative commons attribution(?: [1-4] 0)?(?: international| unported)?(?: licen[cs]e)?", "cc by"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)?(?: licen[cs]e)?", "cc by sa"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] 0)?", "cc by nd"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)?(?: licen[cs]e)?", "cc by nc"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?", "cc by nc sa"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] 0)?", "cc by nc nd"),
    ("sspl", r"server side public licen[cs]e(?: version 1)?", "sspl 1 0"),
    ("busl-1.1", r"business source licen[cs]e(?: 1 1)?", "busl 1 1"),
    ("elastic-2", r"elastic licen[cs]e(?: 2 0)?", "elastic 2 0"),
    ("proprietary", r"proprietary(?: and confidential| licen[cs]e| software)", "proprietary"),
    ("all-rights-reserved", r"all rights reserved", "all rights reserved"),
]

#: Priority and pattern of each way to name a license; NAME and ID are put in.
TEMPLATES = [
    (100, "id", r"spdx licen[cs]e identifier ID(?: only| or later)?"),
    (90, "name", r"(?:licen[cs]ed|released|distributed|available|provided|published|covered|governed) (?:under|by|with|to you under) (?:the )?(?:terms of (?:the )?)?(?:NAME)"),
    (80, "name", r"(?:see|under|subject to|of|per|to) (?:the )?(?:terms of (?:the )?)?(?:NAME)"),
    (60, "name", r"(?:NAME)"),
]
#: Label and phrases (regexes over normalised words) of the license texts.
CLAUSES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", r"this software is provided by the (?:copyright holders?|authors?|regents|author)(?: and contributors)? as is"),
    ("bsd-3", r"neither the names? of the (?:copyright holders?|authors?|organi[sz]ation|university) nor the names of (?:its|their|any) contributors"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2", r"you may not use this file except in compliance with the license"),
    ("apache-2", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", r"you should have received a copy of the gnu general public license"),
    ("gpl-2", r"either version 2 of the license or at your option any later version"),
    ("gpl-3", r"either version 3 of the license or at your option any later version"),
    ("gpl-2", r"gnu general public license v(?:ersion)? ?2(?: only| or later)"),
    ("gpl-3", r"gnu general public license v(?:ersion)? ?3(?: only| or later)"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", r"either version 2 1 of the license or at your option any later version"),
    ("agpl", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3", r"remote network interaction use with the gnu general public license"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", r"the author disclaims all warranties with regard to this software"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", r"the origin of this software must not be misrepresented"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("boost-1", r"permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("artistic-1", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("psf-2", r"psf is making python available to licensee on an as is basis"),
    ("php-3", r"this product includes php software freely available from"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("openssl", r"this product includes software developed by the openssl project"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", r"the font software may not be sold by itself"),
    ("odbl", r"this database is made available under the open database license"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", r"to the extent possible under law the (?:author|person|publisher)s? (?:has|have|who) (?:waived|associated)"),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", r"you may not distribute the modified material"),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("sspl", r"offering the program as a service"),
    ("busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("elastic-2", r"you may not provide the software to third parties as a hosted or managed service"),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|document|software|material)"),
    ("proprietary", r"may not be (?:reproduced|copied|distributed) (?:in any form )?without (?:the )?(?:prior )?(?:written )?(?:permission|consent)"),
    ("public-domain", r"(?:dedicated|released|placed|contributed) (?:in|in to|into|to) the public domain"),
    ("public-domain", r"no rights reserved|free of known copyright restrictions|copyright has expired"),
]
#: Label and words of a license's address.
ADDRESSES = [
    ("mit", "opensource org licenses? mit"), ("isc", "opensource org licenses? isc"), ("bsd-2", "opensource org licenses? bsd 2 clause"),
    ("bsd-3", "opensource org licenses? bsd 3 clause"), ("apache-2", "apache org licenses license 2 0"), ("apache-2", "opensource org licenses? apache 2 0"),
    ("gpl-2", "gnu org licenses (?:old licenses )?gpl 2 0"), ("gpl-3", "gnu org licenses gpl 3 0"), ("gpl", "gnu org licenses gpl html"),
    ("lgpl-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1"), ("lgpl-3", "gnu org licenses lgpl 3 0"), ("agpl-3", "gnu org licenses agpl 3 0"),
    ("gfdl", "gnu org licenses fdl(?: 1 3)?"), ("mpl-2", "mozilla org mpl 2 0"), ("mpl-2", "mozilla org en us mpl 2 0"),
    ("epl-1", "eclipse org legal epl v10"), ("epl-2", "eclipse org legal epl (?:v20|2 0)"), ("boost-1", "boost org license 1 0"),
    ("ofl-1.1", "scripts sil org ofl"), ("odbl", "opendatacommons org licenses odbl"), ("pddl", "opendatacommons org licenses pddl"),
    ("cc-by", "creativecommons org licenses by [1-4]"), ("cc-by-sa", "creativecommons org licenses by sa"), ("cc-by-nd", "creativecommons org licenses by nd"),
    ("cc-by-nc", "creativecommons org licenses by nc [1-4]"), ("cc-by-nc-sa", "creativecommons org licenses by nc sa"), ("cc-by-nc-nd", "creativecommons org licenses by nc nd"),
    ("cc0", "creativecommons org publicdomain zero"), ("public-domain", "creativecommons org publicdomain mark"), ("wtfpl", "wtfpl net"),
    ("eupl-1.2", "joinup ec europa eu collection eupl"), ("sspl", "mongodb com licensing server side public license"), ("elastic-2", "elastic co licensing elastic license"),
]
CLAUSE, ADDRESS = 85, 95


def forms(pattern: str) -> set[str]:
    """All texts that a pattern matches: alternatives, groups, classes and ``?`` written out."""

    def read(i: int) -> tuple[set[str], int]:
        done: set[str] = set()
        texts = {""}
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                done, texts, i = done | texts, {""}, i + 1
                continue
            if pattern.startswith("(?:", i):
                atom, i = read(i + 3)
                i += 1
            elif pattern[i] == "[":
                end = pattern.index("]", i)
                inner, i = pattern[i + 1 : end], end + 1
                atom = set(map(chr, range(ord(inner[0]), ord(inner[2]) + 1))) if "-" in inner else set(inner)
            elif pattern[i].isalnum() or pattern[i] == " ":
                atom, i = {pattern[i]}, i + 1
            else:
                raise ValueError(f"{pattern[i]!r} is not for these rules: {pattern}")
            if pattern[i : i + 1] == "?":
                atom, i = atom | {""}, i + 1
            texts = {a + b for a in texts for b in atom}
        return done | texts, i

    return read(0)[0]


def covering(texts: set[str], dull: frozenset[str] = frozenset()) -> tuple[str, ...]:
    """Words of which every text holds one: each time the one in most of the texts left, then the longest; ``dull``
    words come last."""
    left, out = [set(t.split()) for t in texts], []
    while left:
        counts = Counter(w for words in left for w in words)
        best = min(counts, key=lambda w: (w in dull or w.isdigit(), -counts[w], -len(w), w))
        out.append(best)
        left = [words for words in left if best not in words]
    return tuple(out)


#: Words that are in many licenses' names, so they tell little.
DULL = frozenset("license licence licenses software public version general free open the of and to this is in you or a by for".split())
#: Words that are in most texts, so they make poor gates.
COMMON = frozenset(
    "the of to and or in is you a by for be not may this as on with under any all if are no who has have its their that into other "
    "use make available collection open free general public version new one two three four old by work file time first person".split()
)
_HIT = "struct<start:int,back:int,low:int,label:string,base:boolean>"


def _rule(label: str, priority: int, pattern: str, named: str | None = None, base: bool = False) -> Rule:
    """``named``: the part of the pattern that its keywords are taken from (all of it if None)."""
    return Rule(label, priority, covering(forms(named or pattern), DULL), pattern, base)


def build_rules() -> list[Rule]:
    """All rules, base phrases first, then by what they are."""
    rules = [_rule(label, 1000, phrase, base=True) for phrase, label in BASE]
    for label, name, identifier in FAMILIES:
        for priority, kind, template in TEMPLATES:
            part = identifier if kind == "id" else name
            rules.append(_rule(label, priority, template.replace("ID", part) if kind == "id" else template.replace("NAME", part), "identifier" if kind == "id" else name))
    rules += [_rule(label, CLAUSE, phrase) for label, phrase in CLAUSES]
    return rules + [_rule(label, ADDRESS, address) for label, address in ADDRESSES]


def gate_of(rules: list[Rule]) -> str:
    """A pattern that a raw text meets if any rule can match in it: words that cover all that the rules match."""
    texts = {t for r in rules for t in forms(r.pattern)}
    long, short = [], []
    for word in covering(texts, COMMON):
        (long if len(word) > 3 else short).append(word)
    edge = WORD.removesuffix("+")
    parts = [*long, *([rf"(?<!{edge})(?:{'|'.join(short)})(?!{edge})"] if short else [])]
    return "(?i)" + "|".join(parts)


RULES = build_rules()
GATE = gate_of(RULES)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(norm: Column, rule: Column) -> Column:
    """Detections of one rule: start (word), back (- last word), low (- priority), label, base.

    \x01 and \x02 can mark the matches: normalised text has no such characters.
    """
    marked = F.regexp_replace(norm, F.concat(F.lit("(?<= )(?:"), rule.pattern, F.lit(")(?= )")), F.lit("\x01$0\x02"))

    def step(n: Column, piece: Column) -> Column:
        last = n - 1 + _spaces(F.substring_index(piece, "\x02", 1))
        hit = F.struct(
            (n - 1).cast("int").alias("start"),
            (-last).cast("int").alias("back"),
            (-rule.priority).cast("int").alias("low"),
            rule.label.alias("label"),
            rule.base.alias("base"),
        )
        # The piece before the first match has no end mark, so it only adds its spaces.
        return F.struct((n + _spaces(piece)).cast("int").alias("state"), F.when(F.contains(piece, F.lit("\x02")), hit).alias("out"))

    return scan(F.split(marked, "\x01"), F.lit(0), step, _HIT)


def _suppressed(hits: Column) -> Column:
    """Sorted detections without those inside the kept one that reaches furthest, unless of higher priority."""

    def step(kept: Column, h: Column) -> Column:
        drop = ~h.base & (h.back >= kept.back) & (h.low >= kept.low)
        further = ~drop & (h.back < kept.back)
        state = F.struct(F.when(further, h.back).otherwise(kept.back).alias("back"), F.when(further, h.low).otherwise(kept.low).alias("low"))
        return F.struct(state.alias("state"), F.when(~drop, h).alias("out"))

    return scan(F.array_sort(hits), F.struct(F.lit(1).alias("back"), F.lit(0).alias("low")), step, _HIT)


def detect(text: Column, rules: list[Rule] = RULES, gate: str | None = None) -> Column:
    """Kept detections in a text's words."""
    table = F.array(
        *[
            F.struct(
                F.lit(r.label).alias("label"),
                F.lit(r.priority).alias("priority"),
                F.array(*[F.lit(k) for k in r.keywords]).alias("keywords"),
                F.lit(r.pattern).alias("pattern"),
                F.lit(r.base).alias("base"),
            )
            for r in rules
        ]
    )
    none = F.array().cast(f"array<{_HIT}>")

    def found(norm: Column) -> Column:
        gated = F.filter(table, lambda r: F.exists(r.keywords, lambda k: F.contains(norm, k)))
        return _suppressed(F.flatten(F.transform(gated, lambda r: _places(norm, r))))

    norm = F.concat(F.lit(" "), F.array_join(words_of(text), " "), F.lit(" "))
    gate = gate or (GATE if rules is RULES else gate_of(rules))
    return F.when(F.coalesce(text, F.lit("")).rlike(gate), let(norm, found)).otherwise(none)


def _labels(hits: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h.label))), ",")


def scan_licenses(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    text = F.col("text")
    rows = documents.select(
        "doc_id",
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        let(detect(text, rules), lambda h: F.struct(h.alias("all"), F.filter(h, lambda x: x.base).alias("base"))).alias("h"),
    )
    starts = F.transform("h.base", lambda h: h.start.cast("long"))
    strongest = F.coalesce(F.array_max(F.transform("h.all", lambda h: -h.low)), F.lit(0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("h.base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(F.col("h.base")).alias("base_labels"),
        _labels(F.col("h.all")).alias("labels"),
        F.least(F.lit(1.0), strongest / F.lit(100.0)).cast("double").alias("score"),
    )
