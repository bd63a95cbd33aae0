"""License scans by ordered signature rules.

A text is brought to words (ASCII letters and digits, A-Z lower-cased, and all characters beyond ASCII) joined by single spaces, and
hundreds of regular expressions over word sequences are tried on it.  Each rule has a label, a priority and a keyword that
every match holds: keywords are looked for first, and only the rules of those that occur are run, so a text
without any costs a few substring searches.

Detections are intervals of words.  One goes if it lies within another of higher priority, or within a longer one of its own
priority; of equal intervals the first rule stays.  Partial overlaps stay: a sentence can name two licenses.  (Whatever contains
what contains a detection contains the detection, so it is the same to ask all detections or only those that stay.)

The rules are made of families (names of a license, its versions, its tags and addresses) and shapes (an identifier line, a
notice, an address, a name with a version, a name alone), and of signatures: sentences that only one license has.

Everything is column expressions over one row; nothing is shuffled, and the rules are one array in the plan.

Defined results: null and empty texts have no words, no detections and score 0; repeated rows are scanned alike; an empty table gives no
rows; other columns are kept, but for clashing names of our own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that always count, with their labels (fixed values of the contract).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_CONFIDENCE = 90


@dataclass(frozen=True)
class Family:
    """A license: ``names`` is a pattern of its names; ``versions`` are (label, pattern) pairs; ``tags`` its SPDX identifiers
    and ``sites`` its addresses, both as words with {v} for the version."""

    label: str
    keyword: str
    names: str
    versions: tuple[tuple[str, str], ...] = ()
    tags: tuple[str, ...] = ()
    sites: tuple[str, ...] = ()


def _v(*versions: str) -> tuple[tuple[str, str], ...]:
    """Versions such as 2.1: the words 2 1, with 0 left out where it comes last; the longest first."""
    out = []
    for v in versions:
        whole, _, part = v.partition(".")
        out.append((v.removesuffix(".0"), f"{whole}(?: 0)?" if part == "0" else f"{whole} {part}" if part else whole))
    return tuple(out)


GNU = "(?:gnu )?"
FAMILIES = (
    Family("mit", "mit", "mit", (), ("mit", "mit 0"), ("opensource org licenses mit", "mit license org")),
    Family("x11", "x11", "x11", (), ("x11",)),
    Family("expat", "expat", "expat", (), (), ("directory fsf org wiki license expat",)),
    Family("isc", "isc", "isc", (), ("isc",), ("opensource org licenses isc",)),
    Family("apache", "apache", "apache(?: software)?", _v("2.0", "1.1", "1.0"), ("apache {v}",), ("www apache org licenses license {v}", "apache org licenses license {v}", "opensource org licenses apache {v}")),
    Family("gpl", "gpl", f"{GNU}gpl", _v("3.0", "2.0", "1.0"), ("gpl {v}", "gpl {v} only", "gpl {v} or later"), ("gnu org licenses gpl {v}", "gnu org licenses old licenses gpl {v}", "opensource org licenses gpl {v}")),
    Family("gpl", "general public", f"{GNU}general public", _v("3.0", "2.0", "1.0")),
    Family("lgpl", "lgpl", f"{GNU}lgpl", _v("3.0", "2.1", "2.0"), ("lgpl {v}", "lgpl {v} only", "lgpl {v} or later"), ("gnu org licenses lgpl {v}", "gnu org licenses old licenses lgpl {v}", "opensource org licenses lgpl {v}")),
    Family("lgpl", "general public", f"{GNU}(?:lesser|library) general public", _v("3.0", "2.1", "2.0")),
    Family("agpl", "agpl", f"{GNU}agpl", _v("3.0", "1.0"), ("agpl {v}", "agpl {v} only", "agpl {v} or later"), ("gnu org licenses agpl {v}", "opensource org licenses agpl {v}")),
    Family("agpl", "general public", f"{GNU}affero general public", _v("3.0", "1.0")),
    Family("gfdl", "fdl", f"{GNU}fdl", _v("1.3", "1.2", "1.1"), (), ("gnu org licenses fdl {v}",)),
    Family("gfdl", "gfdl", "gfdl", _v("1.3", "1.2", "1.1"), ("gfdl {v}", "gfdl {v} or later")),
    Family("gfdl", "free documentation", f"{GNU}free documentation", _v("1.3", "1.2", "1.1")),
    Family("bsd-2", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", (), ("bsd 2 clause",), ("opensource org licenses bsd 2 clause",)),
    Family("bsd-3", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", (), ("bsd 3 clause",), ("opensource org licenses bsd 3 clause",)),
    Family("bsd-4", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", (), ("bsd 4 clause",)),
    Family("0bsd", "0bsd", "0bsd", (), ("0bsd",), ("opensource org licenses 0bsd",)),
    Family("bsd", "bsd", "bsd(?: style)?"),
    Family("mpl", "mpl", "mpl", _v("2.0", "1.1", "1.0"), ("mpl {v}",), ("mozilla org mpl {v}",)),
    Family("mpl", "mozilla", "mozilla public", _v("2.0", "1.1", "1.0"), (), ("mozilla org en us mpl {v}",)),
    Family("epl", "epl", "epl", _v("2.0", "1.0"), ("epl {v}",), ("eclipse org legal epl v{v}", "eclipse org legal epl {v}")),
    Family("epl", "eclipse", "eclipse public", _v("2.0", "1.0")),
    Family("edl", "eclipse", "eclipse distribution", _v("1.0")),
    Family("cddl", "cddl", "cddl", _v("1.1", "1.0"), ("cddl {v}",), ("opensource org licenses cddl {v}",)),
    Family("cddl", "common development", "common development and distribution", _v("1.1", "1.0")),
    Family("cpl", "common public", "common public", _v("1.0"), ("cpl {v}",)),
    Family("eupl", "eupl", "eupl", _v("1.2", "1.1", "1.0"), ("eupl {v}",), ("joinup ec europa eu software page eupl",)),
    Family("eupl", "european union", "european union public", _v("1.2", "1.1", "1.0")),
    Family("osl", "open software", "open software", _v("3.0", "2.1", "2.0"), ("osl {v}",)),
    Family("afl", "academic free", "academic free", _v("3.0", "2.1", "2.0"), ("afl {v}",)),
    Family("artistic", "artistic", "(?:perl )?artistic", _v("2.0", "1.0"), ("artistic {v}",), ("opensource org licenses artistic {v}",)),
    Family("bsl", "boost", "boost software", _v("1.0"), ("bsl {v}",), ("boost org license {v}",)),
    Family("busl", "business source", "business source", _v("1.1"), ("busl {v}",), ("mariadb com bsl11",)),
    Family("elastic", "elastic", "elastic", _v("2.0"), ("elastic {v}",), ("elastic co licensing elastic license",)),
    Family("sspl", "server side", "server side public", _v("1.0"), ("sspl {v}",), ("mongodb com licensing server side public license",)),
    Family("commons-clause", "commons clause", "commons clause", _v("1.0")),
    Family("zlib", "zlib", "zlib(?: libpng)?", (), ("zlib", "zlib acknowledgement"), ("opensource org licenses zlib",)),
    Family("libpng", "libpng", "(?:png reference library|libpng)", _v("2.0"), ("libpng {v}", "libpng")),
    Family("python", "python", "python(?: software foundation)?", _v("2.0"), ("python {v}", "psf {v}")),
    Family("ruby", "ruby", "ruby", (), ("ruby",)),
    Family("php", "php", "php", _v("3.01", "3.0"), ("php {v}",), ("php net license {v}",)),
    Family("postgresql", "postgresql", "postgresql", (), ("postgresql",), ("opensource org licenses postgresql",)),
    Family("openssl", "openssl", "openssl", (), ("openssl",)),
    Family("w3c", "w3c", "w3c(?: software(?: notice(?: and)?)?)?", (), ("w3c",)),
    Family("unlicense", "unlicense", "unlicense", (), ("unlicense",), ("unlicense org",)),
    Family("wtfpl", "wtfpl", "wtfpl", _v("2.0"), ("wtfpl",), ("wtfpl net",)),
    Family("beerware", "beer", "beer ?ware", (), ("beerware",)),
    Family("ofl", "open font", "(?:sil )?open font", _v("1.1", "1.0"), ("ofl {v}",), ("scripts sil org ofl",)),
    Family("odbl", "open database", "(?:open data commons )?open database", _v("1.0"), ("odbl {v}",), ("opendatacommons org licenses odbl",)),
    Family("odc-by", "open data commons", "open data commons attribution", _v("1.0"), ("odc by {v}",), ("opendatacommons org licenses by",)),
    Family("pddl", "public domain dedication", "(?:open data commons )?public domain dedication(?: and)?", _v("1.0"), ("pddl {v}",), ("opendatacommons org licenses pddl",)),
    Family("cdla-permissive", "community data", "community data license agreement permissive", _v("2.0", "1.0"), ("cdla permissive {v}",)),
    Family("cdla-sharing", "community data", "community data license agreement sharing", _v("1.0"), ("cdla sharing {v}",)),
    Family("ms-pl", "microsoft", "microsoft public", (), ("ms pl",), ("opensource org licenses ms pl",)),
    Family("ms-rl", "microsoft", "microsoft reciprocal", (), ("ms rl",)),
    Family("upl", "universal permissive", "universal permissive", _v("1.0"), ("upl {v}",), ("oss oracle com licenses upl",)),
    Family("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", (), ("ncsa",)),
    Family("cecill", "cecill", "cecill(?: [bc])?", _v("2.1", "2.0", "1.0"), ("cecill {v}", "cecill b", "cecill c"), ("cecill info",)),
    Family("mulan", "mulan", "mulan(?: permissive software)?", _v("2.0", "1.0"), ("mulanpsl {v}",), ("license coscl org cn mulanpsl2",)),
    Family("vim", "vim", "vim", (), ("vim",)),
    Family("curl", "curl", "curl", (), ("curl",)),
    Family("qpl", "q public", "q public", _v("1.0"), ("qpl {v}",)),
    Family("ssleay", "ssleay", "ssleay", (), ("ssleay",)),
    Family("sleepycat", "sleepycat", "sleepycat", (), ("sleepycat",)),
    Family("openrail", "openrail", "(?:creativeml |bigscience |bigcode )?openrail(?: m)?", (), ("openrail",)),
    Family("llama", "llama", "llama(?: [234](?: [0-9])?)? community"),
)

#: Creative Commons: elements in their order, as words of the short and the long form.
ELEMENTS = {"by": ("by", "attribution"), "nc": ("nc", "non ?commercial"), "sa": ("sa", "share ?alike"), "nd": ("nd", "no ?deriv(?:ative)?s?(?: works)?")}
COMMONS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
COMMONS_VERSION = "(?: (?:version |v )?[1-4] [05])?(?: (?:international|unported|generic|igo))?"

#: Sentences that tell a license without naming it: (label, keyword, pattern).
SIGNATURES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "without limitation the rights", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "endorse or promote", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("gpl", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("apache-2", "compliance with the license", "you may not use this file except in compliance with the license"),
    ("bsl-1", "boost software", "distributed under the boost software license version 1 0"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:is|are|placed|dedicated|released|released to|released into|in) (?:in |to )?the public domain"),
    ("zlib", "without any express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "written", "without the (?:express |prior )*written (?:permission|consent) of"),
    ("no-redistribution", "may not be", "may not be (?:reproduced|copied|redistributed|published|broadcast|rewritten)"),
    ("non-commercial", "commercial", "(?:for )?non commercial (?:use|purposes) only"),
    ("non-commercial", "noncommercial", "(?:for )?noncommercial (?:use|purposes) only"),
    ("non-commercial", "commercial", "not (?:be used )?for commercial (?:use|purposes)"),
    ("personal-use", "personal use", "for personal use only"),
    ("editorial-use", "editorial use", "for editorial use only"),
)

PRIORITY = {"tag": 100, "signature": 90, "site": 80, "notice": 70, "version": 60, "name": 40}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int


NOTICE = "(?:licensed|released|distributed|available|provided|published|covered|governed|shared|used)(?: only)? (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:an? )?"
LATER = "(?: or (?:any |at your option any )?(?:later|newer)(?: version)?| only)?"


def _versioned(f: Family) -> list[tuple[str, str]]:
    return [(f"{f.label}-{name}", pattern) for name, pattern in f.versions]


def rules() -> tuple[Rule, ...]:
    """All rules in order; each pattern is of whole words."""
    out = []

    def add(label: str, keyword: str, pattern: str, shape: str) -> None:
        out.append(Rule(label, keyword, pattern, PRIORITY[shape]))

    for f in FAMILIES:
        for text in f.tags:
            for label, v in _versioned(f) if "{v}" in text else [(f.label, "")]:
                add(label, "spdx", f"spdx license identifier {text.replace('{v}', v)}", "tag")
        for text in f.sites:
            for label, v in _versioned(f) if "{v}" in text else [(f.label, "")]:
                add(label, f.keyword if f.keyword in text else text.split(" {v}")[0].split("{v}")[0], f"(?:https? )?(?:www )?{text.replace('{v}', v)}", "site")
        for label, v in _versioned(f):
            add(label, f.keyword, f"{f.names} (?:license )?(?:version |v ?)?{v}{LATER}", "version")
            add(label, f.keyword, f"{NOTICE}{f.names} (?:licen[cs]e )?(?:version |v ?)?{v}{LATER}", "notice")
        add(f.label, f.keyword, f"{NOTICE}{f.names}(?: licen[cs]e| licensing)?", "notice")
        add(f.label, f.keyword, f"{f.names} licen[cs]e", "name")
    for code in COMMONS:
        parts = code.split("-")
        short, long = " ".join(ELEMENTS[p][0] for p in parts), " ".join(ELEMENTS[p][1] for p in parts)
        add(f"cc-{code}", "spdx", f"spdx license identifier cc {short}{COMMONS_VERSION}", "tag")
        add(f"cc-{code}", "creativecommons", f"(?:https? )?(?:www )?creativecommons org licenses {short}(?: [1-4] [05])?", "site")
        add(f"cc-{code}", "cc by", f"{NOTICE}cc {short}{COMMONS_VERSION}", "notice")
        add(f"cc-{code}", "creative commons", f"{NOTICE}creative commons {long}{COMMONS_VERSION}(?: licen[cs]e)?", "notice")
        add(f"cc-{code}", "cc by", f"cc {short}{COMMONS_VERSION}", "version")
        add(f"cc-{code}", "creative commons", f"creative commons {long}{COMMONS_VERSION}(?: licen[cs]e)?", "version")
    add("cc0", "cc0", "cc0(?: (?:version )?1 0)?(?: universal)?", "version")
    add("cc0", "creativecommons", "(?:https? )?(?:www )?creativecommons org publicdomain zero(?: 1 0)?", "site")
    add("cc", "creative commons", "creative commons(?: licen[cs]e)?", "name")
    for label, keyword, pattern in SIGNATURES:
        add(label, keyword, pattern, "signature")
    return tuple(out)


DETECTION = "struct<first:int,next:int,priority:int,rule:int>"


def word_text(text: Column) -> Column:
    """The words of a text between single spaces, with one space before the first and behind the last; "" if there is none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    words = F.btrim(F.regexp_replace(low, OTHER, " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: str) -> str:
    return f"(length({text}) - length(replace({text}, ' ', '')))"


def _matches(words: str, pattern: str, rule: str, priority: str) -> str:
    """SQL for the detections of one pattern.  The text is cut at its matches; a piece or a match has as many words as spaces, as each begins
    with one."""
    return (
        f"aggregate(zip_with(split({words}, {pattern}), regexp_extract_all({words}, {pattern}, 0), (a, b) -> named_struct('a', {_spaces('a')}, 'b', {_spaces('b')})), "
        f"named_struct('at', 0, 'out', cast(array() AS array<{DETECTION}>)), "
        f"(acc, p) -> CASE WHEN p.b IS NULL THEN acc ELSE named_struct('at', acc.at + p.a + p.b, 'out', concat(acc.out, array(named_struct('first', acc.at + p.a, 'next', acc.at + p.a + p.b, 'priority', {priority}, 'rule', {rule})))) END, "
        "acc -> acc.out)"
    )


def _listed(values) -> str:
    """SQL for an array of strings without line breaks, folded to a constant when the query is planned."""
    return "split('" + "\n".join(map(str, values)).replace("\\", "\\\\").replace("'", "\\'") + "', '\\n')"


def detections(words: str, table: tuple[Rule, ...]) -> Column:
    """All detections in a column of ``word_text``: array<struct<first, next, priority, rule>>, words from 0, next behind the last."""
    w, none = f"`{words}`", f"cast(array() AS array<{DETECTION}>)"
    met = f"filter({_listed(sorted({r.keyword for r in table}))}, k -> contains({w}, concat(' ', k)))"
    mine = f"filter(sequence(0, {len(table) - 1}), i -> array_contains(met, get({_listed(r.keyword for r in table)}, i)))"
    pattern, priority = f"get({_listed(f' (?:{r.pattern})(?= )' for r in table)}, i)", f"cast(get({_listed(r.priority for r in table)}, i) AS int)"
    found = f"flatten(transform({mine}, i -> {_matches(w, pattern, 'i', priority)}))"
    return F.expr(f"element_at(transform(array({met}), met -> CASE WHEN size(met) = 0 THEN {none} ELSE {found} END), 1)")


def standing(found: str) -> Column:
    """The detections that no other suppresses, by place.  They are passed in the order of first word, longest first; for each priority the
    furthest end so far is kept, so a detection is contained in an earlier one of its priority or a higher one exactly if that end is
    not before its own.  Of one interval and priority the first rule comes first."""
    levels = sorted(set(PRIORITY.values()), reverse=True)
    level = "array_position(array(" + ", ".join(map(str, levels)) + "), x.priority)"
    order = "(a, b) -> CASE WHEN a.first <> b.first THEN a.first - b.first WHEN a.next <> b.next THEN b.next - a.next WHEN a.priority <> b.priority THEN b.priority - a.priority ELSE a.rule - b.rule END"
    start = "array(" + ", ".join(["0"] * len(levels)) + ")"
    none = f"cast(array() AS array<{DETECTION}>)"
    hidden = f"array_max(slice(acc.ends, 1, cast({level} AS int))) >= x.next"
    ends = f"transform(acc.ends, (e, i) -> if(i + 1 = {level}, greatest(e, x.next), e))"
    step = f"(acc, x) -> CASE WHEN {hidden} THEN acc ELSE named_struct('ends', {ends}, 'out', concat(acc.out, array(x))) END"
    return F.expr(f"aggregate(array_sort(`{found}`, {order}), named_struct('ends', {start}, 'out', {none}), {step}, acc -> acc.out)")


def base_places(words: str) -> Column:
    """array<struct<first, next, priority, rule>> of the base phrases, by place; ``rule`` is the phrase's number."""
    w = f"`{words}`"
    one = lambda i, phrase: f"CASE WHEN contains({w}, ' {phrase} ') THEN {_matches(w, chr(39) + ' ' + phrase + '(?= )' + chr(39), str(i), str(BASE_CONFIDENCE))} ELSE cast(array() AS array<{DETECTION}>) END"
    return F.expr("array_sort(concat(" + ", ".join(one(i, p) for i, (p, _) in enumerate(BASE)) + "))")


OURS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


def _labels(*arrays: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")


def scan(docs: DataFrame, text: str = "text", table: tuple[Rule, ...] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, the base phrases' n_base, first_word, last_word and base_labels, ``labels`` (those of
    the rules too), ``score`` (the confidence of the surest detection, 0 to 1) and ``detections`` (array<struct<label, priority, first,
    next>>: what stands, in words of the text)."""
    table = rules() if table is None else table
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OURS])
    words, found, base = scratch(docs, "words", "found", "base")
    out = docs.withColumn(words, word_text(F.col(f"`{text}`")))
    out = out.withColumn(found, detections(words, table)).withColumn(base, base_places(words))
    out = out.withColumn(found, standing(found))
    named = _listed(r.label for r in table)
    labels = F.expr(f"transform(`{found}`, x -> get({named}, x.rule))")
    base_labels = F.expr(f"transform(`{base}`, x -> get({_listed(label for _, label in BASE)}, x.rule))")
    surest = F.array_max(F.transform(F.concat(found, base), lambda x: x["priority"]))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.greatest(F.expr(_spaces(f"`{words}`")) - 1, F.lit(0)).cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"), F.expr(f"cast(get(`{base}`, 0).first AS long)").alias("first_word"), F.expr(f"cast(try_element_at(`{base}`, -1).first AS long)").alias("last_word"),
        _labels(base_labels).alias("base_labels"), _labels(base_labels, labels).alias("labels"),
        (F.coalesce(surest, F.lit(0)) / 100).alias("score"),
        F.expr(f"transform(`{found}`, x -> named_struct('label', get({named}, x.rule), 'priority', x.priority, 'first', x.first, 'next', x.next))").alias("detections"),
    )
