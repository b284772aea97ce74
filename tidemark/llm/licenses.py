"""License scans: ordered signature rules over words, gated by keywords, resolved by priority and containment.

A word is a longest run of ASCII digits and letters and of characters over 127, with A-Z lower-cased. A
rule is a regular expression over words that are each followed by one blank; it opens with a plain word, its
keyword, and is tried only where that word stands (and only if the next WIDTH words hold the rule's second
keyword). Of the rules that match at one word the first in order is the detection there: rules are
ordered by priority, then as written below, the more special one first. A detection falls if an
earlier one of no lower priority contains its words. As there is one detection a word and none is longer
than WIDTH words, only the WIDTH - 1 detections before it are looked at, so the work grows with the text.

Rules come from a table of licenses and the forms that name them: SPDX tags, notices ("licensed under
..."), license fields, addresses and bare names; and from opening sentences of license texts and weaker hints.
The base phrases (BASE) are counted apart and never suppressed.

Everything is DataFrame expressions on one row: no shuffle, so a hot source or a repeated line costs
nothing more, and a lost task is just run again.

Edge cases: a null text is empty: no words, no labels ('') and score 0; null ids and repeated rows stay as
they are; a very long text is read whole, in time that grows with its words; an empty table gives no rows; columns other
than the text are neither read nor changed and may have any name.
"""

from __future__ import annotations

import json
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 32

#: Phrase and label: fixed by the definition of the base detections.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, SPDX id, names). A name opens with its keyword; the more special license stands first.
LICENSES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit-0", "mit 0", ("mit no attribution(?: licen[sc]e)?", "mit 0")),
    ("mit", "mit", ("mit licen[sc]e", "mit x11(?: licen[sc]e)?", "expat licen[sc]e", "x11 licen[sc]e")),
    ("apache-1.1", "apache 1 1", ("apache (?:software )?licen[sc]e(?: version| v)? 1 1", "apache 1 1")),
    ("apache-2.0", "apache 2 0", ("apache (?:software )?licen[sc]e(?: version| v)? (?:2 0|2|v2 0|v2)", "apache 2 0", "asl 2 0")),
    ("apache", "apache", ("apache (?:software )?licen[sc]e",)),
    ("agpl-3.0", "agpl 3 0(?: or later| only)?", ("gnu affero general public licen[sc]e(?: version| v)? (?:3 0|3)", "affero general public licen[sc]e(?: version| v)? (?:3 0|3)", "agpl(?: version| v)? (?:3 0|3)", "agplv3")),
    ("agpl", "agpl", ("gnu affero general public licen[sc]e", "affero general public licen[sc]e", "gnu agpl")),
    ("lgpl-2.1", "lgpl 2 1(?: or later| only)?", ("gnu (?:lesser|library) general public licen[sc]e(?: version| v)? 2 1", "lgpl(?: version| v)? 2 1", "lgplv2 1")),
    ("lgpl-3.0", "lgpl 3 0(?: or later| only)?", ("gnu lesser general public licen[sc]e(?: version| v)? (?:3 0|3)", "lgpl(?: version| v)? (?:3 0|3)", "lgplv3")),
    ("lgpl", "lgpl", ("gnu (?:lesser|library) general public licen[sc]e", "lesser general public licen[sc]e", "gnu lgpl")),
    ("gpl-1.0", "gpl 1 0(?: or later| only)?", ("gnu general public licen[sc]e(?: version| v)? (?:1 0|1)", "gpl(?: version| v)? 1 0")),
    ("gpl-2.0", "gpl 2 0(?: or later| only)?", ("gnu (?:general public licen[sc]e|gpl)(?: version| v)? (?:2 0|2|v2)", "gpl(?: version| v)? (?:2 0|2)", "gplv2", "general public licen[sc]e(?: version| v)? (?:2 0|2)")),
    ("gpl-3.0", "gpl 3 0(?: or later| only)?", ("gnu (?:general public licen[sc]e|gpl)(?: version| v)? (?:3 0|3|v3)", "gpl(?: version| v)? (?:3 0|3)", "gplv3", "general public licen[sc]e(?: version| v)? (?:3 0|3)")),
    ("gpl", "gpl", ("gnu general public licen[sc]e", "gnu gpl", "general public licen[sc]e")),
    ("gfdl-1.3", "gfdl 1 3(?: or later| only)?", ("gnu free documentation licen[sc]e(?: version| v)? 1 3", "gfdl 1 3")),
    ("gfdl", "gfdl 1 [12](?: or later| only)?", ("gnu free documentation licen[sc]e", "gnu fdl", "gfdl")),
    ("0bsd", "0bsd", ("bsd zero clause licen[sc]e", "zero clause bsd(?: licen[sc]e)?", "0bsd")),
    ("bsd-2-clause", "bsd 2 clause", ("bsd 2 clause(?: licen[sc]e)?", "2 clause bsd(?: licen[sc]e)?", "simplified bsd(?: licen[sc]e)?", "freebsd licen[sc]e")),
    ("bsd-3-clause", "bsd 3 clause", ("bsd 3 clause(?: licen[sc]e)?", "3 clause bsd(?: licen[sc]e)?", "new bsd(?: licen[sc]e)?", "modified bsd(?: licen[sc]e)?", "revised bsd(?: licen[sc]e)?")),
    ("bsd-4-clause", "bsd 4 clause", ("bsd 4 clause(?: licen[sc]e)?", "4 clause bsd(?: licen[sc]e)?", "original bsd(?: licen[sc]e)?")),
    ("bsd", "bsd", ("bsd(?: style)? licen[sc]e", "berkeley software distribution licen[sc]e")),
    ("mpl-1.1", "mpl 1 1", ("mozilla public licen[sc]e(?: version| v)? 1 1", "mpl(?: version| v)? 1 1")),
    ("mpl-2.0", "mpl 2 0", ("mozilla public licen[sc]e(?: version| v)? (?:2 0|2)", "mpl(?: version| v)? 2 0")),
    ("mpl", "mpl", ("mozilla public licen[sc]e",)),
    ("epl-1.0", "epl 1 0", ("eclipse public licen[sc]e(?: version| v)? (?:1 0|1)", "epl 1 0")),
    ("epl-2.0", "epl 2 0", ("eclipse public licen[sc]e(?: version| v)? (?:2 0|2)", "epl 2 0")),
    ("epl", "epl", ("eclipse public licen[sc]e",)),
    ("edl", "edl 1 0", ("eclipse distribution licen[sc]e",)),
    ("cddl-1.0", "cddl 1 0", ("common development and distribution licen[sc]e(?: version| v)? 1 0", "cddl 1 0")),
    ("cddl", "cddl 1 1", ("common development and distribution licen[sc]e", "cddl licen[sc]e")),
    ("cpl-1.0", "cpl 1 0", ("common public licen[sc]e",)),
    ("ipl-1.0", "ipl 1 0", ("ibm public licen[sc]e",)),
    ("eupl-1.2", "eupl 1 2", ("european union public licen[sc]e(?: version| v)? 1 2", "eupl 1 2")),
    ("eupl", "eupl 1 [01]", ("european union public licen[sc]e", "eupl")),
    ("isc", "isc", ("isc licen[sc]e", "internet systems consortium licen[sc]e")),
    ("artistic-1.0", "artistic 1 0(?: perl)?", ("artistic licen[sc]e(?: version| v)? 1 0",)),
    ("artistic-2.0", "artistic 2 0", ("artistic licen[sc]e(?: version| v)? (?:2 0|2)",)),
    ("artistic", "artistic", ("artistic licen[sc]e", "perl artistic licen[sc]e")),
    ("bsl-1.0", "bsl 1 0", ("boost software licen[sc]e(?: version 1 0| 1 0)?", "bsl 1 0")),
    ("busl-1.1", "busl 1 1", ("business source licen[sc]e(?: version)?(?: 1 1)?", "busl 1 1")),
    ("sspl-1.0", "sspl 1 0", ("server side public licen[sc]e", "sspl")),
    ("elastic-2.0", "elastic 2 0", ("elastic licen[sc]e(?: version)?(?: 2 0| 2)?",)),
    ("zlib", "zlib", ("zlib licen[sc]e", "zlib libpng licen[sc]e")),
    ("libpng", "libpng(?: 2 0)?", ("libpng licen[sc]e",)),
    ("unlicense", "unlicense", ("unlicense",)),
    ("wtfpl", "wtfpl", ("do what the f[a-z]* you want to public licen[sc]e", "wtfpl")),
    ("ms-pl", "ms pl", ("microsoft public licen[sc]e", "ms pl")),
    ("ms-rl", "ms rl", ("microsoft reciprocal licen[sc]e", "ms rl")),
    ("psf-2.0", "psf 2 0", ("python software foundation licen[sc]e(?: version 2| 2 0)?", "psf licen[sc]e")),
    ("python-2.0", "python 2 0", ("python licen[sc]e(?: 2 0)?",)),
    ("ruby", "ruby", ("ruby licen[sc]e",)),
    ("php-3.01", "php 3 01", ("php licen[sc]e(?: version| v)?(?: 3 01| 3 0)?",)),
    ("postgresql", "postgresql", ("postgresql licen[sc]e",)),
    ("openssl", "openssl", ("openssl licen[sc]e",)),
    ("curl", "curl", ("curl licen[sc]e",)),
    ("vim", "vim", ("vim licen[sc]e",)),
    ("ntp", "ntp", ("ntp licen[sc]e",)),
    ("ncsa", "ncsa", ("university of illinois ncsa open source licen[sc]e", "ncsa open source licen[sc]e")),
    ("w3c", "w3c", ("w3c software(?: notice and)? licen[sc]e", "w3c licen[sc]e")),
    ("afl-3.0", "afl 3 0", ("academic free licen[sc]e(?: version| v)?(?: 3 0)?",)),
    ("osl-3.0", "osl 3 0", ("open software licen[sc]e(?: version| v)?(?: 3 0)?",)),
    ("ofl-1.1", "ofl 1 1", ("sil open font licen[sc]e(?: version| v)?(?: 1 1)?", "open font licen[sc]e(?: 1 1)?")),
    ("odbl-1.0", "odbl 1 0", ("open database licen[sc]e", "open data commons open database licen[sc]e", "odbl")),
    ("odc-by-1.0", "odc by 1 0", ("open data commons attribution licen[sc]e", "odc by")),
    ("pddl-1.0", "pddl 1 0", ("open data commons public domain dedication and licen[sc]e", "pddl")),
    ("cecill-2.1", "cecill 2 1", ("cecill(?: free software licen[sc]e agreement)?(?: version| v)? 2 1",)),
    ("cecill", "cecill", ("cecill licen[sc]e", "cecill b", "cecill c")),
    ("upl-1.0", "upl 1 0", ("universal permissive licen[sc]e",)),
    ("qpl-1.0", "qpl 1 0", ("q public licen[sc]e",)),
    ("sleepycat", "sleepycat", ("sleepycat licen[sc]e",)),
    ("lppl-1.3c", "lppl 1 3c", ("latex project public licen[sc]e", "lppl")),
    ("openrail", "openrail", ("openrail(?: m)?(?: licen[sc]e)?", "responsible ai licen[sc]e")),
    ("llama", "llama[0-9]*", ("llama [0-9](?: [0-9])? community licen[sc]e",)),
    ("ogl-uk-3.0", "ogl uk 3 0", ("open government licen[sc]e(?: v3 0| version 3 0)?",)),
    ("cc0-1.0", "cc0 1 0", ("cc0(?: 1 0)?", "creative commons zero")),
)

#: The parts of Creative Commons licenses, words of the full name for each, and their versions.
CC_PARTS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s"}
CC_KINDS = ("by-nc-sa", "by-nc-nd", "by-sa", "by-nd", "by-nc", "by")
CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0", "")

#: Words that open notices, and the words up to the name.
NOTICES = ("licensed", "released", "distributed")
UNDER = "(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"

#: (label, address as words)
ADDRESSES = (
    ("mit", "opensource org licen[sc]es? mit(?: licen[sc]e)?(?: php)?"),
    ("bsd-3-clause", "opensource org licen[sc]es? bsd 3 clause"),
    ("bsd-2-clause", "opensource org licen[sc]es? bsd 2 clause"),
    ("apache-2.0", "apache org licen[sc]es licen[sc]e 2 0(?: txt| html)?"),
    ("gpl-3.0", "gnu org licen[sc]es gpl 3 0"),
    ("gpl-2.0", "gnu org licen[sc]es(?: old licen[sc]es)? gpl 2 0"),
    ("lgpl-3.0", "gnu org licen[sc]es lgpl 3 0"),
    ("agpl-3.0", "gnu org licen[sc]es agpl 3 0"),
    ("gpl", "gnu org licen[sc]es gpl"),
    ("mpl-2.0", "mozilla org mpl 2 0"),
    ("unlicense", "unlicense org"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"),
)

#: (label, opening words of the license's own text or of its customary notice)
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name of(?: [^ ]+){1,8} nor the names of its contributors may be used to endorse"),
    ("agpl", "program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("lgpl", "library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "program is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("gpl", "program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2.0", "source code form is subject to the terms of the mozilla public license v 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("zlib", "software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("ofl-1.1", "font software is licensed under the sil open font license"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("artistic", "intent of this document is to state the conditions under which a package may be copied"),
)

#: (label, weaker signs)
HINTS = (
    ("public-domain", "released into the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("public-domain", "public domain dedication"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized (?:copying|reproduction|use) (?:of this file )?is (?:strictly )?prohibited"),
    ("proprietary", "end user licen[sc]e agreement"),
    ("other", "open source licen[sc]e"),
    ("other", "creative commons licen[sc]e"),
    ("other", "source available licen[sc]e"),
)

#: Priority and weight of a form; the higher priority wins.
FORMS = {"tag": (6, 1.0), "text": (6, 1.0), "notice": (5, 0.95), "field": (4, 0.9), "address": (3, 0.85), "name": (2, 0.8), "hint": (1, 0.4)}


def _licenses() -> list[tuple[str, str, tuple[str, ...]]]:
    rows = list(LICENSES)
    for kind in CC_KINDS:
        short, full = kind.replace("-", " "), " ".join(CC_PARTS[part] for part in kind.split("-"))
        for version in CC_VERSIONS:
            words = f" {version.replace('.', ' ')}" if version else ""
            names = (f"cc {short}{words}", f"creative commons {full}(?: international| unported| licen[sc]e)*{words}")
            rows.append((f"cc-{kind}-{version}".rstrip("-"), f"cc {short}{words}", names))
    return rows


def _longest_word(pattern: str) -> str:
    """The longest plain word before the pattern's first group, or ''."""
    plain = [word for word in pattern.split("(")[0].split(" ")[:-1] if word.isalnum()]
    return max(plain, key=len, default="")


def rules() -> list[dict]:
    """All rules in order: label, form, priority, weight, keyword, needs (second keyword or ''), pattern."""
    found: list[tuple[str, str, str, str]] = [("text", label, words, "") for label, words in TEXTS]
    for label, tag, _ in _licenses():
        found.append(("tag", label, f"spdx licen[sc]e identifier {tag}", ""))
    for form, openings in (("notice", [f"{word} {UNDER}" for word in NOTICES]), ("field", ["licen[sc]e (?:is |under )?(?:the )?"])):
        for label, _, names in _licenses():
            for name in names:
                found += [(form, label, opening + name, name.split(" ")[0]) for opening in openings]
    found += [("address", label, words, "") for label, words in ADDRESSES]
    found += [("address", f"cc-{kind}-{v}", f"creativecommons org licen[sc]es {kind.replace('-', ' ')} {v.replace('.', ' ')}", "") for kind in CC_KINDS for v in CC_VERSIONS if v]
    found += [("name", label, name, "") for label, _, names in _licenses() for name in names]
    found += [("hint", label, words, "") for label, words in HINTS]
    out = []
    for form, label, pattern, needs in found:
        # "licen[sc]e" as an opening stands for two keywords
        opening = pattern.split(" ")[0]
        for keyword in ("license", "licence") if opening == "licen[sc]e" else (re.match("[a-z0-9]*", opening).group(),):
            rest = pattern[len(opening) :] if opening == "licen[sc]e" else pattern[len(keyword) :]
            second = re.match("[a-z0-9]*", needs).group() or _longest_word(rest)
            priority, weight = FORMS[form]
            out.append({"label": label, "form": form, "priority": priority, "weight": weight, "keyword": keyword, "needs": second, "pattern": f"^{keyword}{rest} "})
    return sorted(out, key=lambda rule: -rule["priority"])


def _rules_column() -> Column:
    """The rules by keyword, in order, as one constant map."""
    by_keyword: dict[str, list[dict]] = {}
    for rule in rules():
        by_keyword.setdefault(rule["keyword"], []).append({k: rule[k] for k in ("label", "priority", "weight", "needs", "pattern")})
    fields = "struct<label:string,priority:int,weight:double,needs:string,pattern:string>"
    return F.from_json(F.lit(json.dumps(by_keyword)), f"map<string,array<{fields}>>")


def words(text: Column) -> Column:
    """The lower-cased words. The Kelvin sign, the one character that lower() would turn into a letter of ASCII, stays apart."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with `n_words`, `base` (label and start of each base phrase) and `detections` (label, start, stop, weight).

    Starts and stops count words from 0, stops inclusive. The columns are replaced if the rows have some of these names.
    """
    keywords = sorted({rule["keyword"] for rule in rules()} | {phrase.split(" ")[0] for phrase, _ in BASE})
    window = lambda at: F.concat(F.array_join(F.slice("_words", at + 1, WIDTH), " "), F.lit(" "))
    gated = F.filter(
        F.transform("_words", lambda w, i: F.when(w.isin(keywords), F.struct(i.alias("start"), w.alias("keyword"), window(i).alias("here")))),
        lambda a: a.isNotNull(),
    )
    matching = lambda a: F.filter(F.element_at(_rules_column(), a["keyword"]), lambda r: F.contains(a["here"], r["needs"]) & F.rlike(a["here"], r["pattern"]))
    first = F.transform("_gated", lambda a: F.struct(a["start"].alias("start"), a["here"].alias("here"), F.get(matching(a), F.lit(0)).alias("rule")))
    length = lambda d: F.regexp_count(F.regexp_substr(d["here"], d["rule"]["pattern"]), F.lit(" "))
    spans = F.transform(
        F.filter(first, lambda d: d["rule"].isNotNull()),
        lambda d: F.struct(
            d["rule"]["label"].alias("label"), d["start"].alias("start"), (d["start"] + length(d) - 1).alias("stop"),
            d["rule"]["priority"].alias("priority"), d["rule"]["weight"].alias("weight"),
        ),
    )
    before = lambda k: F.slice("_spans", F.greatest(k - (WIDTH - 1), F.lit(0)) + 1, F.least(k, F.lit(WIDTH - 1)))
    covered = lambda d, k: F.exists(before(k), lambda e: (e["stop"] >= d["stop"]) & (e["priority"] >= d["priority"]))
    base_label = lambda a: F.coalesce(*(F.when(a["here"].startswith(phrase + " "), F.lit(label)) for phrase, label in BASE))
    base_found = F.filter(
        F.transform("_gated", lambda a: F.struct(base_label(a).alias("label"), a["start"].alias("start"))),
        lambda b: b["label"].isNotNull(),
    )
    kept = F.transform(
        F.filter("_spans", lambda d, k: ~covered(d, k)),
        lambda d: F.struct(d["label"].alias("label"), d["start"].alias("start"), d["stop"].alias("stop"), d["weight"].alias("weight")),
    )
    return (
        docs.withColumn("_words", words(F.col(text)))
        .withColumn("_gated", gated)
        .withColumn("_spans", spans)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("base", base_found)
        .withColumn("detections", kept)
        .drop("_words", "_gated", "_spans")
    )


def license_digest(docs: DataFrame) -> DataFrame:
    """One row a document: counts, places of the base phrases, labels and score (the highest weight of its detections)."""
    found = scan(docs.select("doc_id", "text"))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"),
        F.array_max("base.start").cast("long").alias("last_word"),
        listed(F.col("base.label")).alias("base_labels"),
        listed(F.concat("base.label", "detections.label")).alias("labels"),
        F.coalesce(F.array_max("detections.weight"), F.lit(0.0)).alias("score"),
        F.array_join(
            F.transform("detections", lambda d: F.concat_ws(":", d["label"], d["start"].cast("string"), d["stop"].cast("string"))), ","
        ).alias("spans"),
    )


def oracle_sql() -> str:
    """The digest in SQL: every gated word meets every rule of its keyword, then the contained ones go."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    ordered = rules()
    values = ", ".join(f"({n}, {quoted(r['keyword'])}, {quoted(r['label'])}, {r['priority']}, {r['weight']}::double, {quoted(r['pattern'])})" for n, r in enumerate(ordered))
    keywords = ", ".join(sorted({quoted(r["keyword"]) for r in ordered} | {quoted(p.split(" ")[0]) for p, _ in BASE}))
    phrases = ", ".join(f"({quoted(p + ' ')}, {quoted(label)})" for p, label in BASE)
    return f"""
with rules(n, keyword, label, priority, weight, pattern) as (values {values}),
phrases(phrase, label) as (values {phrases}),
docs as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws
  from documents
), places as (select r, ws, unnest(range(1, len(ws) + 1)) as i from docs),
gated as (
  select r, i - 1 as start, ws[i] as keyword, array_to_string(ws[i:i + {WIDTH - 1}], ' ') || ' ' as here
  from places where ws[i] in ({keywords})
), base as (select r, start, label from gated, phrases where starts_with(here, phrase)),
firsts as (
  select r, start, label, priority, weight,
    start + len(string_split(regexp_extract(here, pattern), ' ')) - 2 as stop
  from gated join rules using (keyword) where regexp_matches(here, pattern)
  qualify row_number() over (partition by r, start order by n) = 1
), kept as (
  select * from firsts d where not exists (
    select 1 from firsts e where e.r = d.r and e.start < d.start and e.stop >= d.stop and e.priority >= d.priority)
), of_base as (
  select r, count(*) as n_base, min(start) as first_word, max(start) as last_word, string_agg(distinct label, ',' order by label) as base_labels
  from base group by r
), of_kept as (
  select r, max(weight) as score, string_agg(label || ':' || start || ':' || stop, ',' order by start) as spans from kept group by r
), of_all as (
  select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from base union all select r, label from kept) group by r
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score, coalesce(spans, '') as spans
from docs left join of_base using (r) left join of_kept using (r) left join of_all using (r)
"""
