"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, which are normalised and looked up, by equality, among known licence
sentences; the identifiers in order of appearance are matched against ordered licence rules.
A rule is a sequence of identifiers that are to follow each other; the first rule that is
found names a licence and takes its identifiers away, so that the next rules see the rest.

There are three lookups, tried in this order: the whole normalised sentence; its first ``HEAD``
words, as long sentences end in many ways; and what is left of it without a phrase like
``licensed under the`` and words like ``version``, among the names that licences go by.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a sentence that are looked up where the whole is not known.
HEAD = 12
#: Identifiers of whole normalised sentences.
WHOLE = {
    "all rights reserved": "all_rights",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zero_grant",
    "this is free and unencumbered software released into the public domain": "unlicense_domain",
    "this software is provided as-is without any express or implied warranty": "zlib_asis",
    "this work is in the public domain": "public_domain",
    "this software is in the public domain": "public_domain",
    "released into the public domain": "public_domain",
    "dedicated to the public domain": "public_domain",
    "you just do what the fuck you want to": "wtfpl_do",
    "0 you just do what the fuck you want to": "wtfpl_do",
}
#: Identifiers by the first words of normalised sentences.
HEADS = {
    "permission is hereby granted free of charge to any person obtaining a": "mit_grant",
    "the above copyright notice and this permission notice shall be included in": "mit_notice",
    "the software is provided as is without warranty of any kind express": "mit_asis",
    "permission to use copy modify and or distribute this software for any": "isc_grant",
    "the software is provided as is and the author disclaims all warranties": "isc_asis",
    "redistribution and use in source and binary forms with or without modification": "bsd_redist",
    "redistributions of source code must retain the above copyright notice this list": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list": "bsd_binary",
    "all advertising materials mentioning features or use of this software must display": "bsd_advert",
    "neither the name of holder nor the names of its contributors may": "bsd_endorse",
    "this software is provided by the copyright holders and contributors as is": "bsd_asis",
    "you may not use this file except in compliance with the license": "apache2_comply",
    "unless required by applicable law or agreed to in writing software distributed": "apache2_asis",
    "this program is distributed in the hope that it will be useful": "gnu_hope",
    "this library is distributed in the hope that it will be useful": "gnu_hope",
    "this source code form is subject to the terms of the mozilla": "mpl2_form",
    "the contents of this file are subject to the mozilla public license": "mpl1_contents",
    "the contents of this file are subject to the terms of the": "cddl_contents",
    "anyone is free to copy modify publish use compile sell or distribute": "unlicense_free",
    "permission is granted to anyone to use this software for any purpose": "zlib_grant",
    "permission is hereby granted free of charge to any person or organization": "boost_grant",
    "everyone is permitted to copy and distribute verbatim or modified copies of": "wtfpl_copies",
}


def _gnu(short: str, long: str, version: str) -> list[str]:
    brief = version.removesuffix(" 0")
    plain = [f"{x} {v}" for x in (short, f"gnu {short}", long, f"gnu {long}") for v in {version, brief}]
    return [*plain, f"{short}v{brief}", f"gnu {short}v{brief}", *(f"{short}-{version}{x}" for x in ("", "-only", "-or-later"))]


_CC = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
#: Names of licences, normalised and without words that names do with or without; families by a rule.
NAMES = {
    "MIT": ["mit", "expat"],
    "MIT-0": ["mit-0", "mit no attribution"],
    "ISC": ["isc"],
    "0BSD": ["0bsd", "zero-clause bsd"],
    "BSD-2-Clause": ["bsd-2-clause", "2-clause bsd", "simplified bsd", "freebsd"],
    "BSD-3-Clause": ["bsd-3-clause", "3-clause bsd", "new bsd", "modified bsd", "revised bsd"],
    "BSD-4-Clause": ["bsd-4-clause", "4-clause bsd", "original bsd"],
    "Apache-2.0": ["apache 2 0", "apache 2", "apache-2 0", "asl 2 0"],
    "MPL-1.1": ["mozilla public 1 1", "mpl 1 1", "mpl-1 1"],
    "MPL-2.0": ["mozilla public 2 0", "mpl 2 0", "mpl-2 0"],
    "EPL-1.0": ["eclipse public 1 0", "epl 1 0", "epl-1 0"],
    "EPL-2.0": ["eclipse public 2 0", "epl 2 0", "epl-2 0"],
    "EUPL-1.2": ["european union public 1 2", "eupl 1 2", "eupl-1 2"],
    "CDDL-1.0": ["common development and distribution 1 0", "cddl 1 0", "cddl-1 0"],
    "Artistic-2.0": ["artistic 2 0", "artistic-2 0"],
    "BSL-1.0": ["boost software 1 0", "bsl-1 0"],
    "OFL-1.1": ["sil open font 1 1", "ofl 1 1", "ofl-1 1"],
    "PSF-2.0": ["python software foundation", "python software foundation 2", "psf-2 0"],
    "Zlib": ["zlib"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc0-1 0", "creative commons zero 1 0"],
    **{f"{s.upper()}-{v}": _gnu(s, x, v.replace(".", " ")) for s, x, vs in (("gpl", "general public", ("2.0", "3.0")), ("lgpl", "lesser general public", ("2.1", "3.0")), ("agpl", "affero general public", ("3.0",))) for v in vs},
    **{
        f"CC-{k.upper()}-{v}": [f"{x} {v.replace('.', ' ')}" for x in (f"cc {k}", f"creative commons {'-'.join(_CC[p] for p in k.split('-'))}")] + [f"cc-{k}-{v.replace('.', ' ')}"]
        for k in ("by", "by-sa", "by-nc", "by-nc-sa", "by-nd", "by-nc-nd") for v in ("3.0", "4.0")
    },
}
#: Sentences that say which licence only far from their start: a pattern and the name in normal form that it is replaced by.
TOLD = (
    (r"neither the name of .{1,200} nor the ", "neither the name of holder nor the "),
    (r"^this [a-z]+ is free software you can redistribute it and or modify it under the terms of the gnu ((?:lesser |affero )?general public) licen[sc]e .*version ([0-9](?: [0-9])?) .*$", "@free gnu @1 @2"),
    (r"^this program and the accompanying materials are (?:made available|licensed) under the terms of the (eclipse public) licen[sc]e (?:version |v ?)?([12]) 0.*$", "@1 @2 0"),
)
#: Ordered rules: the licence and the identifiers that are to follow each other.  Longer rules come first.
RULES = (
    ("BSD-4-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_advert", "bsd_endorse", "bsd_asis")),
    ("BSD-3-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_asis")),
    ("BSD-2-Clause", ("bsd_redist", "bsd_source", "bsd_binary", "bsd_asis")),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("MIT-0", ("mit_grant", "mit_asis")),
    ("ISC", ("isc_grant", "isc_asis")),
    ("0BSD", ("zero_grant", "isc_asis")),
    ("Apache-2.0", ("Apache-2.0", "apache2_comply", "apache2_asis")),
    ("Zlib", ("zlib_asis", "zlib_grant")),
    ("Unlicense", ("unlicense_domain", "unlicense_free")),
    ("WTFPL", ("wtfpl_copies", "wtfpl_do")),
    *((x, (f"free_{x}", "gnu_hope")) for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")),
)
#: Rules of one identifier come last, in the order in which a text has them.  A licence's name is one.
SINGLE = {
    **{x: x for x in NAMES},
    **{f"free_{x}": x for x in NAMES if "GPL" in x},
    "mpl2_form": "MPL-2.0", "mpl1_contents": "MPL-1.1", "boost_grant": "BSL-1.0", "unlicense_domain": "Unlicense", "wtfpl_do": "WTFPL", "public_domain": "Public-domain", "all_rights": "All-rights-reserved",
}
#: A text without any of these has no licence sentence; a sentence without one is none.
CUES = (
    r"(?i)licen[sc]e|(?:released|distributed|available) under|permission|redistribut|in compliance|all rights reserved|as[ -]is|in the hope that|endorse|applicable law|public domain"
    r"|advertising materials|source code form|contents of this file|accompanying materials|free to copy|permitted to copy|just do what"
)
#: What comments put around the text of a line.
MARKS = r"^[\x20\x09]*(?://+|/\*+|\*+/?|#+|--+|;+|%+|>+|<!--)?[\x20\x09]*|[\x20\x09]*(?:\*+/|-->)?[\x20\x09]*$"
#: Sentences end at a full stop, question or exclamation mark before white space, and at blank lines.
STOP, BLANK = r"([.!?])[\x20\x09\n]+", r"\n{2,}"
#: Parts of a sentence: clauses, and the sides of a licence expression.
PARTS = r";\x20+|\x20(?:OR|AND)\x20"
DROPPED, SPACED = r"[\"'`*#()\[\]<>{}\x{201C}\x{201D}\x{2018}\x{2019}]+", r"[.,:;!?/\x20\x09-\x0D]+"
PHRASE = (
    r"^(?:(?:this|the) (?:[a-z-]+ ){1,3}(?:is|are) )?(?:dual[ -])?(?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?"
    r"|^spdx-license-identifier "
)
TAIL = r" (?:(?:see|as published|a copy|or any later|or at your option|or later|only)(?: .*)?|the license)$"
FILLER = r" (?:the|license|licence|version|international|unported|universal|generic) "


def lookup() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Whole sentences, first words and names, each with its identifier."""
    names = {alias: x for x, aliases in NAMES.items() for alias in aliases}
    free = {f"@free {alias}": f"free_{names[alias]}" for alias in names if alias.startswith("gnu ") and "general public" in alias}
    return WHOLE | free, HEADS, names


def normalise(sentence: Column) -> Column:
    """Lower case; quotes, brackets and comment marks dropped; punctuation and white space as one space; what ``TOLD`` tells in short."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), DROPPED, ""), SPACED, " "))
    for pattern, told in TOLD:
        s = F.regexp_replace(s, pattern, told.replace("@1", "$1").replace("@2", "$2"))
    return s


def _name(s: Column) -> Column:
    """A normalised sentence without the words that say that, and not under what, something is licensed."""
    s = F.regexp_replace(F.regexp_replace(s, PHRASE, ""), TAIL, "")
    s = F.regexp_replace(F.concat(F.lit(" "), F.replace(s, F.lit(" "), F.lit("  ")), F.lit(" ")), FILLER, "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, " +", " "), " v ?([0-9])", " $1"))


def identifiers(text: Column) -> Column:
    """The identifiers of the licence sentences of a text in their order; unknown sentences give none.

    Lines of a paragraph, without comment marks, are joined, and its sentences are tried as they then are.  A sentence
    that is known so is one; of any other, its parts or its lines are tried, whichever tell more.
    """
    tables = [F.create_map(*map(F.lit, chain(*t.items()))) for t in lookup()]

    def ident(s: Column) -> Column:
        head = F.array_join(F.slice(F.split(s, " "), 1, HEAD), " ")
        return F.coalesce(F.try_element_at(tables[0], s), F.try_element_at(tables[1], head), F.try_element_at(tables[2], _name(s)))

    def named(cut: Column) -> Column:
        return F.filter(F.transform(F.transform(cut, normalise), ident), lambda x: x.isNotNull())

    def sentence(s: Column) -> Column:
        joined = F.regexp_replace(s, "\n", " ")
        whole, parts, lines = named(F.array(joined)), named(F.split(joined, PARTS)), named(F.split(s, "\n"))
        return F.when(F.size(whole) > 0, whole).when(F.size(parts) > F.size(lines), parts).otherwise(lines)

    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), f"(?md){MARKS}", "")
    cut = F.split(F.regexp_replace(F.regexp_replace(plain, BLANK, "\x01"), STOP, "$1\x01"), "\x01")
    return F.flatten(F.transform(F.filter(cut, lambda s: s.rlike(CUES)), sentence))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sentences, licenses, unmatched)``, a row for each row of ``docs``.

    ``sentences`` joins the identifiers by commas, ``licenses`` the licences by the order of
    the rules, each once; ``unmatched`` counts identifiers that no rule took.  A null text is as an empty
    one: two empty strings and 0.  Null ids and repeated rows stay; nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(text.rlike(CUES), identifiers(text)).otherwise(none).alias("ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f",{s}," for s in sequence)).alias("ids")) for name, sequence in RULES])
    state = F.struct(F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")).alias("rest"), none.alias("found"))

    def step(s: Column, rule: Column) -> Column:
        rest = F.replace(s["rest"], rule["ids"], F.lit("|"))
        return F.struct(rest.alias("rest"), F.when(rest != s["rest"], F.concat(s["found"], F.array(rule["name"]))).otherwise(s["found"]).alias("found"))

    rows = rows.withColumn("s", F.when(F.size("ids") > 0, F.aggregate(rules, state, step)).otherwise(F.struct(F.lit("").alias("rest"), none.alias("found"))))
    rows = rows.withColumn("left", F.filter(F.split("s.rest", "[,|]+"), lambda x: x != ""))
    table = F.create_map(*map(F.lit, chain(*SINGLE.items())))
    single = F.transform("left", lambda x: F.try_element_at(table, x))
    return rows.select(
        "doc_id",
        F.array_join("ids", ",").alias("sentences"),
        F.array_join(F.array_distinct(F.concat("s.found", F.array_compact(single))), ",").alias("licenses"),
        (F.size("left") - F.size(F.array_compact(single))).cast("long").alias("unmatched"),
    )
