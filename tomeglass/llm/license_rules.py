"""Licences by rules over sequences of known sentences; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sentences of well-known licences and notices, as they read once normalised.
SENTENCES = {
    "mit-named": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "license mit", "spdx license identifier mit"),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit-as-is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "isc-named": ("licensed under the isc license", "released under the isc license", "spdx license identifier isc"),
    "apache-2-named": (
        "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0",
        "this project is licensed under the apache license 2 0", "spdx license identifier apache 2 0",
    ),
    "apache-comply": ("you may not use this file except in compliance with the license",),
    "apache-copy": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"),
    "bsd-redistribute": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bsd-endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd-3-named": ("licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "spdx license identifier bsd 3 clause"),
    "bsd-2-named": ("licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "spdx license identifier bsd 2 clause"),
    "gpl-free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "gpl-2-free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ),
    "gpl-hope": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gpl-3-named": (
        "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3", "spdx license identifier gpl 3 0 only",
    ),
    "gpl-2-named": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "spdx license identifier gpl 2 0 only"),
    "lgpl-3-named": ("this work is licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 3"),
    "agpl-3-named": ("this work is licensed under the gnu affero general public license version 3", "licensed under the gnu affero general public license version 3"),
    "mpl-2-named": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"),
    "cc-by": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-nd": ("licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    "cc-by-nc-sa": ("licensed under cc by nc sa 4 0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    "cc-by-nc-nd": ("licensed under cc by nc nd 4 0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    "cc0": ("licensed under cc0 1 0", "this work is licensed under cc0 1 0 universal", "this work has been dedicated to the public domain"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "reserved": ("all rights reserved",),
}

# Rules by family, in order: the first whose sentences occur in this order, with anything in between, names the licence.
RULES = (
    ("MIT", (("MIT", ("mit-grant", "mit-notice", "mit-as-is")), ("MIT", ("mit-grant", "mit-notice")), ("MIT", ("mit-named",)))),
    ("ISC", (("ISC", ("isc-grant",)), ("ISC", ("isc-named",)))),
    ("Apache", (("Apache-2.0", ("apache-2-named", "apache-comply", "apache-copy")), ("Apache-2.0", ("apache-2-named",)))),
    (
        "BSD",
        (
            ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
            ("BSD-3-Clause", ("bsd-3-named",)), ("BSD-2-Clause", ("bsd-2-named",)),
        ),
    ),
    (
        "GPL",
        (
            ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")), ("GPL-3.0-or-later", ("gpl-free",)), ("GPL-2.0-or-later", ("gpl-2-free",)),
            ("AGPL-3.0", ("agpl-3-named",)), ("LGPL-3.0", ("lgpl-3-named",)), ("GPL-3.0", ("gpl-3-named",)), ("GPL-2.0", ("gpl-2-named",)),
        ),
    ),
    ("MPL", (("MPL-2.0", ("mpl-2-named",)),)),
    (
        "CC",
        (
            ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)), ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)), ("CC-BY-NC-4.0", ("cc-by-nc",)), ("CC-BY-ND-4.0", ("cc-by-nd",)),
            ("CC-BY-SA-4.0", ("cc-by-sa",)), ("CC-BY-4.0", ("cc-by",)), ("CC0-1.0", ("cc0",)),
        ),
    ),
    ("Unlicense", (("Unlicense", ("unlicense",)),)),
    ("Reserved", (("All-Rights-Reserved", ("reserved",)),)),
)

IDENTIFIER = {sentence: name for name, forms in SENTENCES.items() for sentence in forms}
SOFT, HARD = "\x01", "\x02"


def in_order(sentences: tuple[str, ...]) -> str:
    """A pattern over identifiers, each between two blanks: these ones in this order, anything in between."""
    return ".*".join(f" {s} " for s in sentences)


def marked(text: Column) -> Column:
    """Words in lower case between single marks: a blank, SOFT for the end of a sentence or line, HARD for that of a paragraph."""
    plain = F.translate(text, UPPER + SOFT + HARD, LOWER + "--")
    ended = F.regexp_replace(F.regexp_replace(plain, "\r\n", "\n"), r"[.!?:;]+([ \t\r\n])", SOFT + "$1")
    words = F.regexp_replace(F.concat(F.lit("\n"), ended, F.lit("\n")), rf"[^a-z0-9{SOFT}\n]+", " ")
    # Single blanks, then single soft ends, then line breaks without either beside them; lines without words end a paragraph.
    joined = F.regexp_replace(F.regexp_replace(words, rf"[ {SOFT}]{{2,}}", SOFT), rf"[ {SOFT}]?\n[ {SOFT}]?", "\n")
    return F.translate(F.regexp_replace(joined, "\n{2,}", HARD), "\n", SOFT)


def known_sentence() -> str:
    """A pattern for any known sentence from mark to mark, whatever ends of lines and sentences it holds."""
    forms = "|".join(s.replace(" ", f"[ {SOFT}]") for s in sorted(IDENTIFIER, key=len, reverse=True))
    return f"(?<=[{SOFT}{HARD}])({forms})(?=[{SOFT}{HARD}])"


def find_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses) for every row of ``docs`` (doc_id, text).

    ``sentence_ids`` are the identifiers of the known sentences in order of the text, with repeats; ``licenses`` holds the
    licence of the first matching rule of each family, in order of the families. Sentences end at a line break, or at a
    stop, colon or semicolon before white space; a known sentence may run over such ends, as wrapped texts do, but not over
    a line without words. A missing text has none of either. Rows that repeat or lack a doc_id are read like any other;
    other columns are ignored. Nothing is shuffled.
    """
    known = F.regexp_extract_all(marked(F.coalesce("text", F.lit(""))), F.lit(known_sentence()), F.lit(1))
    known = F.transform(known, lambda s: F.translate(s, SOFT, " "))
    names = F.create_map(*(F.lit(x) for pair in IDENTIFIER.items() for x in pair))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.transform(known, lambda s: F.element_at(names, s)).alias("sentence_ids"))
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    families = []
    for _, rules in RULES:
        first = F.lit(None).cast("string")
        for name, needed in reversed(rules):
            first = F.when(line.rlike(in_order(needed)), F.lit(name)).otherwise(first)
        families.append(first)
    licenses = F.when(F.size("sentence_ids") > 0, F.array_compact(F.array(*families))).otherwise(F.array().cast("array<string>"))
    return found.select("doc_id", "sentence_ids", licenses.alias("licenses"))
