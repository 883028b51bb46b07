"""License scans by sentence rules.

Known licence sentences are looked up in the normalised sentences of a text; what is known becomes a sequence of identifiers. Ordered rules
then match the sequence: the first rule that matches somewhere takes those identifiers away, and the rest is matched on.
All of it is built from Spark's own functions, on each text by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences, or their openings, after normalisation (lower case, letters and digits, single spaces), and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheGrant",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing": "ApacheAsIs",
    "released under the mit license": "MITName",
    "licensed under the mit license": "MITName",
    "permission is hereby granted free of charge to any person obtaining a copy": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies": "MITNotice",
    "the software is provided as is without warranty of any kind": "MITAsIs",
    "redistribution and use in source and binary forms with or without modification are permitted": "BSDGrant",
    "redistributions of source code must retain the above copyright notice": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice": "BSDBinary",
    "neither the name of": "BSDEndorse",
    "this software is provided by the copyright holders and contributors as is": "BSDAsIs",
    "this work is licensed under the gnu general public license version 3": "GPL3Name",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "GPLGrant",
    "either version 2 of the license or at your option any later version": "GPL2Later",
    "either version 3 of the license or at your option any later version": "GPL3Later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "LGPLGrant",
    "licensed under cc by nc 4 0": "CCBYNC4",
    "licensed under cc by sa 4 0": "CCBYSA4",
    "licensed under cc by 4 0": "CCBY4",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2",
    "all rights reserved": "AllRights",
}

# Ordered rules: identifiers that follow one another, and the licence they stand for. Longer sequences come first.
RULES = [
    (("ApacheGrant", "ApacheComply", "ApacheCopy", "ApacheAsIs"), "Apache-2.0"),
    (("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs"), "BSD-3-Clause"),
    (("BSDGrant", "BSDSource", "BSDBinary", "BSDAsIs"), "BSD-2-Clause"),
    (("MITGrant", "MITNotice", "MITAsIs"), "MIT"),
    (("GPLGrant", "GPL3Later"), "GPL-3.0-or-later"),
    (("GPLGrant", "GPL2Later"), "GPL-2.0-or-later"),
    (("LGPLGrant",), "LGPL"),
    (("ApacheGrant",), "Apache-2.0"),
    (("MITName",), "MIT"),
    (("MITGrant",), "MIT"),
    (("GPL3Name",), "GPL-3.0"),
    (("GPLGrant",), "GPL"),
    (("CCBYNC4",), "CC-BY-NC-4.0"),
    (("CCBYSA4",), "CC-BY-SA-4.0"),
    (("CCBY4",), "CC-BY-4.0"),
    (("MPL2",), "MPL-2.0"),
    (("AllRights",), "proprietary"),
]

# A sentence ends at . ! ? before white space or the end of the text, but not after "v" ("v. 2.0"), and at a line without letters or digits,
# which may hold comment signs. Other line ends, colons and semicolons do not end it: notices are wrapped, and known sentences go over them.
ENDS = r"(?<!\b[vV])[.!?]+(?:[ \t\n\r\f]|$)|\n(?:[^\p{L}\p{N}\n]*(?:\n|$))+"
NEGATIONS = ("not", "never", "no longer")       # a known sentence right after one of these is not said


def normalised(sentence: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(sentence, "[^A-Za-z0-9]+", " ")))


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The sequence of known sentences of a text, in its order. One of ``sentences`` is known wherever it stands as whole words inside a
    sentence of the text, unless one of ``NEGATIONS`` is right before it; of those that begin at one word the longest counts."""
    longest = sorted(sentences, key=lambda s: (-len(s), s))
    pattern = "(?:^|(?<= ))" + "".join(rf"(?<!\b{n} )" for n in NEGATIONS) + "(" + "|".join(longest) + ")(?= |$)"
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    said = F.flatten(F.transform(F.split(text, ENDS), lambda s: F.regexp_extract_all(normalised(s), F.lit(pattern), F.lit(1))))
    return F.transform(said, lambda s: F.element_at(known, s))


def matched(sequence: Column, rules: list = RULES) -> tuple[Column, Column]:
    """(licences in the order of the rules, identifiers no rule took) of a sequence of identifiers."""
    rest = F.concat(F.lit(" "), F.array_join(sequence, "  "), F.lit(" "))
    found = []
    for ids, name in rules:
        run = " " + "  ".join(ids) + " "
        found.append(F.when(F.contains(rest, F.lit(run)), F.lit(name)))
        rest = F.replace(rest, F.lit(run), F.lit(" | "))
    return F.array_distinct(F.array_compact(F.array(*found))), rest


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_ids, licenses, n_known) for every row: known sentences in their order and the licences, in the order of the rules,
    each comma-joined. Null and empty texts have neither. Repeated rows get a result each; a null id stays null."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (docs.select(F.col(id_col).alias("id"), identifiers(text, sentences).alias("found"))
            .select("id", "found", matched(F.col("found"), rules)[0].alias("names"))
            .select(F.col("id").alias(id_col), F.array_join("found", ",").alias("sentence_ids"), F.array_join("names", ",").alias("licenses"),
                    F.size("found").cast("bigint").alias("n_known")))
