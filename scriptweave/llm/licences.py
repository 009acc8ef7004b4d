"""Licence scan by sentence rules, in DataFrame operations.

A text is cut into sentences, at full stops and the like and, read a second time, at line ends too, for
licence texts run over lines while notices are lines of their own. A sentence is lower-cased and all but
letters and digits become single blanks; known licence sentences have identifiers. What a text has of
them, in order, is matched against rules, ordered runs of identifiers; of two rules of which one
contains the other only the longer counts.

A rule begins with a known sentence, and each of those has one of a few words, so texts without any are not
cut and have no identifiers at all. Null and empty texts have no licence. Repeated rows get the same result each.
Further columns are carried along; a result replaces a column of its name.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Sentences of well-known licences and notices, by identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "mit-condition": """The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "isc-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": """Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute": """you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "agpl3-redistribute": """you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "lgpl3-redistribute": """you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "lgpl21-redistribute": """you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "gpl2-published": """you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation;""",
    "gpl2-later": "either version 2 of the License, or (at your option) any later version.",
    "bsd-redistribute": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met:""",
    "bsd-source": """Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.""",
    "bsd-binary": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd-endorse": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-public": "This is free and unencumbered software released into the public domain.",
    "zero-bsd-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted.""",
    "zlib-grant": """Permission is granted to anyone to use this software for any purpose, including commercial applications,
        and to alter it and redistribute it freely, subject to the following restrictions:""",
    "boost-grant": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following:""",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}
# The licence each run of sentences means.
RULES = [
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-header", "apache-compliance"]),
    ("Apache-2.0", ["apache-header", "apache-compliance", "apache-copy", "apache-as-is"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0-or-later", ["gpl-redistribute"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute"]),
    ("GPL-2.0-or-later", ["gpl2-published", "gpl2-later"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("Unlicense", ["unlicense-public"]),
    ("0BSD", ["zero-bsd-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
]
MOST_ENTRIES = 2_000
STOP = r"[.!?:;]+(?:\s+|\z)"
LINE = r"|\n"
PARAGRAPH = r"|\n[ \t\r]*\n"
NOT_WORD = r"[^\p{L}\p{N}]+"


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def pieces(text: str) -> list[str]:
    """Normal forms of the sentences that the scan, reading over line ends, cuts a text into."""
    found = [normal(x) for x in re.split((STOP + PARAGRAPH).replace(r"\z", r"\Z"), text)]
    return [x for x in found if x]


@dataclass(frozen=True)
class Rulebook:
    """Known texts by identifier, and the licences that ordered runs of them mean.

    A known text is cut as the scan cuts: its first sentence has its identifier, the others that
    with a number behind it. Texts that share a sentence share its identifier, the first one's.
    """

    sentences: dict[str, str]
    rules: list[tuple[str, list[str]]]

    def __post_init__(self):
        if max(len(self.sentences), len(self.rules)) > MOST_ENTRIES:
            raise ValueError(f"more than {MOST_ENTRIES} known texts or rules")

    def identifiers(self) -> dict[str, str]:
        """Identifiers by normal form."""
        known: dict[str, str] = {}
        for key, text in self.sentences.items():
            for i, piece in enumerate(pieces(text), 1):
                known.setdefault(piece, key if i == 1 else f"{key}.{i}")
        return known

    def runs(self) -> list[tuple[str, str, list[str]]]:
        """Each rule's licence, its identifiers with commas around each, and those of longer rules that contain it."""
        known = self.identifiers()
        runs = [(name, "," + ",".join(known[p] for key in rule for p in pieces(self.sentences[key])) + ",") for name, rule in self.rules]
        return [(name, run, [other for _, other in runs if len(other) > len(run) and run in other]) for name, run in runs]

    def stems(self) -> list[str]:
        """Words of which each first sentence of a rule has one: those that most of the others have, first."""
        known = {key: identifier for identifier, key in self.identifiers().items()}
        left = [set(known[run.split(",")[1]].split()) for _, run, _ in self.runs()]
        found = []
        while left:
            counts = Counter(word for words in left for word in sorted(words, key=lambda w: (-len(w), w))[:4])
            found.append(min(counts, key=lambda w: (-counts[w], w)))
            left = [words for words in left if found[-1] not in words]
        return found


BUILT_IN = Rulebook(SENTENCES, RULES)


def read_rulebook(spark: SparkSession, sentences: str, rules: str) -> Rulebook:
    """From JSON lines: (id, text) and (licence, ids in order); more than ``MOST_ENTRIES`` of either are refused."""
    texts = spark.read.schema("id string, text string").json(sentences).orderBy("id").limit(MOST_ENTRIES + 1).collect()
    rows = spark.read.schema("licence string, ids array<string>").json(rules).limit(MOST_ENTRIES + 1).collect()
    return Rulebook({r["id"]: r["text"] for r in texts}, [(r["licence"], list(r["ids"])) for r in rows])


def _sequence(text: Column, cut: str, rulebook: Rulebook) -> Column:
    """Identifiers of the known sentences in order, with commas around each."""
    known = F.create_map(*[F.lit(x) for pair in rulebook.identifiers().items() for x in pair])
    sentences = F.transform(F.split(text, cut), lambda s: F.get(F.array(F.trim(F.regexp_replace(F.lower(s), NOT_WORD, " "))), F.lit(0)))
    found = F.filter(F.transform(sentences, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())
    return F.concat(F.lit(","), F.array_join(found, ","), F.lit(","))


def scanned(
    documents: DataFrame, text: str = "text", keep: list[str] | None = None, rulebook: Rulebook = BUILT_IN
) -> DataFrame:
    """Adds sentence_ids (those of the reading by lines, then those only the other has; comma-joined)
    and licences (sorted, comma-joined; empty where there are none).

    ``keep`` names the columns to carry (default: all). Nothing is shuffled.
    """
    keep = [c for c in (documents.columns if keep is None else keep) if c.lower() not in ("sentence_ids", "licences")]
    whole = F.col("_text")
    some = whole.rlike("(?i)" + "|".join(rulebook.stems()))
    rows = documents.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("_text"))
    for name, cut in (("_lines", STOP + LINE), ("_sentences", STOP + PARAGRAPH)):
        # made once, though many rules look at it
        made = F.struct(F.when(some, _sequence(whole, cut, rulebook)).otherwise(",,").alias(name))
        rows = rows.select("*", F.inline_outer(F.array(made)))
    licences = []
    for licence, run, longer in rulebook.runs():
        tests = []
        for name in ("_lines", "_sentences"):
            test = F.col(name).contains(run)
            for other in longer:
                test = test & ~F.col(name).contains(other)
            tests.append(test)
        licences.append(F.when(tests[0] | tests[1], F.lit(licence)))
    found = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*licences)))), ",")
    ids = [F.filter(F.split(name, ","), lambda x: x != "") for name in ("_lines", "_sentences")]
    ids = F.array_join(F.concat(ids[0], F.array_except(ids[1], ids[0])), ",")
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], ids.alias("sentence_ids"), found.alias("licences"))


def oracle() -> str:
    """The same over ``documents`` as DuckDB SQL."""
    known = "map {" + ", ".join(f"'{text}': '{key}'" for text, key in BUILT_IN.identifiers().items()) + "}"

    def sequence(cut: str) -> str:
        sentence = f"trim(regexp_replace(lower(s), '{NOT_WORD}', ' ', 'g'))"
        sentences = f"list_transform(string_split_regex(text, '{cut}'), lambda s: {sentence})"
        return f"coalesce(list_filter(list_transform({sentences}, lambda s: {known}[s]), lambda x: x IS NOT NULL), [])"

    tests = []
    for licence, run, longer in BUILT_IN.runs():
        sides = []
        for name in ("a", "b"):
            test = f"contains({name}s, '{run}')"
            for other in longer:
                test += f" AND NOT contains({name}s, '{other}')"
            sides.append(f"({test})")
        tests.append(f"CASE WHEN {' OR '.join(sides)} THEN '{licence}' END")
    return f"""
        WITH t AS (SELECT doc_id, CASE WHEN worded THEN {sequence(STOP + LINE)} ELSE [] END AS a,
            CASE WHEN worded THEN {sequence(STOP + PARAGRAPH)} ELSE [] END AS b
            FROM (SELECT *, regexp_matches(text, '(?i){'|'.join(BUILT_IN.stems())}') AS worded FROM documents)),
        s AS (SELECT *, ',' || array_to_string(a, ',') || ',' AS as_, ',' || array_to_string(b, ',') || ',' AS bs FROM t)
        SELECT doc_id,
            array_to_string(list_concat(a, list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))), ',') AS sentence_ids,
            array_to_string(list_sort(list_distinct(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL))), ',') AS licences
        FROM s""".replace("contains(as,", "contains(as_,")
