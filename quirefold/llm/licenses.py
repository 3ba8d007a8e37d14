"""Licence scan by sentence rules, with DataFrame functions only.

The text is normalised to words and breaks (line breaks and sentence ends). A known sentence is found where its words stand
between two breaks, whatever breaks are inside it (wraps, comment marks, "v. 2.0"), and gives its identifier; the sequence of identifiers in a document
is matched against rules, each an ordered list of identifiers between which others may stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences in normalised form: lower case, letters, digits and single spaces. Identifier, sentence.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("mit_name", "released under the mit license"),
    ("mit_name", "licensed under the mit license"),
    ("mit_name", "this project is licensed under the mit license"),
    ("mit_name", "mit license"),
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("notice_kept", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as_is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache2_name", "licensed under the apache license version 2 0"),
    ("apache2_name", "released under the apache license version 2 0"),
    ("apache2_grant", "licensed under the apache license version 2 0 the license"),
    ("apache2_comply", "you may not use this file except in compliance with the license"),
    ("apache2_copy", "you may obtain a copy of the license at"),
    ("gpl3_name", "this work is licensed under the gnu general public license version 3"),
    ("gpl3_name", "licensed under the gnu general public license version 3"),
    ("gpl2_name", "licensed under the gnu general public license version 2"),
    ("gpl_grant2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl_grant3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl3_name", "licensed under the gnu lesser general public license version 3"),
    ("agpl3_name", "licensed under the gnu affero general public license version 3"),
    ("mpl2_name", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl2_copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("bsd_grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd_names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ccby4", "licensed under cc by 4 0"),
    ("ccby4", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("ccbysa4", "licensed under cc by sa 4 0"),
    ("ccbysa4", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("ccbync4", "licensed under cc by nc 4 0"),
    ("ccbync4", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("ccbynd4", "licensed under cc by nd 4 0"),
    ("ccbyncsa4", "licensed under cc by nc sa 4 0"),
    ("cc0", "licensed under cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("rights", "all rights reserved"),
)

#: Licence, sentence identifiers in order, and the licences that it outdoes where both match.
RULES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("MIT", ("mit_name",), ()),
    ("MIT", ("mit_grant", "notice_kept"), ()),
    ("Apache-2.0", ("apache2_name",), ()),
    ("Apache-2.0", ("apache2_grant", "apache2_comply"), ()),
    ("GPL-3.0-only", ("gpl3_name",), ()),
    ("GPL-2.0-only", ("gpl2_name",), ()),
    ("GPL-2.0-or-later", ("gpl_grant2", "gpl_hope"), ()),
    ("GPL-3.0-or-later", ("gpl_grant3", "gpl_hope"), ()),
    ("LGPL-3.0-only", ("lgpl3_name",), ()),
    ("AGPL-3.0-only", ("agpl3_name",), ()),
    ("MPL-2.0", ("mpl2_name",), ()),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names"), ("BSD-2-Clause",)),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary"), ()),
    ("ISC", ("isc_grant",), ()),
    ("CC-BY-4.0", ("ccby4",), ()),
    ("CC-BY-SA-4.0", ("ccbysa4",), ()),
    ("CC-BY-NC-4.0", ("ccbync4",), ()),
    ("CC-BY-ND-4.0", ("ccbynd4",), ()),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4",), ()),
    ("CC0-1.0", ("cc0",), ()),
    ("Unlicense", ("unlicense",), ()),
)


def broken_words(text: Column) -> Column:
    """Lower-case words (letters and digits) with single spaces, and a line break at each break, also at both ends.

    A line break before a lower-case letter or a bracket, after no sentence end, is a wrap and no break.
    """
    unwrapped = F.regexp_replace(F.coalesce(text, F.lit("")), r"([^.!?:;\n])\r?\n[ \t]*(?:(?:dnl|rem)[ \t]+)?+([a-z(])", "$1 $2")
    words = F.regexp_replace(F.lower(F.regexp_replace(unwrapped, r"([.!?:;])[ \t\r]+", "$1\n")), r"[^a-z0-9\n]+", " ")
    # what begins comments in letters goes; other comment marks are gone already
    return F.regexp_replace(F.concat(F.lit("\n"), words, F.lit("\n")), r" *\n[ \n]*(?:(?:dnl|rem) )?", "\n")


def scan_licenses(docs: DataFrame, sentences=SENTENCES, rules=RULES) -> DataFrame:
    """Per row of docs: doc_id, sequence (known sentences in their order: identifiers joined by commas), licenses (sorted names).

    A text without known sentences, also an empty or null one, has an empty sequence and no licences; known sentences that
    complete no rule give `unrecognised`. Repeated rows with one doc_id and text give a row each; other columns are ignored.
    The sentence table and the rules are parameters of a few dozen rows and part of the plan.
    """
    ids: dict[str, str] = {s: i for i, s in sentences}
    known = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    # where two known sentences begin at one place, the longer one counts
    either = "|".join(s.replace(" ", r"[ \n]") for s in sorted(ids, key=len, reverse=True))
    found = F.regexp_extract_all(broken_words(F.col("text")), F.lit(rf"(?<=\n)(?:{either})(?=\n)"), F.lit(0))
    rows = docs.select("doc_id", F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " "))).alias("marks"))
    rows = rows.select("doc_id", F.array_join("marks", ",").alias("sequence"))
    within = F.concat(F.lit(","), F.col("sequence"), F.lit(","))
    match = {r: within.rlike(",.*,".join(rule).join((",", ",")).replace(",.*,", ",(.*,)?")) for r, (_, rule, _) in enumerate(rules)}
    outdone = {name: [n for n, (_, _, less) in enumerate(rules) if name in less] for name, _, _ in rules}
    found = []
    for r, (name, _, _) in enumerate(rules):
        hit = match[r]
        for n in outdone[name]:
            hit = hit & ~match[n]
        found.append(F.when(hit, F.lit(name)))
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    names = F.when(F.col("sequence") == "", F.array().cast("array<string>")).when(F.size(names) == 0, F.array(F.lit("unrecognised"))).otherwise(names)
    return rows.select("doc_id", "sequence", names.alias("licenses"))
