"""License scans: sentences to known sentence identifiers, identifiers to rules.

A text is normalised to lower-case words with marks where it may be cut: hard marks at
ends of sentences and blank lines, soft ones at single line breaks, colons and
semicolons.  A library sentence is found from one mark to another, over any soft ones
between; comment signs before its lines are not words.  Found sentences get their
identifiers.  The identifiers of a text, in order,
are matched against an ordered list of rules (the specific before the general);
what a rule has matched is taken out, so that a later rule does not claim it too.

All of it is expressions over one row: no shuffle, no join.  The library is part
of the code, so its size is fixed.

Defined results: null and empty texts have no sentences and no licenses; repeated
rows are scanned one by one; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier to normalised sentence.
SENTENCES: dict[str, tuple[str, ...]] = {
    "SPDX_MIT": ("spdx license identifier mit",),
    "SPDX_APACHE2": ("spdx license identifier apache 2 0",),
    "SPDX_GPL3": ("spdx license identifier gpl 3 0", "spdx license identifier gpl 3 0 only"),
    "SPDX_GPL3P": ("spdx license identifier gpl 3 0 or later",),
    "SPDX_BSD3": ("spdx license identifier bsd 3 clause",),
    "SPDX_BSD2": ("spdx license identifier bsd 2 clause",),
    "MIT_REF": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "released under the mit licence"),
    "MIT_GRANT": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "MIT_NOTICE": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "AS_IS": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "APACHE2_REF": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "this project is licensed under the apache license version 2 0"),
    "APACHE2_COMPLY": ("you may not use this file except in compliance with the license", "you may obtain a copy of the license at"),
    "APACHE2_LIMIT": ("see the license for the specific language governing permissions and limitations under the license",),
    "GPL3_REF": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "this program is licensed under the gnu general public license version 3", "released under the gnu general public license version 3"),
    "GPL2_REF": ("licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    "GPL_REDIST": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "GPL_NO_WARRANTY": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "LGPL3_REF": ("licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"),
    "AGPL3_REF": ("licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"),
    "BSD_REDIST": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "BSD_SOURCE": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "BSD_BINARY": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "BSD_NAME": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "MPL2_REF": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "CC_BY_NC_REF": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "CC_BY_NC_SA_REF": ("licensed under cc by nc sa 4 0", "this work is licensed under cc by nc sa 4 0"),
    "CC_BY_ND_REF": ("licensed under cc by nd 4 0", "this work is licensed under cc by nd 4 0"),
    "CC_BY_SA_REF": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "CC_BY_REF": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "CC0_REF": ("this work is dedicated to the public domain", "licensed under cc0 1 0", "released under cc0 1 0"),
    "RESERVED": ("all rights reserved",),
}

#: License and the identifiers that stand for it, in order; tried from the top.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "AS_IS")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE")),
    ("MIT", ("MIT_GRANT",)),
    ("Apache-2.0", ("APACHE2_REF", "APACHE2_COMPLY", "APACHE2_COMPLY", "APACHE2_LIMIT")),
    ("Apache-2.0", ("APACHE2_REF", "APACHE2_COMPLY")),
    ("GPL-3.0-or-later", ("GPL_REDIST", "GPL_NO_WARRANTY")),
    ("GPL-3.0-or-later", ("GPL_REDIST",)),
    ("BSD-3-Clause", ("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME")),
    ("BSD-2-Clause", ("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY")),
    ("MIT", ("SPDX_MIT",)),
    ("Apache-2.0", ("SPDX_APACHE2",)),
    ("GPL-3.0-or-later", ("SPDX_GPL3P",)),
    ("GPL-3.0-only", ("SPDX_GPL3",)),
    ("BSD-3-Clause", ("SPDX_BSD3",)),
    ("BSD-2-Clause", ("SPDX_BSD2",)),
    ("MIT", ("MIT_REF",)),
    ("Apache-2.0", ("APACHE2_REF",)),
    ("AGPL-3.0-only", ("AGPL3_REF",)),
    ("LGPL-3.0-only", ("LGPL3_REF",)),
    ("GPL-3.0-only", ("GPL3_REF",)),
    ("GPL-2.0-only", ("GPL2_REF",)),
    ("MPL-2.0", ("MPL2_REF",)),
    ("CC-BY-NC-SA-4.0", ("CC_BY_NC_SA_REF",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_REF",)),
    ("CC-BY-ND-4.0", ("CC_BY_ND_REF",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA_REF",)),
    ("CC-BY-4.0", ("CC_BY_REF",)),
    ("CC0-1.0", ("CC0_REF",)),
    ("Proprietary", ("RESERVED",)),
)

#: What takes the place of what, in order.  "|" is a hard mark, "_" a soft one; neither is left in the text before.
MARKS = (
    (r"[|_]", " "),
    # Blank lines, also those of comment signs alone.
    (r"(?>\r\n|[\r\n])(?:[^a-z0-9\r\n]*+(?>\r\n|[\r\n]))+", " | "),
    # Signs and numbers before a line's words.
    (r"(?:^|[\r\n]+)[^a-z0-9|\r\n]*+(?:(?:rem|dnl)(?=[\x20\t])|\(?[0-9a-z]\))?", "_"),
    (r"(?<=gpl-[0-9]\.[0-9])\+", " or later "),
    (r"\bv\.(?=[\x20\t_])", "v_"),
    (r"[.!?;:]*[.!?][.!?;:]*(?=[\x20\t_]|\z)", " | "),
    (r"[;:]+(?=[\x20\t_]|\z)", "_"),
    (r"[^a-z0-9|_]+", " "),
    (r" *_[ _]*", " _ "),
    (r"(?: _)? \|(?: [|_])* ", " | "),
)
#: Every library sentence has one of these in one of its words.  Marks part words but never join or change them, so
#: a text without any in its lower-case form holds no sentence.
CUES = ("licen", "copyright", "redistribut", "warrant", "reserved", "domain", "cc0", "permission")


def marked(text: Column) -> Column:
    """Lower-case letters and digits with single spaces and marks between, a hard mark at both ends."""
    step = F.lower(text)
    for sought, put in MARKS:
        step = F.regexp_replace(step, sought, put)
    return F.concat(F.lit("| "), step, F.lit(" |"))


def sought() -> str:
    """The pattern of a library sentence between marks, the longest first."""
    texts = sorted((t for texts in SENTENCES.values() for t in texts), key=lambda t: (-len(t), t))
    return "(?<=[|_] {1,3})(?:" + "|".join(t.replace(" ", "(?: _)? ") for t in texts) + ")(?= {1,3}[|_])"


def scan(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each row of ``docs``: ``doc_id``, the columns in ``keep``, and what was found.

    ``n_license_sentences`` long, ``sentence_ids`` and ``licenses`` (both strings,
    comma-joined in order of the text and of the rules), ``n_licenses`` long.
    """
    library = {text: name for name, texts in SENTENCES.items() for text in texts}
    names = F.create_map(*[F.lit(x) for pair in library.items() for x in pair])
    text = F.coalesce(F.col("text"), F.lit(""))
    some = F.lower(text).rlike("|".join(CUES))
    known = F.transform(F.regexp_extract_all(marked(text), F.lit(sought()), F.lit(0)), lambda s: F.replace(s, F.lit(" _"), F.lit("")))
    none = F.array().cast("array<string>")
    found = F.when(some, F.transform(known, lambda s: F.element_at(names, s))).otherwise(none)
    step = docs.select("doc_id", *keep, found.alias("_ids"))
    step = step.withColumn("_rest", F.concat(F.lit(","), F.array_join("_ids", ",,"), F.lit(",")))
    step = step.withColumn("_licenses", none)
    # One step a rule; the identifiers are few, and rows without any skip all of it.
    state = F.struct(F.col("_rest").alias("rest"), none.alias("found"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f",{i}," for i in ids)).alias("ids")) for name, ids in RULES])
    matched = F.aggregate(
        rules,
        state,
        lambda acc, r: F.struct(
            F.replace(acc["rest"], r["ids"], F.lit("#")).alias("rest"),
            F.when(F.contains(acc["rest"], r["ids"]), F.concat(acc["found"], F.array(r["name"]))).otherwise(acc["found"]).alias("found"),
        ),
        lambda acc: F.array_distinct(acc["found"]),
    )
    step = step.withColumn("_licenses", F.when(F.size("_ids") > 0, matched).otherwise(none))
    return step.select("doc_id", *keep, F.size("_ids").cast("long").alias("n_license_sentences"), F.array_join("_ids", ",").alias("sentence_ids"), F.array_join("_licenses", ",").alias("licenses"), F.size("_licenses").cast("long").alias("n_licenses"))
