"""License scans by sentence rules.

Texts are split into pieces at sentence ends and blank lines; normalised pieces, and lines of pieces, are looked up
among known licence sentences, which gives identifiers; the identifiers of a document, in order, are matched against
ordered licence rules (sequences of identifiers). DataFrame functions only; the table of known sentences is fixed, some
90 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Known licence sentences by identifier. Matching ignores case, punctuation and line breaks.
SENTENCES = {
    "mit_named": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Distributed under the MIT License",
        "This software is released under the MIT License",
        "This project is licensed under the MIT License",
        "This work is licensed under the MIT License",
    ],
    "mit_grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'
    ],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit_warranty": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'
    ],
    "mit_liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
    ],
    "apache2_named": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License")',
        "Released under the Apache License, Version 2.0",
        "This work is licensed under the Apache License, Version 2.0",
        "This project is licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License 2.0",
    ],
    "apache2_comply": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'
    ],
    "apache2_copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache2_unless": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'
    ],
    "apache2_see": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl3_named": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
        "Released under the GNU General Public License, version 3",
        "This program is licensed under the GNU General Public License, version 3",
    ],
    "gpl2_named": [
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License, version 2",
        "Released under the GNU General Public License, version 2",
    ],
    "gpl_free": ["This program is free software"],
    "gpl3_later": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "gpl2_later": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"
    ],
    "gpl3_later_whole": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version"
    ],
    "gpl2_later_whole": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"
    ],
    "gpl_hope": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
    ],
    "gpl_see": ["See the GNU General Public License for more details"],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd_binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
    ],
    "bsd_endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ],
    "bsd_warranty": [
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'
    ],
    "bsd3_named": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"],
    "bsd2_named": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License"],
    "isc_grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "mpl2_subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "mpl2_named": ["Licensed under the Mozilla Public License 2.0", "Licensed under the Mozilla Public License, Version 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc0_named": ["Licensed under CC0 1.0", "Released under CC0 1.0"],
    "cc_by_named": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc_by_sa_named": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc_by_nc_named": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc_by_nd_named": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0"],
    "spdx_tag": ["SPDX-License-Identifier"],
}
# Ordered rules. Of the rules that match from the same sentence on, the first one holds.
RULES = [
    ("MIT", ["mit_named", "mit_grant", "mit_notice", "mit_warranty", "mit_liability"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty", "mit_liability"]),
    ("Apache-2.0", ["apache2_comply", "apache2_copy", "apache2_unless", "apache2_see"]),
    ("Apache-2.0", ["apache2_named", "apache2_copy", "apache2_unless", "apache2_see"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl3_later", "gpl_hope", "gpl_see"]),
    ("GPL-3.0-or-later", ["gpl3_later_whole", "gpl_hope", "gpl_see"]),
    ("GPL-2.0-or-later", ["gpl_free", "gpl2_later", "gpl_hope", "gpl_see"]),
    ("GPL-2.0-or-later", ["gpl2_later_whole", "gpl_hope", "gpl_see"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_warranty"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty"]),
    ("ISC", ["isc_grant"]),
    ("MPL-2.0", ["mpl2_subject"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl3_later"]),
    ("GPL-2.0-or-later", ["gpl_free", "gpl2_later"]),
    ("GPL-3.0-or-later", ["gpl3_later_whole"]),
    ("GPL-2.0-or-later", ["gpl2_later_whole"]),
    ("Apache-2.0", ["apache2_comply"]),
    ("MIT", ["mit_named"]),
    ("Apache-2.0", ["apache2_named"]),
    ("GPL-3.0-only", ["gpl3_named"]),
    ("GPL-2.0-only", ["gpl2_named"]),
    ("BSD-3-Clause", ["bsd3_named"]),
    ("BSD-2-Clause", ["bsd2_named"]),
    ("MPL-2.0", ["mpl2_named"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0_named"]),
    ("CC-BY-4.0", ["cc_by_named"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_named"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_named"]),
    ("CC-BY-ND-4.0", ["cc_by_nd_named"]),
]
# SPDX identifiers after a tag, and what they stand for where that is another one.
SPDX = {
    "MIT": "MIT",
    "Apache-2.0": "Apache-2.0",
    "GPL-2.0": "GPL-2.0-only",
    "GPL-2.0+": "GPL-2.0-or-later",
    "GPL-2.0-only": "GPL-2.0-only",
    "GPL-2.0-or-later": "GPL-2.0-or-later",
    "GPL-3.0": "GPL-3.0-only",
    "GPL-3.0+": "GPL-3.0-or-later",
    "GPL-3.0-only": "GPL-3.0-only",
    "GPL-3.0-or-later": "GPL-3.0-or-later",
    "LGPL-2.1": "LGPL-2.1-only",
    "LGPL-2.1+": "LGPL-2.1-or-later",
    "LGPL-2.1-only": "LGPL-2.1-only",
    "LGPL-2.1-or-later": "LGPL-2.1-or-later",
    "LGPL-3.0-only": "LGPL-3.0-only",
    "LGPL-3.0-or-later": "LGPL-3.0-or-later",
    "AGPL-3.0-only": "AGPL-3.0-only",
    "AGPL-3.0-or-later": "AGPL-3.0-or-later",
    "BSD-2-Clause": "BSD-2-Clause",
    "BSD-3-Clause": "BSD-3-Clause",
    "ISC": "ISC",
    "MPL-2.0": "MPL-2.0",
    "EPL-2.0": "EPL-2.0",
    "Unlicense": "Unlicense",
    "CC0-1.0": "CC0-1.0",
    "CC-BY-4.0": "CC-BY-4.0",
    "CC-BY-SA-4.0": "CC-BY-SA-4.0",
    "CC-BY-NC-4.0": "CC-BY-NC-4.0",
    "CC-BY-ND-4.0": "CC-BY-ND-4.0",
}
SENTENCES |= {f"spdx_{tag}": [tag] for tag in SPDX}
RULES += [(license, ["spdx_tag", f"spdx_{tag}"]) for tag, license in SPDX.items()]
#: Where pieces end: after . ! ? : and blanks, and at blank lines.
PIECE_END = r"(?<=[.!?:])\s+|\n[ \t\r]*\n\s*"


TAG = "SPDX-License-Identifier:"


def normalised(sentence: Column) -> Column:
    """Lower-case letters and digits with single spaces between, and plus for a plus sign."""
    return F.trim(F.regexp_replace(F.replace(F.lower(sentence), F.lit("+"), F.lit(" plus ")), r"[^\p{L}\p{N}]+", " "))


def tags_apart(text: Column) -> Column:
    """The text with a tag of its own for every licence of an SPDX expression, which ends with its line; what comes after
    WITH gets none."""

    def apart(line: Column) -> Column:
        before = F.substring_index(line, TAG, 1)
        rest = F.substr(line, F.length(before) + F.lit(1 + len(TAG)))
        rest = F.regexp_replace(F.regexp_replace(rest, r"[ \t]+WITH[ \t]+", "\n"), r"[ \t]+(?:OR|AND)[ \t]+", f"\n{TAG} ")
        return F.when(F.instr(line, TAG) > 0, F.concat(before, F.lit(TAG), rest)).otherwise(line)

    return F.when(F.instr(text, TAG) > 0, F.array_join(F.transform(F.split(text, "\n"), apart), "\n")).otherwise(text)


def scan_licenses(docs: DataFrame, sentences: dict | None = None, rules: list | None = None, max_gap: int = 2,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each licence statement: id, license, rule (its sentence identifiers), first_piece, last_piece.

    Sentences are looked up in whole pieces and, where a piece spans lines, in each of its lines and in what follows
    a line's start up to the piece's end; of known sentences that overlap the longest counts. A rule matches identifiers
    in their order with at most max_gap pieces between neighbours that are no known sentences. An SPDX expression gives
    a row for each of its licences. Null and empty texts give no rows; rows with the same id are scanned each for
    itself, equal rows together, and give one result for each distinct text. A null id is kept as an id."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    number = {name: k for k, name in enumerate(sentences)}
    spark = docs.sparkSession
    known = spark.createDataFrame([(t, number[name]) for name, ts in sentences.items() for t in ts], "sentence string, known int")
    known = known.select(normalised(F.col("sentence")).alias("norm"), "known").dropDuplicates(["norm"])
    longest = known.agg(F.max(F.length("norm"))).first()[0]  # of a fixed table; longer texts, normalised, are no known sentence

    pieces = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.posexplode(F.split(tags_apart(F.col(text_col)), PIECE_END)).alias("piece", "part")
    ).where(F.length("part") > 0)
    # A piece of several lines stands for its lines, and for the ends of it that begin with a line. Lines are normalised
    # first, and those without a letter or digit left out, so that of the end only as much as a sentence can have is looked at.
    span = lambda first, last, norm: F.struct(first.alias("first"), last.alias("last"), norm.alias("norm"))
    lines = F.filter(F.transform(F.split("part", "\n"), lambda t, i: span(i, i, normalised(t))), lambda x: F.length(x["norm"]) > 0)
    joined = F.array_join(F.transform("lines", lambda x: x["norm"]), "\n")
    ends = F.transform(
        F.sequence(F.lit(0), F.size("end") - 1),
        lambda i: span(
            F.col("lines")[F.size("lines") - F.size("end") + i]["first"], F.element_at("lines", -1)["first"],
            F.array_join(F.slice("end", i + 1, F.size("end")), " "),
        ),
    )
    candidates = (
        pieces.withColumn("lines", lines).where(F.size("lines") > 0).withColumn("joined", joined)
        .withColumn("end", F.split(F.substring("joined", -longest - 1, longest + 1), "\n"))
        .withColumn("end", F.when(F.length("joined") > longest, F.slice("end", 2, F.greatest(F.size("end") - 1, F.lit(0)))).otherwise(F.col("end")))
        .withColumn("ends", F.when((F.size("lines") > 1) & (F.size("end") > 1), F.filter(ends, lambda x: x["first"] < x["last"])))
        .select("id", "mark", "piece", F.explode(F.when(F.col("ends").isNull(), F.col("lines")).otherwise(F.concat("lines", "ends"))).alias("span"))
    )
    over_lines = F.col("span.first") < F.col("span.last")
    found = (
        candidates.where(F.length("span.norm").between(2, longest)).withColumn("norm", F.col("span.norm"))
        .join(F.broadcast(known), "norm")  # a fixed table, some 90 rows
        .groupBy("id", "mark", "piece")
        .agg(
            F.min(F.when(over_lines, F.struct(F.col("span.first").alias("line"), "known"))).alias("over"),  # ends contain each other
            F.collect_set(F.when(~over_lines, F.struct(F.col("span.first").alias("line"), "known"))).alias("lines"),
        )
        .withColumn("lines", F.filter("lines", lambda x: F.col("over").isNull() | (x["line"] < F.col("over.line"))))
        .withColumn("lines", F.when(F.col("over").isNull(), F.col("lines")).otherwise(F.array_append("lines", F.col("over"))))
        .groupBy("id", "mark")
        .agg(F.array_sort(F.flatten(F.collect_list(F.transform("lines", lambda x: F.struct(F.col("piece"), x["line"].alias("line"), x["known"].alias("known")))))).alias("seen"))
    )
    before = lambda i: F.get(F.col("seen"), i - 1)["piece"]
    token = lambda x, i: F.concat(
        F.when((i > 0) & (x["piece"] - before(i) > max_gap + 1), "~").otherwise(""), F.lit("<"), x["known"].cast("string"), F.lit("@"), x["piece"].cast("string"), F.lit(">")
    )
    # In an alternation of patterns the first that matches holds, as rules are to.
    pattern = "|".join("".join(f"<{number[s]}@[0-9]+>" for s in names) for _, names in rules)
    by_ids = {"".join(f"<{number[s]}>" for s in names): (license, " ".join(names)) for license, names in reversed(rules)}
    rule_of = F.create_map(*[F.lit(x) for ids, rule in by_ids.items() for x in (ids, "\t".join(rule))])
    rule = F.split(rule_of[F.regexp_replace("match", "@[0-9]+", "")], "\t")
    places = F.regexp_extract_all("match", F.lit("@([0-9]+)"), F.lit(1))
    return (
        found.select("id", F.array_join(F.transform("seen", token), "").alias("ids"))
        .select("id", F.explode(F.regexp_extract_all("ids", F.lit(pattern), F.lit(0))).alias("match"))
        .select(
            F.col("id").alias(id_col),
            F.get(rule, F.lit(0)).alias("license"),
            F.get(rule, F.lit(1)).alias("rule"),
            F.get(places, F.lit(0)).cast("long").alias("first_piece"),
            F.element_at(places, -1).cast("long").alias("last_piece"),
        )
    )
