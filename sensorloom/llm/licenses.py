"""Licence recognition by sentences and ordered rules. DataFrame functions only.

A text that has a word of licences is cut into sentences, once with every line end
as a cut and once with lines joined (notices are often wrapped). Sentences are
normalised and mapped to identifiers of known licence sentences. The identifiers,
in order, are matched against ordered rules; a rule that matches names its licence
and takes its identifiers away, so that a later rule for a part does not match them
again. What has a licence word but no identifier counts as unknown.

Notices whose sentences go on behind a semicolon or "v." have a third reading that
does not cut there. The SQL has the first two readings, of sentences with a licence
word; where a text needs more, the operator finds more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, table, whole

#: Words without which nothing is looked at.
CRITICAL = r"(?i)licen[cs]e|copyright|warrant|redistribut|spdx|rights reserved|public domain|permission (is hereby granted|to use)"

#: Every known sentence has one of these or a word of licences.
POSSIBLE = CRITICAL + r"|neither|gnu|cc0|commons|permission|reserved|domain"

# Identifiers of licence sentences and patterns of the whole normalised sentence
# (lower case, marks other than . + - as blanks, blanks single, no marks at the ends).
SENTENCES: tuple[tuple[str, str], ...] = (
    ("AGPL3", r".*licensed under (the )?(terms of )?(the )?gnu affero general public license,? (version|v)? ?3(\.0)?"),
    ("LGPL2.1", r".*licensed under (the )?(terms of )?(the )?gnu (lesser|library) general public license,? (version|v)? ?2\.1"),
    ("LGPL3", r".*licensed under (the )?(terms of )?(the )?gnu (lesser|library) general public license,? (version|v)? ?3(\.0)?"),
    ("GPL2", r".*licensed under (the )?(terms of )?(the )?gnu general public license,? (version|v)? ?2(\.0)?"),
    ("GPL3", r".*licensed under (the )?(terms of )?(the )?gnu general public license,? (version|v)? ?3(\.0)?"),
    ("GPLfree2", r"this program is free software.* gnu general public license as published by the free software foundation.* version 2 .*"),
    ("GPLfree3", r"this program is free software.* gnu general public license as published by the free software foundation.* version 3 .*"),
    ("LGPLfree", r"this library is free software.* gnu (lesser|library) general public license as published by the free software foundation.*"),
    ("GPLhope", r"this (program|library) is distributed in the hope that it will be useful but without any warranty.*"),
    ("GPLcopy", r"you should have received a copy of the gnu .*"),
    ("GPLdetails", r"see the gnu (lesser |affero |library )?general public license for more details"),
    ("Apache2", r".*(licensed|released) under the apache license,? (version|v)? ?2(\.0)?( the license)?"),
    ("ApacheUse", r"you may not use this file except in compliance with the license"),
    ("ApacheObtain", r"you may obtain a copy of the license at.*"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("MITref", r".*(licensed|released) under the mit license"),
    ("MITgrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("MITnotice", r"the above copyright notice and this permission notice shall be included in all copies.*"),
    ("MITasis", r"the software is provided as is without warranty of any kind.*"),
    ("MITevent", r"in no event shall the authors or copyright holders be liable.*"),
    ("ISCgrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("BSDref", r".*(licensed|released) under (the|a) ((2|3)-clause )?bsd(-style)? license"),
    ("BSDgrant", r"redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("BSDsource", r"(\d )?redistributions of source code must retain the above copyright notice.*"),
    ("BSDbinary", r"(\d )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSDendorse", r"(\d )?neither the name of .* nor the names of its contributors may be used to endorse or promote.*"),
    ("BSDasis", r"this software is provided by the copyright holders and contributors as is.*"),
    ("MPL2", r"this source code form is subject to the terms of the mozilla public license,? v\.? ?2\.0"),
    ("CCBYNCSA4", r".*licensed under (a |the )?(creative commons|cc) by-nc-sa 4\.0( license)?"),
    ("CCBYNCND4", r".*licensed under (a |the )?(creative commons|cc) by-nc-nd 4\.0( license)?"),
    ("CCBYNC4", r".*licensed under (a |the )?(creative commons|cc) by-nc 4\.0( license)?"),
    ("CCBYSA4", r".*licensed under (a |the )?(creative commons|cc) by-sa 4\.0( license)?"),
    ("CCBYND4", r".*licensed under (a |the )?(creative commons|cc) by-nd 4\.0( license)?"),
    ("CCBY4", r".*licensed under (a |the )?(creative commons|cc) by 4\.0( license)?"),
    ("CC0", r".*(cc0|creative commons zero) ?1\.0.*"),
    ("PublicDomain", r"this (work|file|software) (is|has been released) (in|into) the public domain"),
    ("Reserved", r"all rights reserved"),
    ("Copyright", r"(portions )?copyright( c)? .*"),
    ("SPDX-Apache2", r"spdx-license-identifier apache-2\.0"),
    ("SPDX-MIT", r"spdx-license-identifier mit"),
    ("SPDX-GPL2", r"spdx-license-identifier gpl-2\.0(-only|-or-later|\+)?"),
    ("SPDX-GPL3", r"spdx-license-identifier gpl-3\.0(-only|-or-later|\+)?"),
    ("SPDX-BSD3", r"spdx-license-identifier bsd-3-clause"),
    ("SPDX-BSD2", r"spdx-license-identifier bsd-2-clause"),
)

# Licences and the sentences that make them, longer rules first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("Apache2", "ApacheUse", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("Apache2", "ApacheUse", "ApacheObtain")),
    ("Apache-2.0", ("Apache2",)),
    ("Apache-2.0", ("SPDX-Apache2",)),
    ("MIT", ("MITgrant", "MITnotice", "MITasis", "MITevent")),
    ("MIT", ("MITgrant", "MITnotice", "MITasis")),
    ("MIT", ("MITref",)),
    ("MIT", ("SPDX-MIT",)),
    ("ISC", ("ISCgrant",)),
    ("BSD-3-Clause", ("BSDgrant", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis")),
    ("BSD-3-Clause", ("BSDgrant", "BSDsource", "BSDbinary", "BSDendorse")),
    ("BSD-2-Clause", ("BSDgrant", "BSDsource", "BSDbinary", "BSDasis")),
    ("BSD-2-Clause", ("BSDgrant", "BSDsource", "BSDbinary")),
    ("BSD", ("BSDref",)),
    ("BSD-3-Clause", ("SPDX-BSD3",)),
    ("BSD-2-Clause", ("SPDX-BSD2",)),
    ("AGPL-3.0", ("AGPL3",)),
    ("LGPL-2.1", ("LGPL2.1",)),
    ("LGPL-3.0", ("LGPL3",)),
    ("LGPL", ("LGPLfree", "GPLhope", "GPLdetails", "GPLcopy")),
    ("LGPL", ("LGPLfree",)),
    ("GPL-3.0", ("GPLfree3", "GPLhope", "GPLdetails", "GPLcopy")),
    ("GPL-2.0", ("GPLfree2", "GPLhope", "GPLdetails", "GPLcopy")),
    ("GPL-3.0", ("GPLfree3",)),
    ("GPL-2.0", ("GPLfree2",)),
    ("GPL-3.0", ("GPL3",)),
    ("GPL-2.0", ("GPL2",)),
    ("GPL-3.0", ("SPDX-GPL3",)),
    ("GPL-2.0", ("SPDX-GPL2",)),
    ("MPL-2.0", ("MPL2",)),
    ("CC-BY-NC-SA-4.0", ("CCBYNCSA4",)),
    ("CC-BY-NC-ND-4.0", ("CCBYNCND4",)),
    ("CC-BY-NC-4.0", ("CCBYNC4",)),
    ("CC-BY-SA-4.0", ("CCBYSA4",)),
    ("CC-BY-ND-4.0", ("CCBYND4",)),
    ("CC-BY-4.0", ("CCBY4",)),
    ("CC0-1.0", ("CC0",)),
    ("Public-Domain", ("PublicDomain",)),
    ("All-Rights-Reserved", ("Copyright", "Reserved")),
    ("All-Rights-Reserved", ("Reserved",)),
)

_CUTS = {"lines": r"\n|[.;!?](?=[\x20\x09-\x0D]|$)", "joined": r"\n[\x20\x09]*\n|[.;!?](?=[\x20\x09-\x0D]|$)"}
_NOTICES = r"\n[\x20\x09]*\n|\n(?=[^A-Za-z\n]*(?i:this (?:program|library|source code form) is ))|[.!?](?=[\x20\x09-\x0D]|$)(?!(?<=\b[vV][.])[\x20\x09-\x0D]+[0-9])"
#: Sentences that only the third reading can have whole begin the rules it is asked for.
_NOTICE_IDS = ("GPLfree2", "GPLfree3", "LGPLfree", "MPL2")


def _normal(x: Column) -> Column:
    plain = F.regexp_replace(F.lower(x), r"[^a-z0-9.+-]+", " ")
    return F.regexp_replace(plain, r"^[ .+-]+|[ .+-]+$", "")


def _identifier(x: Column) -> Column:
    out = F.lit("?")
    for name, pattern in reversed(SENTENCES):
        out = F.when(x.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _tag(names: tuple[str, ...]) -> str:
    return "".join(f"<{n}>" for n in names)


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, licences (array, by rule), sentences (identifiers with lines cut, in order), unknown (sentences with a licence word but no identifier).

    One row for each document with a licence sentence, known or not. Null and
    empty texts have none. Repeated rows are each reported. Other columns are ignored.
    """
    rows = docs.select("doc_id", whole().alias("_l_text")).where(F.col("_l_text").rlike(CRITICAL))
    for name, cut in (_CUTS | {"notices": _NOTICES}).items():
        parts = F.filter(F.split("_l_text", cut), lambda x: x.rlike(POSSIBLE))
        tagged = F.transform(parts, lambda x: F.struct(x.rlike(CRITICAL).alias("critical"), _identifier(_normal(x)).alias("id")))
        tagged = F.filter(tagged, lambda x: x["critical"] | (x["id"] != "?"))
        rows = rows.withColumn(f"_l_{name}", F.transform(tagged, lambda x: x["id"]))
    for name in ("lines", "joined", "notices"):
        mine = [(licence, ids) for licence, ids in RULES if name in _CUTS or ids[0] in _NOTICE_IDS]
        rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(_tag(ids)).alias("ids")) for licence, ids in mine])
        known = F.filter(f"_l_{name}", lambda x: x != "?")
        start = F.struct(F.array_join(F.transform(known, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("left"), F.array().cast("array<string>").alias("found"))
        found = F.aggregate(
            rules, start,
            lambda a, r: F.when(F.instr(a["left"], r["ids"]) > 0, F.struct(F.replace(a["left"], r["ids"], F.lit("|")).alias("left"), F.concat(a["found"], F.array(r["licence"])).alias("found"))).otherwise(a),
        )
        rows = rows.withColumn(f"_l_{name}_found", found["found"])
    # A wrapped third clause is seen with lines joined only.
    two, three = F.lit("BSD-2-Clause"), F.lit("BSD-3-Clause")
    wrapped = F.array_contains("_l_joined_found", three) & ~F.array_contains("_l_joined_found", two)
    rows = rows.withColumn("_l_lines_found", F.when(wrapped, F.array_remove("_l_lines_found", two)).otherwise(F.col("_l_lines_found")))
    out = rows.select(
        "doc_id", F.array_sort(F.array_distinct(F.concat("_l_lines_found", "_l_joined_found", "_l_notices_found"))).alias("licences"),
        F.filter("_l_lines", lambda x: x != "?").alias("sentences"),
        F.size(F.filter("_l_lines", lambda x: x == "?")).cast("long").alias("unknown"), F.size("_l_lines").alias("_l_n"), F.size("_l_joined").alias("_l_m"),
    )
    return out.where("_l_n + _l_m > 0").drop("_l_n", "_l_m")


def _sql() -> str:
    """The same in DuckDB: cut, normalise, map, then one step for each rule."""
    critical = CRITICAL
    case = " ".join(f"WHEN regexp_full_match(x, '{p}') THEN '{n}'" for n, p in SENTENCES)
    ctes = ["d AS (SELECT doc_id, text FROM documents WHERE regexp_matches(coalesce(text, ''), '" + critical + "'))"]
    for name, cut in _CUTS.items():
        # RE2 has no look-ahead: mark the cuts first, keeping what follows the mark.
        marked = f"regexp_replace(regexp_replace(text, '{cut.split('|')[0]}', chr(1), 'g'), '[.;!?]([\\x20\\x09-\\x0D\\x01]|$)', chr(1) || '\\1', 'g')"
        parts = f"list_filter(string_split(regexp_replace({marked}, '[.;!?]([\\x20\\x09-\\x0D\\x01]|$)', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '{critical}'))"
        normal = f"list_transform({parts}, lambda x: regexp_replace(regexp_replace(lower(x), '[^a-z0-9.+-]+', ' ', 'g'), '^[ .+-]+|[ .+-]+$', '', 'g'))"
        ctes.append(f"{name}0 AS (SELECT doc_id, list_transform({normal}, lambda x: CASE {case} ELSE '?' END) AS ids FROM d)")
        step = f"(SELECT doc_id, ids, coalesce(array_to_string(list_transform(list_filter(ids, lambda x: x <> '?'), lambda x: '<' || x || '>'), ''), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM {name}0)"
        for licence, ids in RULES:
            tag = _tag(ids)
            step = f"(SELECT doc_id, ids, replace(rest, '{tag}', '|') AS rest, CASE WHEN contains(rest, '{tag}') THEN list_append(found, '{licence}') ELSE found END AS found FROM {step})"
        ctes.append(f"{name} AS (SELECT * FROM {step})")
    return "WITH " + ",\n".join(ctes) + """
SELECT l.doc_id, array_to_string(list_sort(list_distinct(list_concat(l.found, j.found))), ',') AS licences,
  coalesce(array_to_string(list_filter(l.ids, lambda x: x <> '?'), ','), '') AS sentences,
  CAST(len(list_filter(l.ids, lambda x: x = '?')) AS BIGINT) AS unknown
FROM lines l JOIN joined j USING (doc_id) WHERE len(l.ids) + len(j.ids) > 0"""


@query("op9_licence_rules", _sql())
def op9(spark, sf_dir):
    out = licences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentences", ",").alias("sentences"), "unknown")
