"""Licence recognition from sentences, with DataFrame functions only.

Known licence sentences are found first, over line ends, comment marks and blank
lines within them: each must start at the start of a line or behind . ! ? ; : and
end at the end of a line or at such a mark.  What is left is cut into sentences at
line ends (a line of 50 characters or more without a mark at its end goes on in the
next one, unless that is blank) and after full stops, question and exclamation
marks.  Sentences that speak of licensing are normalised (lower case, runs of other
characters than a-z and 0-9 become one space) and mapped to the identifier of a
known licence sentence, or UNKNOWN.  The text's identifiers, in
order, are matched against ordered rules: each rule is a run of identifiers; where
it is found its licence is reported and the run taken out, so that full texts come
before the short notices they contain.

Everything happens within a row, by built-in functions: no shuffle, no Python.

Defined results: null, empty and unlicensed texts have no identifiers and no
licences; repeats of a sentence are kept in the identifiers, a licence is reported
once, in the order of the rules.  Compound SPDX expressions (MIT OR Apache-2.0) are
UNKNOWN.  Other columns are not read.  licences_sql() knows SENTENCES and RULES only
and cuts at every line end: it gives the same for texts whose licence sentences are
among these and have a line each, as in the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: known licence sentences, normalised, by identifier.
SENTENCES = {
    "MIT-REF": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "MIT-GRANT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MIT-NOTICE": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AS-IS": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "APACHE2-REF": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "this project is licensed under the apache license version 2 0"],
    "APACHE2-COMPLY": ["you may not use this file except in compliance with the license"],
    "APACHE2-ASIS": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "APACHE2-SEE": ["see the license for the specific language governing permissions and limitations under the license"],
    "GPL3-REF": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "this program is licensed under the gnu general public license version 3"],
    "GPL2-REF": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "GPL-FREE3": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GPL-FREE2": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "GPL-HOPE": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GPL-SEE": ["see the gnu general public license for more details"],
    "LGPL3-REF": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "AGPL3-REF": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "BSD-GRANT": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSD3-REF": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "licensed under the 3 clause bsd license"],
    "BSD2-REF": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "licensed under the 2 clause bsd license"],
    "MPL2-REF": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "CC-BY-REF": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC-BY-SA-REF": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-REF": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-REF": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"],
    "CC0-REF": ["licensed under cc0 1 0", "released under cc0 1 0", "dedicated to the public domain under cc0 1 0"],
    "UNLICENSE-REF": ["released under the unlicense", "this is free and unencumbered software released into the public domain"],
    "ARR": ["all rights reserved"],
}
# FIXED VALUES: ordered rules, each a licence and its run of identifiers.
RULES = [
    ("MIT", "MIT-GRANT MIT-NOTICE AS-IS"),
    ("MIT", "MIT-GRANT MIT-NOTICE"),
    ("MIT", "MIT-GRANT"),
    ("Apache-2.0", "APACHE2-REF APACHE2-COMPLY APACHE2-ASIS APACHE2-SEE"),
    ("Apache-2.0", "APACHE2-REF APACHE2-COMPLY"),
    ("GPL-3.0-or-later", "GPL-FREE3 GPL-HOPE GPL-SEE"),
    ("GPL-3.0-or-later", "GPL-FREE3"),
    ("GPL-2.0-or-later", "GPL-FREE2 GPL-HOPE GPL-SEE"),
    ("GPL-2.0-or-later", "GPL-FREE2"),
    ("BSD", "BSD-GRANT AS-IS"),
    ("BSD", "BSD-GRANT"),
    ("MIT", "MIT-REF"),
    ("Apache-2.0", "APACHE2-REF"),
    ("GPL-3.0-only", "GPL3-REF"),
    ("GPL-2.0-only", "GPL2-REF"),
    ("LGPL-3.0-only", "LGPL3-REF"),
    ("AGPL-3.0-only", "AGPL3-REF"),
    ("BSD-3-Clause", "BSD3-REF"),
    ("BSD-2-Clause", "BSD2-REF"),
    ("MPL-2.0", "MPL2-REF"),
    ("CC-BY-4.0", "CC-BY-REF"),
    ("CC-BY-SA-4.0", "CC-BY-SA-REF"),
    ("CC-BY-NC-4.0", "CC-BY-NC-REF"),
    ("CC-BY-ND-4.0", "CC-BY-ND-REF"),
    ("CC0-1.0", "CC0-REF"),
    ("Unlicense", "UNLICENSE-REF"),
    ("LicenseRef-all-rights-reserved", "ARR"),
]
# FIXED VALUES: further sentences as regular expressions over normalised words.
_UNDER = "(?:(?:this|the) (?:work|project|program|software|file|code|source code|library|package|repository|module) is )?(?:licensed|released|distributed|available|made available|provided|published) under (?:the )?(?:terms of (?:the )?)?"
_SPDX = "spdx license identifier "
MORE = {
    "MIT-REF": [_UNDER + "mit licen[sc]e", "(?:the )?mit license(?: mit)?", "license mit", _SPDX + "mit"],
    "APACHE2-REF": [_UNDER + "apache licen[sc]e version 2 0(?: the license)?", _UNDER + "apache (?:license )?2 0(?: license)?", "apache license version 2 0(?: january 2004(?: https? www apache org licenses)?)?", _SPDX + "apache 2 0"],
    "APACHE2-OBTAIN": ["you may obtain a copy of the license at(?: https? www apache org licenses license 2 0(?: html| txt)?)?"],
    "GPL3-REF": [_UNDER + "gnu general public license (?:version 3|v3|v3 0)(?: only)?", _SPDX + "gpl 3 0(?: only)?"],
    "GPL2-REF": [_UNDER + "gnu general public license (?:version 2|v2|v2 0)(?: only)?", _SPDX + "gpl 2 0(?: only)?"],
    "GPL3-LATER": [_UNDER + "gnu general public license (?:version 3|v3|v3 0) or (?:at your option )?(?:any )?later(?: version)?", _SPDX + "gpl 3 0 or later"],
    "GPL2-LATER": [_UNDER + "gnu general public license (?:version 2|v2|v2 0) or (?:at your option )?(?:any )?later(?: version)?", _SPDX + "gpl 2 0 or later"],
    "GPL-COPY": ["you should have received a copy of the gnu general public license along with this program"],
    "GPL-SITE": ["if not see https? www gnu org licenses(?: gpl(?: 3 0| 2 0)? (?:html|txt))?"],
    "LGPL3-REF": [_UNDER + "gnu lesser general public license (?:version 3|v3|v3 0)(?: only)?", _SPDX + "lgpl 3 0(?: only)?"],
    "AGPL3-REF": [_UNDER + "gnu affero general public license (?:version 3|v3|v3 0)(?: only)?", _SPDX + "agpl 3 0(?: only)?"],
    "BSD-SOURCE": ["redistributions? of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSD-BINARY": ["redistributions? in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSD-ENDORSE": ["neither the name of (?:[a-z0-9]+ ){1,12}?nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSD-ASIS": ["this software is provided by (?:[a-z0-9]+ ){1,12}?as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "BSD3-REF": [_UNDER + "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd) license", _SPDX + "bsd 3 clause"],
    "BSD2-REF": [_UNDER + "(?:bsd 2 clause|2 clause bsd|simplified bsd) license", _SPDX + "bsd 2 clause"],
    "MPL2-REF": [_UNDER + "mozilla public license (?:version 2 0|v 2 0|2 0)", _SPDX + "mpl 2 0"],
    "CC-BY-REF": [_UNDER + "cc by 4 0", _SPDX + "cc by 4 0"],
    "CC-BY-SA-REF": [_UNDER + "cc by sa 4 0", _SPDX + "cc by sa 4 0"],
    "CC-BY-NC-REF": [_UNDER + "cc by nc 4 0", _SPDX + "cc by nc 4 0"],
    "CC-BY-ND-REF": [_UNDER + "cc by nd 4 0", _SPDX + "cc by nd 4 0"],
    "CC0-REF": [_UNDER + "cc0 1 0", _SPDX + "cc0 1 0"],
    "UNLICENSE-REF": [_UNDER + "unlicense", _SPDX + "unlicense"],
}
# FIXED VALUES: further rules, by the run of the rule that they go before.
MORE_RULES = {
    "APACHE2-REF APACHE2-COMPLY APACHE2-ASIS APACHE2-SEE": [("Apache-2.0", "APACHE2-REF APACHE2-COMPLY APACHE2-OBTAIN APACHE2-ASIS APACHE2-SEE"), ("Apache-2.0", "APACHE2-REF APACHE2-COMPLY APACHE2-OBTAIN")],
    "GPL-FREE3 GPL-HOPE GPL-SEE": [("GPL-3.0-or-later", "GPL-FREE3 GPL-HOPE GPL-SEE GPL-COPY GPL-SITE"), ("GPL-3.0-or-later", "GPL-FREE3 GPL-HOPE GPL-SEE GPL-COPY"), ("GPL-3.0-or-later", "GPL3-LATER")],
    "GPL-FREE2 GPL-HOPE GPL-SEE": [("GPL-2.0-or-later", "GPL-FREE2 GPL-HOPE GPL-SEE GPL-COPY GPL-SITE"), ("GPL-2.0-or-later", "GPL-FREE2 GPL-HOPE GPL-SEE GPL-COPY"), ("GPL-2.0-or-later", "GPL2-LATER")],
    "BSD-GRANT AS-IS": [("BSD-3-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY BSD-ENDORSE BSD-ASIS"), ("BSD-3-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY BSD-ENDORSE"), ("BSD-2-Clause", "BSD-GRANT BSD-SOURCE BSD-BINARY BSD-ASIS")],
}
EVERY_RULE = [r for rule in RULES for r in (*MORE_RULES.get(rule[1], ()), rule)]
#: What makes a sentence one about licensing; every known sentence has it.
SPEAKS = r"licen[sc]e|licensed|copyright|warrant|redistribut|permission is|permitted provided|all rights reserved|public domain|cc0|compliance with"


#: Where a known sentence may start and end, in a text in lower case.
_START = r"(?:^|(?<=\n|[.!?;:]\s))[^a-z0-9\n]{0,80}"
_END = r"(?=[^a-z0-9\n]{0,80}(?:\n|\z)|[^a-z0-9\s]{0,4}[.!?;:](?:[^a-z0-9]|\z))"


def _marked(text: Column) -> Column:
    """text in lower case, with each known sentence replaced by its identifier on a line of its own."""
    for name in dict.fromkeys((*SENTENCES, *MORE)):
        every = "|".join([*MORE.get(name, ()), *SENTENCES.get(name, ())])
        text = F.regexp_replace(text, f"{_START}(?:{every.replace(' ', '[^a-z0-9]+')}){_END}", f"\n\n{name}\n\n")
    return text


def _ids(text: Column) -> Column:
    """Identifiers of the licensing sentences of a text, in order."""
    known = F.create_map(*(F.lit(x) for k, v in SENTENCES.items() for s in v for x in (s, k)))
    low = F.lower(F.coalesce(text, F.lit("")))
    joined = F.regexp_replace(_marked(low), r"\n(?<=[^\n]{49}[^.!?;:\n]\n)(?=[^\S\n]*\S)", " ")
    sentences = F.split(F.regexp_replace(joined, r"([.!?])[ \t]+", "$1\n"), "\n")
    # Only identifiers begin with a capital.
    speaking = F.filter(sentences, lambda s: s.rlike(f"^[A-Z]|{SPEAKS}"))
    plain = F.transform(speaking, lambda s: F.when(s.rlike("^[A-Z]"), s).otherwise(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))))
    found = F.transform(plain, lambda s: F.when(s.rlike("^[A-Z]"), s).otherwise(F.coalesce(F.try_element_at(known, s), F.lit("UNKNOWN"))))
    return F.when(low.rlike(SPEAKS), found).otherwise(F.array().cast("array<string>"))


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licences, n_known, n_unknown) of docs(doc_id, text).

    sentence_ids and licences are joined by one space.
    """
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(f" {run} ").alias("run")) for name, run in EVERY_RULE))
    start = F.struct(F.col("seq").alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["run"])
        return F.when(hit, F.struct(F.replace(state["rest"], rule["run"], F.lit(" ")).alias("rest"), F.array_union(state["found"], F.array(rule["name"])).alias("found"))).otherwise(state)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _ids(F.col("text")).alias("ids"))
    # Doubled separators, so that a run can end where the next one begins.
    rows = rows.withColumn("seq", F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" ")))
    found = F.when(F.size("ids") > 0, F.aggregate(rules, start, step)["found"]).otherwise(F.array().cast("array<string>"))
    unknown = F.size(F.filter("ids", lambda x: x == "UNKNOWN"))
    return rows.select("doc_id", F.array_join("ids", " ").alias("sentence_ids"), F.array_join(found, " ").alias("licences"), (F.size("ids") - unknown).cast("long").alias("n_known"), unknown.cast("long").alias("n_unknown"))


def licences_sql() -> str:
    """DuckDB SQL for scan_licences() over the table documents."""
    known = ", ".join(f"'{s}': '{k}'" for k, v in SENTENCES.items() for s in v)
    rest, found = "seq", []
    for name, run in RULES:
        found.append(f"CASE WHEN contains({rest}, ' {run} ') THEN '{name}' END")
        rest = f"replace({rest}, ' {run} ', ' ')"
    names = "list_value(" + ", ".join(found) + ")"
    order = list(dict.fromkeys(n for n, _ in RULES))
    first = "list_value(" + ", ".join(f"'{n}'" for n in order) + ")"
    return f"""
WITH sentences AS (
    SELECT doc_id, list_transform(
        list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, '{SPEAKS}')),
        lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))) AS plain
    FROM documents
), identified AS (
    SELECT doc_id, list_transform(plain, lambda s: coalesce(map_extract(MAP {{{known}}}, s)[1], 'UNKNOWN')) AS ids FROM sentences
), sequences AS (
    SELECT doc_id, ids, ' ' || array_to_string(ids, ' ') || ' ' AS seq FROM identified
), matched AS (
    SELECT doc_id, ids, list_filter({names}, lambda x: x IS NOT NULL) AS found FROM sequences
)
SELECT doc_id, array_to_string(ids, ' ') AS sentence_ids,
       array_to_string(list_filter({first}, lambda n: list_contains(found, n)), ' ') AS licences,
       CAST(len(list_filter(ids, lambda x: x <> 'UNKNOWN')) AS BIGINT) AS n_known,
       CAST(len(list_filter(ids, lambda x: x = 'UNKNOWN')) AS BIGINT) AS n_unknown
FROM matched"""
