"""License recognition by sentence rules, with DataFrame operations only.

A text is split into sentences, each normalised to lower-case words; known
license sentences become identifiers, and a document's sequence of identifiers
is matched against rules that name the identifiers of a license in order.
Other known sentences may come between. A line ends a sentence or not: a known
sentence may start and end with any line and be wrapped over several, but not go
on over a blank line.

Edge cases: null and empty texts have no sentences; a sentence counts as often
as it occurs, wherever in the text; null doc_ids and repeated rows pass
through, one result a row; extra columns are not read; an empty table gives an
empty result; texts are never cut.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: What ends a sentence, whatever the lines: signs before white space, and lines without letters or digits.
SPLIT = r"[.!?;]+[ \t\r\n]+|\n(?:[^\p{L}\p{N}\n]*\n)+"

#: Normalised license sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-name",
    "licensed under the mit license": "mit-name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "licensed under the apache license version 2 0": "apache-2-name",
    "licensed under the apache license version 2 0 the license": "apache-2-name",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "apache-2-grant",
    "this work is licensed under the gnu general public license version 3": "gpl-3-name",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 2 of the license or at your option any later version": "gpl-2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "either version 2 1 of the license or at your option any later version": "lgpl-2-1-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-later",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "licensed under cc by nc 4 0": "cc-by-nc-name",
    "licensed under cc by 4 0": "cc-by-name",
    "licensed under cc by sa 4 0": "cc-by-sa-name",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all rights reserved": "reserved",
}
#: License, whether its use is restricted, and the identifiers it takes, in order.
RULES = [
    ("0BSD", False, ["0bsd-grant"]),
    ("AGPL-3.0-or-later", True, ["agpl-3-later"]),
    ("Apache-2.0", False, ["apache-2-name"]),
    ("Apache-2.0-header", False, ["apache-2-name", "apache-comply", "apache-copy", "apache-basis", "apache-see"]),
    ("Apache-2.0-text", False, ["apache-2-grant"]),
    ("BSD-2-Clause", False, ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", False, ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("CC-BY-4.0", False, ["cc-by-name"]),
    ("CC-BY-NC-4.0", True, ["cc-by-nc-name"]),
    ("CC-BY-SA-4.0", True, ["cc-by-sa-name"]),
    ("GPL-2.0-or-later", True, ["gpl-terms", "gpl-2-later"]),
    ("GPL-3.0", True, ["gpl-3-name"]),
    ("GPL-3.0-or-later", True, ["gpl-3-later"]),
    ("ISC", False, ["isc-grant"]),
    ("LGPL-2.1-or-later", True, ["lgpl-terms", "lgpl-2-1-later"]),
    ("LGPL-3.0-or-later", True, ["lgpl-3-later"]),
    ("MIT", False, ["mit-name"]),
    ("MIT-text", False, ["mit-grant", "mit-notice"]),
    ("MPL-2.0", True, ["mpl-2-notice"]),
    ("Proprietary", True, ["reserved"]),
    ("Unlicense", False, ["unlicense-domain"]),
]
#: Sentences and rules that a scan takes, at most: they are part of its plan.
MOST = 2_000
#: Normalised texts have lower-case words only: B stands where a sentence ends, L where just a line does.
BREAK, LINE = "B", "L"


def alternatives(sentences: dict[str, str], gap: str) -> str:
    """A pattern of the known sentences, the longest first, with ``gap`` between words."""
    return "|".join(k.replace(" ", gap) for k in sorted(sentences, key=lambda k: (-len(k), k)))


def hint(sentences: dict[str, str]) -> str:
    """Matches texts that may hold a known sentence: one of a few words that each of them holds."""
    usual = [w for w in ("license", "licensed", "copyright", "reserved", "granted", "permitted") if any(w in k.split() for k in sentences)]
    rest = {max(k.split(), key=len) for k in sentences if not set(usual) & set(k.split())}
    return "(?i)" + "|".join([*usual, *sorted(rest)])


def rule_pattern(ids: list[str]) -> str:
    """Matches |a|b|...| sequences that hold the identifiers in order."""
    return r"\|" + r"\|(?:[^|]+\|)*".join(ids) + r"\|"


def load(sentences: DataFrame, rules: DataFrame) -> tuple[dict[str, str], list[tuple]]:
    """Sentences and rules for ``license_scan`` from tables (sentence, id) and (name, restricted, ids), of at most MOST rows each."""
    known = {" ".join(re.findall("[a-z0-9]+", r["sentence"].lower())): r["id"] for r in sentences.limit(MOST + 1).collect()}
    named = sorted((r["name"], bool(r["restricted"]), list(r["ids"])) for r in rules.limit(MOST + 1).collect())
    if max(len(known), len(named)) > MOST:
        raise ValueError(f"more than {MOST} sentences or rules")
    return {k: v for k, v in known.items() if k}, named


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple] = RULES) -> DataFrame:
    """doc_id, sentence_ids, n_sentences, licenses and restricted of every row of ``docs`` (doc_id, text)."""
    known = F.create_map(*(F.lit(x) for pair in sentences.items() for x in pair))
    pattern = f"(?<=[{BREAK}{LINE}])(?:{alternatives(sentences, f'[ {LINE}]')})(?=[{BREAK}{LINE}])"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.regexp_replace(F.lower(text), SPLIT, BREAK)
    plain = F.regexp_replace(F.regexp_replace(plain, r"\n", LINE), f"[^a-z0-9{BREAK}{LINE}]+", " ")
    plain = F.concat(F.lit(BREAK), F.regexp_replace(F.trim(plain), f" ?([{BREAK}{LINE}]) ?", "$1"), F.lit(BREAK))
    ids = F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)), lambda s: F.try_element_at(known, F.translate(s, LINE, " ")))
    ids = F.when(text.rlike(hint(sentences)), F.array_compact(ids)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("ids"))
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", "|").alias("sentence_ids"))
    sequence = F.concat(F.lit("|"), "sentence_ids", F.lit("|"))
    found = F.array_compact(F.array(*(F.when(sequence.rlike(rule_pattern(ids)), F.lit(name)) for name, _, ids in rules)))
    restricted = F.array(*(F.lit(name) for name, limits, _ in rules if limits)).cast("array<string>")
    return rows.withColumn("found", found).select("doc_id", "sentence_ids", "n_sentences", F.array_join("found", ",").alias("licenses"), F.arrays_overlap("found", restricted).alias("restricted"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    rules = ", ".join(f"('{name}', {str(limits).lower()}, '{rule_pattern(ids)}')" for name, limits, ids in RULES)
    # Marks are doubled, so that neighbouring sentences need not share one.
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), rules(name, limits, pattern) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT row, 'B' || regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '{SPLIT}', 'B', 'g'), '\n', 'L', 'g'), '[^a-z0-9BL]+', ' ', 'g')), ' ?([BL]) ?', '\1', 'g') || 'B' AS plain FROM d WHERE regexp_matches(text, '{hint(SENTENCES)}')),
m AS (SELECT row, regexp_extract_all(regexp_replace(plain, '([BL])', '\1\1', 'g'), '[BL](?:{alternatives(SENTENCES, '(?: |LL)')})[BL]') AS found FROM p),
s AS (SELECT row, trim(regexp_replace(unnest(found), '[BL]+', ' ', 'g')) AS sentence, generate_subscripts(found, 1) AS i FROM m),
n AS (SELECT row, i, id FROM s JOIN known USING (sentence)),
q AS (SELECT row, string_agg(id, '|' ORDER BY i) AS ids, count(*) AS n FROM n GROUP BY row),
f AS (SELECT row, string_agg(name, ',' ORDER BY name) AS names, bool_or(limits) AS restricted FROM q JOIN rules ON regexp_matches('|' || q.ids || '|', rules.pattern) GROUP BY row)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(names, '') AS licenses, coalesce(restricted, false) AS restricted
FROM d LEFT JOIN q USING (row) LEFT JOIN f USING (row)
"""


OP8_SQL = _oracle()
