"""Licences by sentence rules: a text's sentences are normalised and those known from licences and licence notices get an
identifier; the sequence of identifiers is matched against ordered rules, each a run of identifiers that makes a licence.

A rule takes its run out of the sequence, so a later, shorter rule cannot claim a part of what an earlier, longer one has
explained. All of it is DataFrame expressions over one row at a time: no shuffle, and texts without a word that every known
sentence has one of are not taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from ..plans.rows import project_where

#: Fixed values. Known sentences: identifier, and a pattern for the whole normalised sentence (lower case, words of a-z, 0-9 and +).
SENTENCES = {
    "Apache2Under": "(.* )?licensed under (the )?apache (software )?license( version)? 2( 0)?( the license)?",
    "Apache2Obtain": "you may obtain a copy of the license at.*",
    "Apache2Unless": "unless required by applicable law or agreed to in writing software .* as is basis.*",
    "Apache2See": "see the license for the specific language governing permissions and limitations under the license",
    "MitUnder": "(.* )?(licensed|released|distributed|available) under (the )?(terms of the )?(mit|expat|x11) license",
    "MitGrant": "(.* )?permission is hereby granted free of charge to any person obtaining a copy of this software.*",
    "MitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "AsIs": "(the |this )?software is provided (\")?as is( without)? .*",
    "NoLiability": "in no event shall .* be liable for any .*",
    "IscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*",
    "BsdUnder": "(.* )?(licensed|released|distributed|available) under (the )?(terms of the )?(3 clause |new |modified |revised )?bsd( 3 clause)? license",
    "BsdRedistribute": "redistribution and use in source and binary forms with or without modification are permitted.*",
    "BsdSource": "(1 )?redistributions of source code must retain the above copyright notice.*",
    "BsdBinary": "(2 )?redistributions in binary form must reproduce the above copyright notice.*",
    "BsdEndorse": "(3 )?neither the name of .* may be used to endorse or promote products .*",
    "BsdAsIs": "this software is provided by .* as is and any express or implied warranties .*",
    "GplUnder3": "(.* )?licensed under (the )?(terms of the )?(gnu )?(general public license|gpl)( version| v)? ?v?3( 0)?( only)?",
    "GplUnder2": "(.* )?licensed under (the )?(terms of the )?(gnu )?(general public license|gpl)( version| v)? ?v?2( 0)?( only)?",
    "GplFree3": "(.* )?you can redistribute it and or modify it under the terms of the gnu general public license .* version 3 .*any later version",
    "GplFree2": "(.* )?you can redistribute it and or modify it under the terms of the gnu general public license .* version 2 .*any later version",
    "LgplUnder": "(.* )?licensed under (the )?(gnu )?(lesser general public license|lgpl).*",
    "NoWarranty": "(this|the) (program|library|software) is distributed in the hope that it will be useful but without any warranty.*",
    "MplUnder": "(this source code form is subject to the terms of the mozilla public license( v)? 2 0|(.* )?licensed under (the )?(mozilla public license|mpl)( version)? 2 0)",
    "CcByNc4": "(.* )?licensed under (a |the )?(cc|creative commons) (by nc|attribution noncommercial) 4 0.*",
    "CcBySa4": "(.* )?licensed under (a |the )?(cc|creative commons) (by sa|attribution sharealike) 4 0.*",
    "CcBy4": "(.* )?licensed under (a |the )?(cc|creative commons) (by|attribution) 4 0.*",
    "Cc0": "(.* )?(licensed|released|dedicated) (under|to) .*(cc0|public domain)( .*)?",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "Spdx": "spdx license identifier .*",
}

#: Fixed values. Ordered rules: the licence, and the run of sentences that makes it.
RULES = [
    ("Apache-2.0", ["Apache2Under", "Apache2Obtain", "Apache2Unless", "Apache2See"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs", "NoLiability"]),
    ("BSD-3-Clause", ["BsdRedistribute", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "NoLiability"]),
    ("BSD-2-Clause", ["BsdRedistribute", "BsdSource", "BsdBinary", "BsdAsIs", "NoLiability"]),
    ("BSD-3-Clause", ["BsdRedistribute", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdRedistribute", "BsdSource", "BsdBinary"]),
    ("GPL-3.0-or-later", ["GplFree3", "NoWarranty"]),
    ("GPL-2.0-or-later", ["GplFree2", "NoWarranty"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("ISC", ["IscGrant"]),
    ("GPL-3.0-or-later", ["GplFree3"]),
    ("GPL-2.0-or-later", ["GplFree2"]),
    ("Apache-2.0", ["Apache2Under"]),
    ("MIT", ["MitUnder"]),
    ("BSD-3-Clause", ["BsdUnder"]),
    ("GPL-3.0-only", ["GplUnder3"]),
    ("GPL-2.0-only", ["GplUnder2"]),
    ("LGPL", ["LgplUnder"]),
    ("MPL-2.0", ["MplUnder"]),
    ("CC-BY-NC-4.0", ["CcByNc4"]),
    ("CC-BY-SA-4.0", ["CcBySa4"]),
    ("CC-BY-4.0", ["CcBy4"]),
    ("CC0-1.0", ["Cc0"]),
    ("Unlicense", ["Unlicense"]),
]
HINT = "licen[cs]e|permission|redistribut|warrant|copyright|public domain|in no event|as is"
#: Signs of a comment before a line; the end of a sentence, which a version's "v." is not and a line's end is not either.
PREFIX = "(?m)^[ \\t]*(?://+|#+|/?\\*+/?|--+|;+|>+|%+)[ \\t]*"
END = "(?<![vV])[.!?]+[ \\t\\r\\n]+|[.!?]+$|\\n[ \\t\\r]*\\n"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9+]+", " "))


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, the first that fits; null if none does."""
    return F.coalesce(*[F.when(sentence.rlike(f"^({p})$"), F.lit(k)) for k, p in SENTENCES.items()])


def identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, ids): the identifiers of each text's known sentences in order. A sentence may go over several lines of a
    paragraph; where single lines of it are known, as one-line notices are, they count instead."""
    rows, hint = common.texts(docs), HINT + "|cc0"
    sentences = F.split(F.regexp_replace(F.regexp_replace("text", PREFIX, ""), END, "\u0001"), "\u0001")

    def known(sentence: Column) -> Column:
        one = lambda s: F.filter(F.transform(s, lambda x: identifier(normalised(x))), lambda k: k.isNotNull())
        lines = one(F.filter(F.split(sentence, "\n"), lambda x: F.lower(x).rlike(hint)))
        return F.when(F.size(lines) > 0, lines).otherwise(one(F.array(sentence)))
    found = F.when(F.lower("text").rlike(hint), F.flatten(F.transform(F.filter(sentences, lambda s: F.lower(s).rlike(hint)), known)))
    return project_where(rows, F.lit(True), F.col("doc_id"), F.coalesce(found, F.array().cast("array<string>")).alias("ids"))


def matched(ids: Column) -> tuple[Column, Column]:
    """(licences by rule order, what no rule took) of a sequence of identifiers."""
    left, said = F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">")), []
    for name, run in RULES:
        run = "".join(f"<{k}>" for k in run)
        said.append(F.when(left.contains(run), F.lit(name)))
        left = F.replace(left, F.lit(run), F.lit("|"))
    return F.array_distinct(F.filter(F.array(*said), lambda x: x.isNotNull())), left


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences recognised, sentence_ids, licences (both joined by commas), n_left, the
    recognised sentences that no rule took.

    Null and empty texts have none of these; repeated rows are scanned each; extra columns are left behind; an empty table
    gives no rows.
    """
    licences, left = matched(F.col("ids"))
    some = F.size("ids") > 0
    return identifiers(docs).select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        F.when(some, F.array_join(licences, ",")).otherwise("").alias("licences"),
        F.when(some, F.length(left) - F.length(F.replace(left, F.lit("<"), F.lit("")))).otherwise(0).cast("long").alias("n_left"))


def oracle() -> str:
    """DuckDB SQL of the scan over `documents`."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_full_match(n, {quote(p)}) THEN {quote(k)}" for k, p in SENTENCES.items())
    steps, name = [], "s0"
    for i, (licence, run) in enumerate(RULES):
        run = "".join(f"<{k}>" for k in run)
        steps.append(f"s{i + 1} AS (SELECT * EXCLUDE (seq, got), CASE WHEN contains(seq, '{run}') AND NOT list_contains(got, '{licence}') THEN list_append(got, '{licence}') ELSE got END AS got, "
                     f"replace(seq, '{run}', '|') AS seq FROM {name})")
        name = f"s{i + 1}"
    return f"""
WITH parts AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(coalesce(text, ''), '[.!?]+[ \\t\\r\\n]+|[.!?]+$|\\n[ \\t\\r]*\\n|\\n', chr(10), 'g'), chr(10)) AS p FROM documents
), each AS (
  SELECT r, doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM parts
), named AS (
  SELECT r, i, CASE {cases} END AS k
  FROM (SELECT r, i, trim(regexp_replace(lower(s), '[^a-z0-9+]+', ' ', 'g')) AS n FROM each WHERE regexp_matches(lower(s), '{HINT}'))
), s0 AS (
  SELECT p.r, p.doc_id, coalesce(l.ids, []) AS ids, '<' || array_to_string(coalesce(l.ids, []), '><') || '>' AS seq, []::VARCHAR[] AS got
  FROM parts p LEFT JOIN (SELECT r, list(k ORDER BY i) AS ids FROM named WHERE k IS NOT NULL GROUP BY r) l USING (r)
), {", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(got, ',') AS licences,
       CAST(CASE WHEN len(ids) = 0 THEN 0 ELSE length(seq) - length(replace(seq, '<', '')) END AS BIGINT) AS n_left
FROM {name}
"""
