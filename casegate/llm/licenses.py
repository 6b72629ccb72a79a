"""Licence scans by sentence rules.  DataFrame functions only.

A text is lower-cased (A-Z) and read line by line: comment marks go, wrapped lines are joined.  A sentence
ends at ``. ; : ! ?`` before white space (not in ``v. 2.0``), at lines without a letter or digit, and before
lines that open like a licence notice; a ``License-Identifier:`` tag is a sentence with each licence of its
expression (exceptions after ``WITH`` do not count).  Sentences are reduced to letters and digits.  Those
that speak of licences are mapped to the identifier of the first known licence sentence they hold; the
others of them, and references that are denied ("may not be used under ..."), are ``Unknown``.  The sequence
of identifiers is matched against ordered licence rules: each rule that occurs names its licence and uses up
its identifiers, so that a whole licence text goes before its parts.

Defined results: a null text is empty; null ids and repeated rows are each returned; an empty table
gives no rows; only the named columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What licence sentences say once reduced (regular expressions over a-z, 0-9 and space),
# in the order in which they are tried.
SENTENCES = (
    ("SpdxMIT", "spdx license identifier mit$"),
    ("SpdxApache2", "spdx license identifier apache 2 0$"),
    ("SpdxGPL2", "spdx license identifier gpl 2 0( only| or later)?$"),
    ("SpdxGPL3", "spdx license identifier gpl 3 0( only| or later)?$"),
    ("SpdxBSD2", "spdx license identifier bsd 2 clause$"),
    ("SpdxBSD3", "spdx license identifier bsd 3 clause$"),
    ("SpdxMPL2", "spdx license identifier mpl 2 0$"),
    ("SpdxAGPL3", "spdx license identifier agpl 3 0( only| or later)?$"),
    ("SpdxLGPL21", "spdx license identifier lgpl 2 1( only| or later)?$"),
    ("SpdxLGPL3", "spdx license identifier lgpl 3 0( only| or later)?$"),
    ("SpdxISC", "spdx license identifier isc$"),
    ("SpdxEPL2", "spdx license identifier epl 2 0$"),
    ("SpdxUnlicense", "spdx license identifier unlicense$"),
    ("ApacheRef", "licensed under the apache license version 2 0|under the terms of the apache license version 2 0"),
    ("ApacheCompliance", "you may not use this file except in compliance with the license"),
    ("ApacheObtain", "you may obtain a copy of the license at"),
    ("ApacheAsIs", "distributed under the license is distributed on an as is basis"),
    ("ApacheLimits", "see the license for the specific language governing permissions and limitations under the license"),
    ("AfferoRef3", "gnu affero general public license.*version 3"),
    ("LesserRef21", "gnu lesser general public license.*version 2 1"),
    ("LesserRef3", "gnu lesser general public license.*version 3"),
    ("GPLRef3", "gnu general public license.*version 3"),
    ("GPLRef2", "gnu general public license.*version 2"),
    ("GPLWarranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPLCopy", "you should have received a copy of the gnu general public license"),
    ("MPLRef2", "mozilla public license (v ?|version )?2 0"),
    ("EPLRef2", "eclipse public license (v ?|version )?2 0"),
    ("CCByNcSa4", "cc by nc sa 4 0|creative commons attribution non ?commercial share ?alike 4 0"),
    ("CCByNcNd4", "cc by nc nd 4 0|creative commons attribution non ?commercial no ?deriv(ative)?s 4 0"),
    ("CCByNc4", "cc by nc 4 0|creative commons attribution non ?commercial 4 0"),
    ("CCBySa4", "cc by sa 4 0|creative commons attribution share ?alike 4 0"),
    ("CCBy4", "cc by 4 0|creative commons attribution 4 0"),
    ("CCZero", "cc0 1 0|creative commons zero"),
    ("MITRef", "(under|terms of) the mit license"),
    ("MITGrant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("MITNotice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("MITWarranty", "the software is provided as is without warranty of any kind"),
    ("BSDRef2", "under the (bsd 2 clause|2 clause bsd|simplified bsd) license"),
    ("BSDRef3", "under the (bsd 3 clause|3 clause bsd|new bsd) license"),
    ("BSDGrant", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSDSource", "redistributions of source code must retain the above copyright notice"),
    ("BSDBinary", "redistributions in binary form must reproduce the above copyright notice"),
    ("BSDEndorse", "neither the name of .* may be used to endorse or promote products derived from this software"),
    ("BSDWarranty", "this software is provided by the copyright holders and contributors as is"),
    ("ISCGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("UnlicenseGrant", "this is free and unencumbered software released into the public domain"),
    ("AllRights", "all rights reserved"),
    ("Copyright", "copyright (c )?[0-9]{4}"),
)
# Licences and the sentence sequences that grant them, in the order in which they are tried.
RULES = (
    ("Apache-2.0", ("ApacheRef", "ApacheCompliance", "ApacheObtain", "ApacheAsIs", "ApacheLimits")),
    ("Apache-2.0", ("ApacheRef", "ApacheCompliance", "ApacheObtain")),
    ("MIT", ("MITGrant", "MITNotice", "MITWarranty")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDWarranty")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDWarranty")),
    ("GPL-3.0", ("GPLRef3", "GPLWarranty", "GPLCopy")),
    ("GPL-2.0", ("GPLRef2", "GPLWarranty", "GPLCopy")),
    ("ISC", ("ISCGrant",)),
    ("Unlicense", ("UnlicenseGrant",)),
    ("AGPL-3.0", ("AfferoRef3",)),
    ("LGPL-2.1", ("LesserRef21",)),
    ("LGPL-3.0", ("LesserRef3",)),
    ("GPL-3.0", ("GPLRef3",)),
    ("GPL-2.0", ("GPLRef2",)),
    ("MPL-2.0", ("MPLRef2",)),
    ("EPL-2.0", ("EPLRef2",)),
    ("CC-BY-NC-SA-4.0", ("CCByNcSa4",)),
    ("CC-BY-NC-ND-4.0", ("CCByNcNd4",)),
    ("CC-BY-NC-4.0", ("CCByNc4",)),
    ("CC-BY-SA-4.0", ("CCBySa4",)),
    ("CC-BY-4.0", ("CCBy4",)),
    ("CC0-1.0", ("CCZero",)),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MITRef",)),
    ("MIT", ("MITGrant",)),
    ("BSD-2-Clause", ("BSDRef2",)),
    ("BSD-3-Clause", ("BSDRef3",)),
    ("MIT", ("SpdxMIT",)),
    ("Apache-2.0", ("SpdxApache2",)),
    ("GPL-2.0", ("SpdxGPL2",)),
    ("GPL-3.0", ("SpdxGPL3",)),
    ("BSD-2-Clause", ("SpdxBSD2",)),
    ("BSD-3-Clause", ("SpdxBSD3",)),
    ("MPL-2.0", ("SpdxMPL2",)),
    ("AGPL-3.0", ("SpdxAGPL3",)),
    ("LGPL-2.1", ("SpdxLGPL21",)),
    ("LGPL-3.0", ("SpdxLGPL3",)),
    ("ISC", ("SpdxISC",)),
    ("EPL-2.0", ("SpdxEPL2",)),
    ("Unlicense", ("SpdxUnlicense",)),
    ("proprietary", ("AllRights",)),
)
#: Words of which a licence sentence holds one.
SPEAKS = "licen[cs]e|copyright|permission is|permission to|redistribution|warrant|all rights reserved|endorse or promote|provided by the copyright|public domain|as is basis|creative commons| cc by | cc0 "
#: The same before reduction, for a quick look at a whole text.
_SPEAKS_RAW = "(?i)licen[cs]e|copyright|permission|redistribution|warrant|rights|endorse|domain|basis|creative|cc"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Sentences that refer to a licence, and what denies a reference.
_REFERS = "Ref|^CC"
_DENIED = "(^| )(not|never|cannot|no longer|nor|neither) ([a-z0-9]+ ){0,6}(under|licensed) "


def _named(sentence: str, found: str) -> str:
    """SQL: the identifier of a reduced sentence, null for one that is not about licences; ``found``
    is the dialect's test of a pattern."""
    denied = found.format(sentence, _DENIED)
    cases = " ".join(
        f"when {found.format(sentence, pattern)}{f' and not {denied}' if re.search(_REFERS, name) else ''} then '{name}'" for name, pattern in SENTENCES
    )
    return f"case when not {found.format(f'concat({chr(39)} {chr(39)}, {sentence}, {chr(39)} {chr(39)})', SPEAKS)} then null {cases} else 'Unknown' end"


# Patterns of lines, for lower-cased text; Java and RE2 read them alike.
#: Comment marks where a line begins.
_MARKS = r"^[ \t]*[/*#;%<!>|-]*[ \t]*((rem|dnl)[ \t]+)?"
#: How licence notices open.
_OPENS = (
    r"^(licen[cs]ed under|released under|distributed under|copyright +(\(c\)|©|[0-9])|permission is hereby|permission to use|"
    r"redistribution and use|all rights reserved|this (program|library|work|file|software|code|project) is )"
)
_TAG = "license-identifier:"
_EXCEPTION = r"[ \t]+with[ \t]+[a-z0-9.+-]+"
_OPERATOR = r"[ \t]+(and|or)[ \t]+"
_VERSION = r"(^|[^a-z])(v|ver|version)\.[ ]+([0-9])"
_STOP = r"([.;:!?])[ \t\r\n]+"


def sentences(text: Column) -> Column:
    """The reduced sentences of a text, in order."""
    lower = F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"\r\n?", "\n")

    def read(line: Column) -> Column:
        line = F.regexp_replace(line, _MARKS, "")
        at = F.instr(line, _TAG)
        value = F.regexp_replace(F.trim(F.substring(line, at + len(_TAG), F.length(line))), _EXCEPTION, "")
        tagged = F.concat(
            F.lit("\n\n"), F.substring(line, F.lit(1), at + len(_TAG) - 1), F.regexp_replace(value, _OPERATOR, f"\n\nspdx-{_TAG}"), F.lit("\n\n")
        )
        opening = F.when(line.rlike(_OPENS), F.concat(F.lit("\n\n"), line)).otherwise(line)
        return F.when(~line.rlike("[a-z0-9]"), "").when(at > 0, tagged).otherwise(opening)

    joined = F.array_join(F.transform(F.split(lower, "\n"), read), "\n")
    joined = F.regexp_replace(F.regexp_replace(joined, "\n{2,}", "\r"), "\n", " ")
    cut = F.split(F.regexp_replace(F.regexp_replace(joined, _VERSION, "$1$2 $3"), _STOP, "$1\n"), "[\r\n]+")
    return F.transform(cut, lambda part: F.trim(F.regexp_replace(part, "[^a-z0-9]+", " ")))


def scan(docs: DataFrame, id_col: Column, text_col: Column) -> DataFrame:
    """``id, sentence_ids, licenses, n_unknown``: identifiers in text order, licences in rule order
    without repeats, both comma-joined, and the number of licence sentences that are not known."""
    text = text_col.cast("string")
    none = F.array().cast("array<string>")
    read = docs.select(id_col.alias("id"), F.when(text.rlike(_SPEAKS_RAW), sentences(text)).otherwise(none).alias("cut"))
    named = _named("s", "{0} rlike '{1}'")
    ids = f"filter(transform(cut, s -> {named}), i -> i is not null)"
    listed = read.selectExpr("id", f"coalesce({ids}, cast(array() as array<string>)) ids")
    rules = ", ".join(f"struct('{name}' name, ',{',,'.join(sequence)},' seq)" for name, sequence in RULES)
    walked = f"""
      aggregate(array({rules}),
        named_struct('rest', array_join(transform(ids, i -> concat(',', i, ',')), ''), 'found', cast(array() as array<string>)),
        (a, r) -> if(instr(a.rest, r.seq) > 0,
          named_struct('rest', replace(a.rest, r.seq, ',,'), 'found', array_append(a.found, r.name)), a)).found
    """
    return listed.selectExpr(
        "id",
        "array_join(ids, ',') sentence_ids",
        f"if(size(ids) = 0, '', array_join(array_distinct({walked}), ',')) licenses",
        "cast(size(filter(ids, i -> i = 'Unknown')) as long) n_unknown",
    )


def oracle(documents: str = "documents") -> str:
    """The same as DuckDB SQL: sentences as rows, one step a rule."""
    named = _named("s", "regexp_matches({0}, '{1}')")
    steps, last = [], "walk0"
    for at, (name, sequence) in enumerate(RULES, 1):
        seq = f",{',,'.join(sequence)},"
        steps.append(
            f"walk{at} AS (SELECT doc_id, ids, replace(rest, '{seq}', ',,') rest, "
            f"CASE WHEN contains(rest, '{seq}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END found FROM {last})"
        )
        last = f"walk{at}"
    return f"""
    WITH lines AS (
      SELECT row_number() OVER () AS row, doc_id,
        list_transform(string_split(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '\\r\\n?', '\n', 'g'), '\n'),
          lambda line: regexp_replace(line, '{_MARKS}', '')) AS lines
      FROM {documents}),
    joined AS (
      SELECT row, doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(lines, lambda line:
        CASE WHEN NOT regexp_matches(line, '[a-z0-9]') THEN ''
          WHEN contains(line, '{_TAG}') THEN '\n\n' || line[:instr(line, '{_TAG}') + {len(_TAG) - 1}] ||
            regexp_replace(regexp_replace(trim(line[instr(line, '{_TAG}') + {len(_TAG)}:]), '{_EXCEPTION}', '', 'g'), '{_OPERATOR}', '\n\nspdx-{_TAG}', 'g') || '\n\n'
          WHEN regexp_matches(line, '{_OPENS}') THEN '\n\n' || line ELSE line END), '\n'), '\n{{2,}}', '\r', 'g'), '\n', ' ', 'g') AS text
      FROM lines),
    cut AS (
      SELECT row, doc_id, string_split_regex(
        regexp_replace(regexp_replace(text, '{_VERSION}', '\\1\\2 \\3', 'g'), '{_STOP}', '\\1\n', 'g'), '[\r\n]+') AS parts FROM joined),
    sentences AS (
      SELECT row, doc_id, unnest(parts) part, unnest(range(len(parts))) place FROM cut),
    reduced AS (
      SELECT row, doc_id, place, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) s FROM sentences),
    named AS (SELECT row, doc_id, place, {named} i FROM reduced),
    walk0 AS MATERIALIZED (
      SELECT any_value(doc_id) doc_id, coalesce(list(i ORDER BY place) FILTER (i IS NOT NULL), CAST([] AS VARCHAR[])) ids,
        coalesce(string_agg(',' || i || ',', '' ORDER BY place) FILTER (i IS NOT NULL), '') rest, CAST([] AS VARCHAR[]) found
      FROM named GROUP BY row),
    {", ".join(steps)}
    SELECT doc_id, array_to_string(ids, ',') sentence_ids, array_to_string(found, ',') licenses,
      CAST(len(list_filter(ids, lambda i: i = 'Unknown')) AS BIGINT) n_unknown
    FROM {last}
    """
