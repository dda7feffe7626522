"""Licence scan by canonical digests: SQL functions only.

A text becomes canonical: lower case, copyright lines dropped (but for a notice
in the same line), equivalent spellings made one, everything but letters and
digits a single space.  The digests of the entire text, of its blocks (lines
between blank lines, so wrapping does not matter) and of its lines, each taken as
an entire text, are hash-joined to the digests of known licence texts and notices.
A known text of several blocks is found inside a file by its blocks: all of their
digests at consecutive positions.  A copyright goes with its whole line, so a known
text that has one inside is found if those lines are wrapped as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linearspark.llm.common import read_table, text_or_empty

#: Known digests are broadcast up to this many rows, beyond it they are joined by shuffle.
MAX_BROADCAST_KNOWN = 100_000

# Spellings that mean the same in licence texts.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("favour", "favor"), ("honour", "honor"), ("whilst", "while"), ("per cent", "percent"), ("https://", "http://"),
    ("copyright owner", "copyright holder"),
)
# Lines that state a copyright, and all that is neither letter nor digit within a line.
# A notice that follows the copyright in its line stays.
_NOTICE = r"(?:released|licensed|distributed|permission|redistribution|spdx|this (?:work|program|software|source))[^\p{L}\p{N}\n][^\n]*"
COPYRIGHT_LINE = (r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)"
                  rf"(?:[^\n]*?[^\p{{L}}\p{{N}}\n]({_NOTICE})|[^\n]*)")
OTHER = r"[^\p{L}\p{N}\n]+"

# Public licence texts and notices, by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity
of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
# Digests of the canonical entire texts of long public licences.
KNOWN_DIGESTS = (
    ("Apache-2.0", "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
)
KNOWN = (
    ("BSD-2-Clause", _BSD_2 + "\n\n" + _BSD_END), ("BSD-3-Clause", _BSD_2 + "\n\n" + _BSD_3 + "\n\n" + _BSD_END),
    ("Unlicense", _UNLICENSE),
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC + "\n\n" + _DISCLAIMER), ("ISC", "ISC License\n\n" + _ISC + "\n\n" + _DISCLAIMER),
    ("0BSD", _ZERO_BSD + "\n\n" + _DISCLAIMER),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


def _canonical(text: Column) -> Column:
    out = F.lower(text)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, "$1"), OTHER, " ")


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(_canonical(text), "\n", -1), lambda line: F.btrim(line))


def _lines(trimmed: Column) -> Column:
    return F.filter(trimmed, lambda line: line != "")


def _blocks(trimmed: Column) -> Column:
    blocks = F.split(F.array_join(trimmed, "\n"), "\n\n+", -1)
    return _lines(F.transform(blocks, lambda b: F.btrim(F.replace(b, F.lit("\n"), F.lit(" ")))))


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that are not empty."""
    return _lines(_trimmed(text))


def canonical_blocks(text: Column) -> Column:
    """The canonical text cut at blank lines, each block one line."""
    return _blocks(_trimmed(text))


def _known_rows(spark: SparkSession, known) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(number).alias("text_no"), F.lit(name).alias("license_id"), F.lit(text).alias("text"))
        for number, (name, text) in enumerate(known)])))


def known_digests(spark: SparkSession, known=KNOWN, digests=KNOWN_DIGESTS) -> DataFrame:
    """``(digest, license_id)`` of the canonical known texts and the digests known as such, distinct."""
    rows = _known_rows(spark, known).select(
        F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest"), "license_id")
    if digests:
        rows = rows.unionByName(spark.range(1).select(F.inline(F.array(*[
            F.struct(F.lit(digest).alias("digest"), F.lit(name).alias("license_id")) for name, digest in digests]))))
    return rows.distinct()


def known_blocks(spark: SparkSession, known=KNOWN) -> DataFrame:
    """``(text_no, license_id, n_blocks, ordinal, digest)`` of the known texts of several blocks."""
    rows = _known_rows(spark, known).select("text_no", "license_id", canonical_blocks(F.col("text")).alias("blocks"))
    return rows.select("text_no", "license_id", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("ordinal", "block")).filter(
        "n_blocks > 1").select("text_no", "license_id", "n_blocks", "ordinal", F.sha2("block", 256).alias("digest"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_KNOWN else df


def scan(docs: DataFrame, known: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text_digest, n_lines, license_ids, whole_text)``: the digest of
    the canonical text, its canonical lines, the known licences among text, blocks
    and lines (sorted, distinct), and whether the entire text is a known one.
    ``blocks`` has the known texts to be found by several blocks (none: no such search).

    A null or empty text has no lines and the digest of the empty text, which
    matches nothing.  Rows that repeat an id and a canonical text give one row;
    an empty table gives none; other columns are ignored.
    """
    # a step of its own, so that the canonical text is made once for lines and blocks
    cut = docs.select("doc_id", _trimmed(text_or_empty()).alias("t")).select("doc_id", _lines(F.col("t")).alias("lines"), _blocks(F.col("t")).alias("blocks"))
    key = ["doc_id", "n_lines", "text_digest"]
    digests = cut.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                         F.sha2(F.array_join("lines", " "), 256).alias("text_digest"), "lines", "blocks")
    units = digests.select(
        *key, F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_union("lines", "blocks"))).alias("line")).select(
        *key, F.col("line").isNull().alias("whole"), F.coalesce(F.sha2("line", 256), "text_digest").alias("digest"))
    found = units.join(_small(known.filter(F.col("digest") != F.sha2(F.lit(""), 256))), "digest", "left").select(*key, "whole", "license_id")
    if blocks is not None:
        placed = digests.select(*key, F.posexplode("blocks").alias("pos", "block")).select(*key, "pos", F.sha2("block", 256).alias("digest"))
        spans = placed.join(_small(blocks), "digest").groupBy(
            *key, "text_no", "license_id", "n_blocks", (F.col("pos") - F.col("ordinal")).alias("start")).agg(
            F.count_distinct("ordinal").alias("n")).filter("n = n_blocks")
        found = found.unionByName(spans.select(*key, F.lit(False).alias("whole"), "license_id"))
    return found.groupBy("doc_id", "text_digest", "n_lines").agg(
        F.sort_array(F.collect_set("license_id")).alias("license_ids"),
        F.max(F.col("whole") & F.col("license_id").isNotNull()).alias("whole_text")).select(
        "doc_id", "text_digest", "n_lines", "license_ids", "whole_text")


def op1_license_scan(spark, sf_dir) -> DataFrame:
    """doc_id, text_digest, n_lines, license_ids (comma-joined), whole_text of all documents."""
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), known_digests(spark), known_blocks(spark))
    return found.withColumn("license_ids", F.array_join("license_ids", ","))


def _sql_canonical(text: str) -> str:
    out = f"lower({text})"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"regexp_replace(regexp_replace({out}, '{COPYRIGHT_LINE}', '\\1', 'g'), '{OTHER}', ' ', 'g')"


_SQL_LINES = "[trim(x, ' ') for x in string_split(c, chr(10)) if trim(x, ' ') <> '']"
_SQL_BLOCKS = (r"[b for b in [trim(regexp_replace(x, ' ?\n ?', ' ', 'g'), ' ') for x in "
               r"regexp_split_to_array(c, '\n(?: ?\n)+')] if b <> '']")
_VALUES = ", ".join("({}, '{}', '{}')".format(number, name, text.replace("'", "''")) for number, (name, text) in enumerate(KNOWN))
_DIGESTS = "".join(f" UNION SELECT '{digest}', '{name}'" for name, digest in KNOWN_DIGESTS)
OP1_SQL = f"""
WITH texts AS (
  SELECT text_no, license_id, {_sql_canonical('text')} AS c FROM (VALUES {_VALUES}) AS k(text_no, license_id, text)),
known AS (SELECT DISTINCT sha256(array_to_string({_SQL_LINES}, ' ')) AS digest, license_id FROM texts{_DIGESTS}),
parts AS (
  SELECT text_no, license_id, len(bs) AS n_blocks, generate_subscripts(bs, 1) AS ordinal, sha256(unnest(bs)) AS digest
  FROM (SELECT text_no, license_id, {_SQL_BLOCKS} AS bs FROM texts) WHERE len(bs) > 1),
docs AS (
  SELECT doc_id, {_SQL_LINES} AS lines, {_SQL_BLOCKS} AS blocks
  FROM (SELECT doc_id, {_sql_canonical("coalesce(text, '')")} AS c FROM documents)),
digests AS (SELECT doc_id, lines, blocks, sha256(array_to_string(lines, ' ')) AS text_digest FROM docs),
placed AS (
  SELECT doc_id, text_digest, len(lines) AS n_lines, generate_subscripts(blocks, 1) AS pos, sha256(unnest(blocks)) AS digest
  FROM digests WHERE len(blocks) > 0),
spans AS (
  SELECT p.doc_id, p.text_digest, p.n_lines, k.license_id
  FROM placed p JOIN parts k ON p.digest = k.digest
  GROUP BY p.doc_id, p.text_digest, p.n_lines, k.text_no, k.license_id, k.n_blocks, p.pos - k.ordinal
  HAVING count(DISTINCT k.ordinal) = k.n_blocks),
units AS (
  SELECT doc_id, text_digest, len(lines) AS n_lines, true AS whole, text_digest AS digest FROM digests
  UNION ALL
  SELECT doc_id, text_digest, len(lines), false, sha256(unnest(list_distinct(list_concat(lines, blocks)))) FROM digests),
found AS (
  SELECT u.doc_id, u.text_digest, u.n_lines, u.whole, k.license_id FROM units u LEFT JOIN known k ON u.digest = k.digest
  UNION ALL
  SELECT doc_id, text_digest, n_lines, false, license_id FROM spans)
SELECT doc_id, text_digest, CAST(n_lines AS BIGINT) AS n_lines,
       coalesce(string_agg(DISTINCT license_id, ',' ORDER BY license_id), '') AS license_ids,
       bool_or(whole AND license_id IS NOT NULL) AS whole_text
FROM found GROUP BY doc_id, text_digest, n_lines
"""
