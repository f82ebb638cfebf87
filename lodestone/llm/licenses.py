"""Operator 2: licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: lower case, without copyright lines, equivalent
spellings made one, everything but letters and digits of ASCII and letters beyond turned
into single spaces.  The SHA-256 of the whole form is hash-joined to the digests of known
licence texts; the lines are looked up alone too, for notices inside other texts.

The known texts are a bounded table (`KNOWN` and the digests of longer texts, or the caller's; `MAX_KNOWN`
at most), so it is broadcast.  Texts of any length are read whole; lines that share a digest have the
smallest id.
Null and empty texts, and those of copyright lines alone, have an empty form, which
matches nothing.  Repeated rows and keys stay as they are.  An empty table gives an empty
table.  Other columns are not read, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

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
granted, provided that the above copyright notice and this permission notice appear in all copies.
{}"""

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to {}"""

#: Known licence texts and notices, by an SPDX-like identifier.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC.format(_AS_IS)),
    ("ISC", "ISC License\n" + _ISC.format(_AS_IS)),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _AS_IS),
    ("BSD-2-Clause", _CONDITIONS.format("")),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _CONDITIONS.format("")),
    ("BSD-3-Clause", _CONDITIONS.format(_ENDORSE)),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _CONDITIONS.format(_ENDORSE)),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("BSL-1.0", _BOOST),
    ("Unlicense", _UNLICENSE.format("<https://unlicense.org/>")),
    ("Unlicense", _UNLICENSE.format("<http://unlicense.org>")),
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
]

#: Spellings taken as equal (British, American and typographic forms).
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("authorise", "authorize"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("http ", "https "),
]


#: SHA-256 of the canonical forms of longer licences, as distributed (whole files).
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "a1299c9b9de23b00ccea4d3bf75e90110953f7e4ed1b84818f617ad01246122a"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7"),
]

#: Known texts up to which the table is broadcast and lines are looked up in a map.
MAX_KNOWN = 10_000

#: Characters between words; how copyright lines begin, and lines of a licence that begin like them.
SEPARATORS = r"[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{BF}\x{2010}-\x{201F}\x{2026}]+"
COPYRIGHT = r"^[ \t]*(copyright([^a-z]|$)|\(c\)|\x{A9}|all rights reserved[ \t.]*$)"
NO_NOTICE = r"^[ \t]*copyright[ \t]*([,.;:)]|$|(holders?|owners?|notices?|laws?|licen[cs]es?|statements?|disclaimers?|interests?|protection|infringement|works?|act|and|or|in|to|of|for|is|as|on|by the laws)([^a-z]|$))"


def is_notice(low: Column) -> Column:
    """Whether a lower-cased line states who holds the copyright."""
    return low.rlike(COPYRIGHT) & ~low.rlike(NO_NOTICE)


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; empty for copyright lines."""
    low = F.lower(line)
    form = F.trim(F.regexp_replace(low, SEPARATORS, " "))
    for other, one in SPELLINGS:
        form = F.replace(form, F.lit(other), F.lit(one))
    return F.when(is_notice(low), F.lit("")).otherwise(form)


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), lambda x: x != "")


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def registry(spark: SparkSession, known: list[tuple[str, str]] | None = None, digests: list[tuple[str, str]] | None = None) -> DataFrame:
    """Digest and id of the known texts, as rows of the plan itself."""
    texts, plain = (KNOWN if known is None else known), (DIGESTS if digests is None and known is None else digests or [])
    row = lambda i, t, d: F.struct(F.lit(i).alias("license_id"), F.lit(t).cast("string").alias("t"), F.lit(d).cast("string").alias("d"))
    table = spark.range(1).select(F.inline(F.array(*[row(i, t, None) for i, t in texts], *[row(i, None, d) for i, d in plain])))
    return table.select("license_id", F.coalesce("d", digest(F.array_join(canonical_lines(F.col("t")), " "))).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(frame: DataFrame, known: list[tuple[str, str]] | None = None, key: str = "doc_id", text: str = "text", digests: list[tuple[str, str]] | None = None) -> DataFrame:
    """Key, digest of the canonical text, license_id of the whole text (null: none), and
    line_licenses: the distinct ids found in single lines, sorted, joined by commas."""
    if len(known or KNOWN) + len(digests or DIGESTS) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known texts: join the digests of `canonical` with a table instead")
    found = registry(frame.sparkSession, known, digests)
    literals = [F.lit(x) for row in found.collect() for x in (row.digest, row.license_id)]  # a row for each known text
    by_digest = F.create_map(*literals)
    scanned = frame.select(F.col(key), canonical_lines(F.col(text)).alias("lines")).select(
        key,
        digest(F.array_join("lines", " ")).alias("digest"),
        F.array_join(
            F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda x: F.try_element_at(by_digest, digest(x))), lambda i: i.isNotNull()))), ","
        ).alias("line_licenses"),
    )
    return scanned.join(F.broadcast(found), "digest", "left").select(key, "digest", "license_id", "line_licenses")


def canonical(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and digest of the canonical text, to be joined with a table of any size."""
    return frame.select(F.col(key), digest(F.array_join(canonical_lines(F.col(text)), " ")).alias("digest"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_line(x: str) -> str:
    form = f"trim(regexp_replace(lower({x}), '{SEPARATORS}', ' ', 'g'), ' ')"
    for other, one in SPELLINGS:
        form = f"replace({form}, {_quoted(other)}, {_quoted(one)})"
    return f"CASE WHEN regexp_matches(lower({x}), '{COPYRIGHT}') AND NOT regexp_matches(lower({x}), '{NO_NOTICE}') THEN '' ELSE {form} END"


def sql() -> str:
    """The scan of `documents` in SQL."""
    known = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN)
    plain = ", ".join(f"({_quoted(i)}, {_quoted(d)})" for i, d in DIGESTS)
    forms = "list_filter(list_transform(string_split(@, chr(10)), lambda x: " + _sql_line("x") + "), lambda x: x <> '')"
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256(array_to_string({forms.replace("@", "t")}, ' ')) AS digest FROM (VALUES {known}) AS v(license_id, t)
    UNION ALL SELECT license_id, digest FROM (VALUES {plain}) AS p(license_id, digest)) GROUP BY digest
), forms AS (
  SELECT doc_id, {forms.replace("@", "coalesce(text, '')")} AS lines FROM documents
), hits AS (
  SELECT f.doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS ids
  FROM (SELECT doc_id, unnest(lines) AS line FROM forms) f JOIN known k ON sha256(f.line) = k.digest GROUP BY f.doc_id
)
SELECT f.doc_id, sha256(array_to_string(f.lines, ' ')) AS digest, k.license_id, coalesce(h.ids, '') AS line_licenses
FROM forms f LEFT JOIN known k ON k.digest = sha256(array_to_string(f.lines, ' ')) LEFT JOIN hits h ON h.doc_id = f.doc_id
"""
