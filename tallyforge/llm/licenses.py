"""License scans by canonical digest.

A text is brought to a canonical form (lower case, copyright notices dropped, punctuation and white space folded,
equivalent spellings unified), digested with SHA-256, and looked up among the digests of known licences: the whole
text by a hash join, and each line that speaks of a licence by the same digest. Only DataFrame functions are used.

Defined cases: a null text has no digest and no licence; an empty canonical form has a digest but no licence; equal
texts give equal rows; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words after "copyright" or "(c)" that show a clause whose wrap begins a line, not a notice.
_CLAUSE = (
    r"(?:(?:holders?|owners?|ownership|notices?|laws?|licen[sc]es?|licen[sc]ing|permissions?|interests?|disclaimers?|treaty|treaties|doctrines?|statements?|claims?|rights?|"
    r"protection|infringement|material|status|information|and|or|on|in|of|for|to|as|is|are|under|that|which|if|with)(?![0-9a-z])|the[ \t]+(?:software|program|library|work)(?![0-9a-z]))"
)
_ITEM = r"(?:you|your|under|the|this|that|if|any|all|an?|each|no|in|to|for|as|or|and|neither|convey|accompany|prohibiting)(?![0-9a-z])"
_LEAD, _NAME = r"[ \t*#/]*", r"[^\t-\r .,;:()/'\x22-]"
#: A line that is a notice: "copyright" before (c), ©, a year, "by" or a name; "(c)" that numbers no clause; ©.
COPYRIGHT_LINE = (
    rf"(^|\n){_LEAD}(?:copyright[ \t:]*(?:\(c\)|©)|copyright[ \t:]+(?!{_CLAUSE}){_NAME}|\(c\)(?![ \t]*{_ITEM})|©|all rights reserved(?![0-9a-z]))[^\n]*"
)
NOT_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
NOTICE_HINT = "(?i)licen[sc]e|public domain"

#: Pairs of equivalent spellings, applied in this order to the folded text.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
    ("honour", "honor"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"),
    ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"),
    ("http www", "https www"), ("wilful", "willful"), ("fulfilment", "fulfillment"), ("cancelled", "canceled"),
]

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Whole licence texts and one-line notices, each with its SPDX name.
KNOWN = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the Software.\n\n" + _WARRANTY),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the Software.\n\n" + _WARRANTY),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted.\n\n" + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software "
     "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
     "following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you "
     "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
     "would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be "
     "misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
     "with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by "
     'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
     "governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 into the public domain. No license is needed."),
]


#: Digests of the canonical forms of whole licences that are too long to be spelled out here.
KNOWN_DIGESTS = [
    ("Apache-2.0", "45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
]


def canonical(text: Column) -> Column:
    """The canonical form of a licence text; null stays null."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    for found, put in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """canon_sha256, license_id: one row for each known digest. Its size is that of the two lists, so it may be broadcast."""
    rows = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in KNOWN])
    flat = spark.range(1).select(F.inline(rows)).select("license_id", digest(F.col("text")).alias("canon_sha256"))
    listed = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(found).alias("canon_sha256")) for name, found in KNOWN_DIGESTS])
    return flat.unionByName(spark.range(1).select(F.inline(listed))).groupBy("canon_sha256").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, canon_sha256 of the whole text, license_id of that digest, notices: licences named by single lines (sorted, joined by commas)."""
    base = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    lookup = F.create_map(*[x for name, text in _notices() for x in (digest(F.lit(text)), F.lit(name))])
    # Lines are few once those that name no licence are gone; a text without the hint is not split at all.
    lines = F.when(F.col("text").rlike(NOTICE_HINT), F.filter(F.split("text", "\n"), lambda x: x.rlike(NOTICE_HINT)))
    named = F.filter(F.transform(lines, lambda x: F.try_element_at(lookup, digest(x))), lambda x: x.isNotNull())
    scanned = base.select(id_col, digest(F.col("text")).alias("canon_sha256"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(named)), ","), F.lit("")).alias("notices"))
    return scanned.join(F.broadcast(known_licenses(docs.sparkSession)), "canon_sha256", "left").select(id_col, "canon_sha256", "license_id", "notices")


def _notices() -> list[tuple[str, str]]:
    """The known texts of one line, each canonical form once."""
    return [(name, text) for name, text in KNOWN if "\n" not in text]


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_is_notice(line: str) -> str:
    """COPYRIGHT_LINE for one line, without looking ahead, which DuckDB's patterns can't."""
    begins = lambda rest: f"regexp_matches({line}, {_sql_text('^' + _LEAD + rest)})"
    clause, item = (x.replace("(?![0-9a-z])", "(?:[^0-9a-z]|$)") for x in (_CLAUSE, _ITEM))
    plain = begins(r"(?:copyright[ \t:]*(?:\(c\)|©)|©|all rights reserved(?:[^0-9a-z]|$))")
    named = begins(r"copyright[ \t:]+" + _NAME) + " AND NOT " + begins(r"copyright[ \t:]+" + clause)
    return f"({plain} OR ({named}) OR ({begins('[(]c[)]')} AND NOT {begins('[(]c[)][ ' + chr(92) + 't]*' + item)}))"


def _sql_canonical(x: str) -> str:
    lines = f"list_transform(string_split(lower({x}), chr(10)), lambda l: CASE WHEN {_sql_is_notice('l')} THEN '' ELSE l END)"
    out = f"trim(regexp_replace(array_to_string({lines}, chr(10)), '{NOT_WORD}', ' ', 'g'))"
    for found, put in SPELLINGS:
        out = f"replace({out}, '{found}', '{put}')"
    return out


def oracle() -> str:
    values = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in KNOWN)
    digests = ", ".join(f"('{name}', '{found}')" for name, found in KNOWN_DIGESTS)
    return f"""
    WITH listed AS (SELECT license_id, sha256({_sql_canonical('t')}) AS canon_sha256 FROM (VALUES {values}) v(license_id, t)
                    UNION ALL SELECT license_id, canon_sha256 FROM (VALUES {digests}) w(license_id, canon_sha256)),
    known AS (SELECT canon_sha256, min(license_id) AS license_id FROM listed GROUP BY 1),
    doc_lines AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
    named AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM doc_lines
              JOIN known ON canon_sha256 = sha256({_sql_canonical('line')}) WHERE regexp_matches(line, '{NOTICE_HINT}') GROUP BY doc_id)
    SELECT d.doc_id, sha256({_sql_canonical('d.text')}) AS canon_sha256, k.license_id, coalesce(n.notices, '') AS notices
    FROM documents d LEFT JOIN known k ON k.canon_sha256 = sha256({_sql_canonical('d.text')}) LEFT JOIN named n ON n.doc_id IS NOT DISTINCT FROM d.doc_id
    """
