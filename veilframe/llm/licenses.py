"""Licence scans by canonical digests (built-in functions only).

A text is brought to a canonical form: lower case, copyright lines dropped,
equivalent spellings made one, punctuation and blanks as single spaces.  The
digest of the entire canonical text, with and without a title line such as "MIT
License", is hash-joined to the digests of known licence texts; single lines are
looked up too, so that a notice inside a document is found.

The known side is ``license_digests.csv`` beside this file (digests of whole public
licence texts by SPDX name, made by digests_of() from a folder of texts), the short
texts and notices of ``KNOWN``, and what the caller gives: a list of (name, text) or
a DataFrame of (digest, license).  It doesn't depend on the corpus, and its rows are
counted before it is broadcast.  Only one row per document and task leaves a map.

Defined results: null or empty text has no licence; a text that is only
copyright lines is empty; known texts with one canonical form share a digest
and the smallest name wins; repeated rows each get their own row; extra columns
are ignored.
"""

from __future__ import annotations

import csv
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import meet, table

#: Public licence texts and notices, by name.
KNOWN = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
]

#: Spellings that count as one.
SPELLINGS = [("licence", "license"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("non-commercial", "noncommercial"), ("sub-license", "sublicense"), ("https:", "http:"), ("per cent", "percent"), ("whilst", "while"), ("judgement", "judgment"), ("fulfil ", "fulfill "), ("analyse", "analyze"), ("behaviour", "behavior"), ("modelled", "modeled")]


#: A line that begins with a copyright sign, or with the word and tells a sign or a year.
COPYRIGHT = r"(?m)^[ \t]*(?:copyright\b[^\n]*(?:\(c\)|©|[12][0-9]{3})|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Canonical text; its lines stay apart, each without blanks at its ends."""
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, COPYRIGHT, "")
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(F.trim(x), r" ?\n[ \n]*", "\n")


def whole(canon: Column) -> Column:
    return F.trim(F.translate(canon, "\n", " "))


#: A first line of at most 14 words that has the word, with text behind it.
TITLE = r"^(?:[^ \n]+ ){0,7}license(?: [^ \n]+){0,6}\n"


def entire(canon: Column) -> list[Column]:
    """Digests of an entire canonical text: as it is, and without its title line."""
    return [F.md5(whole(canon)), F.md5(whole(F.regexp_replace(canon, TITLE, "")))]


def digests_of(texts: DataFrame) -> DataFrame:
    """(digest, license) of whole texts (license, text), such as a folder of licence files read with their names."""
    both = texts.select("license", F.explode(F.array(*entire(canonical(F.col("text"))))).alias("digest"))
    return both.groupBy("digest").agg(F.min("license").alias("license"))


def listed() -> list[tuple[str, str]]:
    """(digest, license) of the data file."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_digests.csv"), newline="") as f:
        return [(r["digest"], r["license"]) for r in csv.DictReader(f)]


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(digest, license): one row per digest."""
    if isinstance(known, DataFrame):
        rows = known.select("digest", "license")
    else:
        rows = digests_of(spark.createDataFrame(KNOWN if known is None else known, "license string, text string"))
        rows = rows if known is not None else rows.union(spark.createDataFrame(listed(), "digest string, license string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | DataFrame | None = None, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``id_col``, license (of the entire text, or null), line_licenses (sorted names), n_license_lines."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("c"))
    lines = F.filter(F.split("c", "\n"), lambda x: x != "")
    parts = F.concat(F.array(*[F.struct(F.lit(True).alias("entire"), x.alias("digest")) for x in entire(F.col("c"))]), F.transform(lines, lambda x: F.struct(F.lit(False).alias("entire"), F.md5(x).alias("digest"))))
    each = src.select("row", "id", F.explode(parts).alias("p")).select("row", "id", "p.entire", "p.digest")
    hits = meet(each, table(known_digests(docs.sparkSession, known), "known-licences"), "digest", "row", "left")
    names = F.sort_array(F.collect_set(F.when(~F.col("entire"), F.col("license"))))
    out = hits.groupBy("row").agg(F.max("id").alias(id_col), F.min(F.when(F.col("entire"), F.col("license"))).alias("license"), names.alias("line_licenses"), F.count_if(~F.col("entire") & F.col("license").isNotNull()).alias("n_license_lines"))
    return out.drop("row")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "license", F.array_join("line_licenses", ",").alias("line_licenses"), "n_license_lines")


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    x = "lower(coalesce(text, ''))"
    x = f"regexp_replace({x}, '{COPYRIGHT}', '', 'g')"
    for a, b in SPELLINGS:
        x = f"replace({x}, {q(a)}, {q(b)})"
    x = rf"regexp_replace(trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' '), ' ?\n[ \n]*', chr(10), 'g')"
    values = ", ".join(f"({q(n)}, {q(t)})" for n, t in KNOWN)
    files = ", ".join(f"({q(d)}, {q(n)})" for d, n in listed())
    whole_ = lambda c: f"md5(trim(replace({c}, chr(10), ' '), ' '))"
    title = lambda c: f"regexp_replace({c}, '{TITLE}', '')"
    return rf"""
WITH known(license, text) AS (VALUES {values}),
kc AS (SELECT license, {x} AS c FROM known),
k AS (SELECT digest, min(license) AS license FROM (SELECT {whole_("c")} AS digest, license FROM kc UNION ALL SELECT {whole_(title("c"))}, license FROM kc UNION ALL SELECT * FROM (VALUES {files}) AS f(digest, license)) GROUP BY digest),
d AS (SELECT row_number() OVER () AS rid, doc_id, {x} AS c FROM documents),
e AS (SELECT rid, min(license) AS license FROM d JOIN k ON digest IN ({whole_("c")}, {whole_(title("c"))}) GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS names, count(*) AS n
      FROM (SELECT rid, unnest(string_split(c, chr(10))) AS x FROM d) JOIN k ON md5(x) = digest WHERE x <> '' GROUP BY rid)
SELECT doc_id, e.license AS license, coalesce(names, '') AS line_licenses, coalesce(n, 0) AS n_license_lines
FROM d LEFT JOIN e USING (rid) LEFT JOIN l USING (rid)
"""


OP6_SQL = _sql()
