"""Recognises texts that are a known licence as a whole, by the digest of a canonical form.

Canonical form, by column functions alone: lower case; lines that open with a copyright notice (its sign, a year or a placeholder) are dropped; British and other
equivalent spellings become one; quotes, comment marks, bullets and all other punctuation become blanks; runs of blanks
become one. The SHA-256 of that form is looked up among the digests of the known licences by a hash join.

The known texts are a parameter (``name``, ``text``); a few short ones are given below. Their digests are made by the same
columns, so a change of the form cannot leave stale digests. Documents are not shuffled while the digest table is small: Spark's
threshold decides the kind of join, and both kinds give the same rows.

Defined results: null text is empty; a text whose canonical form is empty has no licence. Known texts with the same form:
the first name. Every row of the documents comes back once, repeated rows alike; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, as in the matching guidelines that licence lists publish.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorise", "authorize"),
    ("behaviour", "behavior"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("honour", "honor"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
]

# Whole texts of short licences.
_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
)
_DENIAL_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_DENIAL_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n\n"
)
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n\n",
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.\n\n"
)
_DENIAL_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
KNOWN = {
    "MIT": "MIT License\n\n"
    + _GRANT_MIT
    + "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    + _DENIAL_MIT,
    "MIT-0": "MIT No Attribution\n\n" + _GRANT_MIT.split(", subject to the following")[0] + ".\n\n" + _DENIAL_MIT,
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _DENIAL_ISC,
    "0BSD": "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted.\n\n" + _DENIAL_ISC,
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + _BSD_HEAD + f"1. {_BSD_TWO[0]}2. {_BSD_TWO[1]}" + _DENIAL_BSD,
    "BSD-3-Clause": "BSD 3-Clause License\n\n" + _BSD_HEAD + f"1. {_BSD_TWO[0]}2. {_BSD_TWO[1]}3. {_BSD_THIRD}" + _DENIAL_BSD,
    "Zlib": "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
    "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
    "software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source "
    "versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be "
    "removed or altered from any source distribution.",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}

# Headings under which the texts are distributed. A text is known under each of them and without one.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT-0 License"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "The BSD 2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", "The BSD 3-Clause License"),
    "Zlib": ("zlib License", "The zlib License"),
}

# What may stand before a line in a comment.
_MARGIN = r"[ \t*/#;.<>-]*"
# Lines of a copyright notice: a sign, a year or a placeholder follows the word, so that lines of wrapped text which open with
# "copyright holders" or "(c)" stay; at the beginning of a text or after an empty line, where no wrapped line can be, nothing need follow.
_DATED = r"(19|20)[0-9][0-9]|[\[<{]|yyyy"
_FIRST = rf"(\A|\n{_MARGIN}\n){_MARGIN}copyright[^\n]*"
_COPYRIGHT = rf"(?m)^{_MARGIN}(copyright[ \t:,]*(\(c\)|©|{_DATED})|\(c\)[ \t]*(copyright|{_DATED})|©)[^\n]*$"
_RESERVED = rf"(?m)^{_MARGIN}all rights reserved[ \t.]*$"
NOTICES = (_FIRST, _COPYRIGHT, _RESERVED)
# Typographic quotes, dashes and blanks (U+0080-00BF, U+2000-303F) count as punctuation.
_KEPT = "[^a-z0-9\\x{C0}-\\x{1FFF}\\x{3040}-\\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    form = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    form = F.regexp_replace(form, "\r\n?", "\n")
    for notice in NOTICES:
        form = F.regexp_replace(form, notice, "\n")
    form = F.concat(F.lit(" "), F.regexp_replace(form, _KEPT, " "), F.lit(" "))
    for other, one in SPELLINGS:
        form = F.replace(form, F.lit(f" {other}"), F.lit(f" {one}"))
    return F.trim(form)


def canonical_sql(text: str) -> str:
    """The same form in DuckDB's SQL."""
    form = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    form = f"regexp_replace({form}, '\\r\\n?', chr(10), 'g')"
    for notice in NOTICES:
        form = f"regexp_replace({form}, '{notice}', chr(10), 'g')"
    form = f"' ' || regexp_replace({form}, '{_KEPT}', ' ', 'g') || ' '"
    for other, one in SPELLINGS:
        form = f"replace({form}, ' {other}', ' {one}')"
    return f"trim({form}, ' ')"


def digest(form: Column) -> Column:
    """Null where nothing is left of the text, so that it joins nothing."""
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def forms() -> list[tuple[str, str]]:
    """Name and text of all that is known: texts under each of their headings and without, and one-line notices."""
    out = []
    for name, text in KNOWN.items():
        body = text.split("\n\n", 1)[1] if name in HEADINGS else text
        out += [(name, body), *((name, f"{heading}\n\n{body}") for heading in HEADINGS.get(name, ()))]
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(forms(), "name string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest and license (null: none) for every row of ``docs``."""
    digests = known.select("name", digest(canonical(F.col("text"))).alias("digest")).where("digest IS NOT NULL")
    digests = digests.groupBy("digest").agg(F.min("name").alias("license"))
    # The form is a column of its own, so that it is made once for a text.
    own = docs.select("doc_id", canonical(F.col("text")).alias("form")).select("doc_id", digest(F.col("form")).alias("digest"))
    return own.join(digests, "digest", "left").select("doc_id", "digest", "license")


def scan_sql() -> str:
    """``scan`` of the documents with the texts above, for DuckDB."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in forms())
    return f"""WITH known(name, text) AS (VALUES {rows}),
form AS (SELECT name, {canonical_sql('text')} AS f FROM known),
digests AS (SELECT sha256(f) AS digest, min(name) AS license FROM form WHERE f <> '' GROUP BY 1),
own AS (SELECT doc_id, {canonical_sql('text')} AS f FROM documents),
hashed AS (SELECT doc_id, CASE WHEN f <> '' THEN sha256(f) END AS digest FROM own)
SELECT doc_id, digest, license FROM hashed LEFT JOIN digests USING (digest)"""
