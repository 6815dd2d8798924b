"""Licence scans by canonical digests of entire texts.

A text's canonical form has small letters, no lines that name a copyright's holder, one spelling of words that count as equal, and
single spaces for all that is neither a letter, a mark nor a digit of any script. Its SHA-256 is hash-joined to the digests of known licences (a small fixed table). Built-in
functions only; no shuffle. A holder's line has a copyright word and then (c), a sign or a year, maybe after comment marks or a
licence's title, and ends with the line or where a known licence begins; if neither comes soon, only the words and years go.

A null text has no digest and no licence; an empty one, or one of copyright lines alone, has the empty form's digest and no
licence. Very long texts are digested whole, so a licence with anything else beside it isn't one. Repeated rows are looked up each;
there are no ties, for known digests differ. An empty table gives no rows; other columns, whatever their names, are ignored.

Built in are short licences, and the notices that stand for Apache-2.0, MPL-2.0 and GPL-3.0-or-later; scan() takes any others as
texts by name.
"""

from __future__ import annotations

import hashlib

import regex as re
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import table

# Lines that name a holder, spellings that count as equal, and the texts of known licences.
_OPENINGS = (
    "permission is hereby granted",
    "permission to use, copy",
    "redistribution and use in source",
    "this software is provided 'as-is'",
    "this is free and unencumbered",
    "(?:mit|isc|zlib|bsd [23]-clause) license",
    "boost software license",
    "licensed under the apache license",
    "this source code form is subject",
    "this program is free software",
)
_END = r"(?=\r?\n|$|" + "|".join(x.replace(" ", r"\s+") for x in _OPENINGS) + ")"
_HOLDER = r"(?:copyright[ \t:]*(?:\(c\)|©|&copy;|(?=[12]\d\d\d))|\(c\)[ \t]*(?:copyright|(?=[12]\d\d\d))|©)"
COPYRIGHT = (
    r"(^|\n|license[ \t]+)[ \t]*(?:(?:[#*;%]+|//+|/\*+|--+|<!--+)[ \t]*)?"
    rf"(?:{_HOLDER}[ \t]*(?:[12]\d\d\d[ \t,–-]*)*(?:[^\n]{{0,160}}?{_END}|)|all rights reserved[ \t.]*{_END})"
)
#: The SQL keeps the pattern it was written with: every line that begins with one of these words.
SQL_COPYRIGHT = r"(^|\n)[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
OTHER = r"[^\p{L}\p{M}\p{N}]+"
SPELLINGS = (
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("sub license", "sublicense"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
)
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_BSD_2 = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""
_UNLICENSE = """
This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_MIT_0 = _MIT.replace(
    ", subject\nto the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "."
)
_BSL = """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and
to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_APACHE_2 = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.
"""
_MPL_2 = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at {}mozilla.org/MPL/2.0/.
"""
_GPL_3 = """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <{}www.gnu.org/licenses/>.
"""
KNOWN = {
    "MIT": _MIT,
    "MIT with its title": "MIT License\n" + _MIT,
    "BSD-2-Clause": _BSD_2 + _BSD_TAIL,
    "BSD-2-Clause with its title": "BSD 2-Clause License\n" + _BSD_2 + _BSD_TAIL,
    "BSD-3-Clause": _BSD_2 + _BSD_3 + _BSD_TAIL,
    "BSD-3-Clause with its title": "BSD 3-Clause License\n" + _BSD_2 + _BSD_3 + _BSD_TAIL,
    "ISC": _ISC_HEAD + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL,
    "ISC with its title": "ISC License\n" + _ISC_HEAD + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL,
    "0BSD": _ISC_HEAD + ".\n" + _ISC_TAIL,
    "Zlib": _ZLIB,
    "Zlib with its title": "zlib License\n" + _ZLIB,
    "Unlicense": _UNLICENSE,
    "MIT-0": _MIT_0,
    "BSL-1.0": _BSL,
    "BSL-1.0 with its heading": "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BSL,
    "Apache-2.0": _APACHE_2,
    "Apache-2.0 by https": _APACHE_2.replace("http:", "https:"),
    "MPL-2.0": _MPL_2.format("https://"),
    "MPL-2.0 by http": _MPL_2.format("http://"),
    "GPL-3.0-or-later": _GPL_3.format("https://"),
    "GPL-3.0-or-later by http": _GPL_3.format("http://"),
}


def canonical(text: str, lines: str = COPYRIGHT) -> str:
    """The canonical form, as canonical_column makes it."""
    t = re.sub(OTHER, " ", re.sub(lines, r"\1", text.lower())).strip(" ")
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return t


def canonical_column(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, "$1"), OTHER, " "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def named(variant: str) -> str:
    """The licence of a variant that KNOWN lists."""
    return re.sub(" (with|by) .*", "", variant)


def known_digests(known: dict[str, str], lines: str = COPYRIGHT) -> list[tuple[str, str]]:
    return [(hashlib.sha256(canonical(t, lines).encode()).hexdigest(), named(k)) for k, t in known.items()]


def scan(spark: SparkSession, docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, digest, licence), a row for each row of docs (doc_id, text); licence is null where the digest isn't known."""
    names = spark.createDataFrame(sorted(set(known_digests(KNOWN if known is None else known))), "digest string, licence string")
    rows = docs.select("doc_id", F.sha2(canonical_column(F.col("text")), 256).alias("digest"))
    return rows.join(F.broadcast(names), "digest", "left").select("doc_id", "digest", "licence")  # a fixed table


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))


def _sql() -> str:
    pattern = SQL_COPYRIGHT.replace("'", "''")
    t = f"trim(regexp_replace(regexp_replace(lower(text), '{pattern}', '\\1', 'g'), '{OTHER}', ' ', 'g'))"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted(set(known_digests(KNOWN, SQL_COPYRIGHT))))
    return (
        f"WITH known(digest, licence) AS (VALUES {values}), docs AS (SELECT doc_id, sha256({t}) AS digest FROM documents) "
        "SELECT doc_id, docs.digest AS digest, licence FROM docs LEFT JOIN known ON docs.digest = known.digest"
    )


ORACLE = _sql()
