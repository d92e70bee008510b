"""License scan: canonical digests of whole texts, looked up among known licences.

A text becomes canonical by lower case, without copyright lines and the numbers
of list items, with every run of punctuation and white space as one gap, and with one spelling of words
that licence texts use in several. Its digest is joined with the digests of the
known texts, which are made by the same expressions. A text matches as a whole
or not at all.

Everything is DataFrame functions. Nulls count as empty texts and match
nothing, as do texts that are empty once canonical. Known texts with equal
digests count as the one of least id. ``known`` is a table of any size; the
query's own holds whole texts of permissive licences, with and without the
titles they are published under, and four one-line notices. Equal rows give equal rows, empty tables
an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.llm.common import table

#: Equivalent spellings, canonical one second (after the SPDX matching guidelines).
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("noncommercial", "non commercial"), ("per cent", "percent"), ("copyright owners", "copyright holders"), ("licences", "licenses"),
]

#: Texts of some short licences and notices.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_KEEP = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
KNOWN = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _WARRANTY,
    "FSFAP": "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.",
    "MIT-0": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: " + _BSD_KEEP + _BSD_WARRANTY,
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: " + _BSD_KEEP + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY,
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "PostgreSQL": 'Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies. IN NO EVENT SHALL THE UNIVERSITY OF CALIFORNIA BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE UNIVERSITY OF CALIFORNIA HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. THE UNIVERSITY OF CALIFORNIA SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND THE UNIVERSITY OF CALIFORNIA HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.',
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}

#: Titles under which the texts are published. A text matches with any of them and with none.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "MIT-0": ["MIT No Attribution", "MIT No Attribution License"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License", "Zero Clause BSD License"], "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "BSD License"],
    "Zlib": ["zlib License", "The zlib/libpng License"], "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"], "PostgreSQL": ["PostgreSQL License", "The PostgreSQL License"], "Unlicense": ["The Unlicense", "Unlicense"],
}


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the fixed texts, alone and under their titles."""
    return [(k, f"{title}\n\n{v}") for k, v in KNOWN.items() for title in ["", *TITLES.get(k, [])]]


#: A line is a copyright line by a year, a sign or a placeholder after the word, or by nothing but capitalised names; other lines that begin with the word are part of the text.
NAMES = r"(^|\n)[ \t*#/;]*Copyright([ \t,]+(by|and|of|the|[A-Z][a-z]+[\w.'-]*|[A-Z][.]))+[ \t.]*(\n|$)"
COPYRIGHT = r"(^|\n)[ \t*#/;]*(copyright[^\n]*(\(c\)|©|[<\[{]|(19|20)[0-9][0-9])|\(c\)|©)[^\n]*"
#: Numbers and marks of list items.
BULLET = r"(^|\n)[ \t*#/;]*\(?([0-9][0-9]?|[a-z])[.)][ \t]+"
RIGHTS = r"all rights reserved\.?"
GAP = r"[^\p{L}\p{N}]+"
#: Known texts that may be broadcast; more are joined by a shuffle.
SMALL = 100_000


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), NAMES, "\n")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(t), COPYRIGHT, "\n"), RIGHTS, " "), BULLET, "\n")
    t = F.concat(F.lit(" "), F.regexp_replace(t, GAP, "  "), F.lit(" "))  # two blanks, so that neighbours share none
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(t)


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key, ``digest`` (of the canonical text) and ``license_id`` or null. ``known`` has ``license_id`` and ``text``."""
    digest = lambda c: F.sha2(canonical(c), 256)
    sought = known.select("license_id", canonical(F.col("text")).alias("t")).where("t != ''").select(F.sha2("t", 256).alias("digest"), "license_id")
    sought = sought.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if known.count() <= SMALL:
        sought = F.broadcast(sought)
    return docs.select(F.col(key), digest(F.col(text)).alias("digest")).join(sought, "digest", "left").select(key, "digest", "license_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(known_texts(), "license_id string, text string")
    return scan(table(spark, sf_dir, "documents"), known)


def _sql_canonical(text: str) -> str:
    names = NAMES.replace("'", "''")
    t = rf"regexp_replace(coalesce({text}, ''), '{names}', chr(10), 'g')"
    t = rf"regexp_replace(regexp_replace(regexp_replace(lower({t}), '{COPYRIGHT}', chr(10), 'g'), '{RIGHTS}', ' ', 'g'), '{BULLET}', chr(10), 'g')"
    t = f"' ' || regexp_replace({t}, '{GAP}', '  ', 'g') || ' '"
    return f"trim({reduce(lambda s, e: f"replace({s}, ' {e[0].replace(' ', '  ')} ', ' {e[1].replace(' ', '  ')} ')", EQUIVALENT, f'({t})')}, ' ')"


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in known_texts())
SQL = f"""
WITH known AS (SELECT sha256(t) AS digest, min(license_id) AS license_id FROM (SELECT license_id, {_sql_canonical("text")} AS t FROM (VALUES {_VALUES}) k(license_id, text)) WHERE t != '' GROUP BY 1),
d AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM d LEFT JOIN known USING (digest)
"""
