"""Licence scan: canonical digest lookup.

A text becomes its canonical form: A-Z lower-cased, copyright lines dropped, equivalent spellings made one, everything
but letters and digits turned into single blanks. The sha-256 of the whole canonical form is joined with the digests of
known texts. Beside the whole document, each of its lines is looked up in the same table, which finds licence notices
that stand in other text. Everything is Spark SQL; the table of known texts is a few rows and is broadcast (its size is
that of ``KNOWN`` or of the caller's table, which is checked against ``MAX_BROADCAST`` rows).

Defined results: null and empty texts, and texts whose canonical form is empty, match nothing; two known names with one
canonical text are both reported, sorted; repeated rows each get their own result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import ID, KEY, ascii_lower, lean, text_key, text_of

MAX_BROADCAST = 100_000

# Spellings that count as equal, replaced in this order in text of lower-case words between single blanks.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("https", "http"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
)
VERSION = "(^| )v ?([0-9])"
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:c\)|\u00a9|[0-9]|by )|\u00a9|\(c\)|all rights reserved)[^\n]*$"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\u00a9]+"

# Known licence texts and notices (public wording).
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice (file header)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
}


def canonical(c: Column) -> Column:
    """The canonical form of a text; line breaks still count for copyright lines, then become blanks."""
    out = F.regexp_replace(F.regexp_replace(ascii_lower(c), COPYRIGHT_LINE, " "), PUNCTUATION, " ")
    for spelling, to in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(to))
    return F.trim(F.regexp_replace(out, VERSION, "$1version $2"))


def digest(c: Column) -> Column:
    """sha-256 of the canonical form; null where that is empty."""
    form = canonical(c)
    return F.when(F.length(form) > 0, F.sha2(form, 256))


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, licence) of known texts; one row for each digest."""
    rows = spark.createDataFrame(sorted((texts or KNOWN).items()), "licence string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "licence").filter("digest is not null").groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licence"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per document row: doc_id, digest and licence of the whole text, licences of its lines (sorted names), their number.

    One pass: the digests of the whole text and of its lines probe the table of known digests where they are made, and
    only the row of the whole text and lines that match are kept and brought together.
    """
    small = F.broadcast(known) if known.count() <= MAX_BROADCAST else known
    rows = lean(docs, ID, "text").select(ID, text_key().alias(KEY), text_of().alias("text"))
    units = F.concat(F.array(F.col("text")), F.when(F.instr("text", "\n") > 0, F.split("text", "\n")).otherwise(F.array().cast("array<string>")))
    each = rows.select(ID, KEY, F.posexplode_outer(units).alias("at", "unit")).select(ID, KEY, "at", digest(F.col("unit")).alias("digest"))
    hit = each.join(small, "digest", "left").filter("at = 0 or licence is not null")
    whole = F.col("at") == 0
    found = hit.groupBy(ID, KEY).agg(
        F.count(F.when(whole, 1)).alias("copies"), F.max(F.when(whole, F.col("digest"))).alias("digest"), F.max(F.when(whole, F.col("licence"))).alias("licence"),
        F.count(F.when(~whole, 1)).alias("lines"), F.array_join(F.array_sort(F.collect_set(F.when(~whole, F.col("licence")))), ";").alias("line_licences"),
    )
    each_copy = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each_copy.select(ID, "digest", "licence", (F.col("lines") / F.col("copies")).cast("long").alias("n_licence_lines"), "line_licences")
