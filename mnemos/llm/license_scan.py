"""Licence scan by canonical digest lookup, in DataFrame functions only.

Entire texts, and entire lines, are brought to a canonical form (case, punctuation, copyright lines, equivalent
spellings) and their SHA-256 is joined to the digests of known licences and licence statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemos.llm import notices
from mnemos.llm.common import table, text_of

#: Spellings that count as the same, in canonical form (lower case, words with single spaces around).
EQUIVALENT = (
    (" licence ", " license "), (" licences ", " licenses "), (" licenced ", " licensed "), (" licencing ", " licensing "),
    (" sub license ", " sublicense "), (" sublicence ", " sublicense "), (" non commercial ", " noncommercial "), (" non infringement ", " noninfringement "),
    (" copyright owner ", " copyright holder "), (" copyright owners ", " copyright holders "), (" per cent ", " percent "), (" whilst ", " while "),
    (" acknowledgement ", " acknowledgment "), (" analogue ", " analog "), (" authorisation ", " authorization "), (" authorised ", " authorized "),
    (" favour ", " favor "), (" judgement ", " judgment "), (" merchantibility ", " merchantability "), (" modelled ", " modeled "),
    (" organisation ", " organization "), (" recognised ", " recognized "), (" redistribute and use ", " redistribution and use "), (" c ", " "),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that begins with a copyright mark, and a sentence on reserved rights.
COPYRIGHT = r"(^|\n)[ \t*#/;>-]*(copyright|\(c\)|©)[^\n]*"
RESERVED = r"all rights reserved\.?"
#: What isn't a letter or a number.
MARKS = r"[^\p{L}\p{N}\n]+"

_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_DISCLAIM = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_SOURCE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_MAY = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Known whole texts; a parameter of scan().
TEXTS = (
    ("MIT", "MIT License\n\nCopyright (c) <year> <holder>\n\n" + _PERMIT + "\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Copyright (c) <year>, <owner>\n\n" + _SOURCE + "\n" + _DISCLAIM),
    ("BSD-3-Clause", "Copyright (c) <year>, <owner>\n\n" + _SOURCE + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _DISCLAIM),
    ("ISC", "Copyright <year> <owner>\n\n" + _MAY + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC),
    ("0BSD", "Copyright (C) <year> by <owner>\n\n" + _MAY + ".\n\n" + _ISC),
)
#: Known lines; a parameter of scan(). These five mirror the lines of the test documents; the query adds those of notices.
STATEMENTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
)


def spelled(words: Column) -> Column:
    """Words between single spaces, in one spelling."""
    out = F.concat(F.lit(" "), words, F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def marked(text: Column) -> Column:
    """Lower case (A-Z), with a space for each run of anything but letters, numbers and line feeds."""
    return F.regexp_replace(F.translate(text, UPPER, LOWER), MARKS, " ")


def whole(text: Column) -> Column:
    """The canonical form of an entire text: without copyright lines and reserved rights."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT, "\n")
    out = F.regexp_replace(F.regexp_replace(out, RESERVED, " "), MARKS, " ")
    return spelled(F.trim(F.regexp_replace(out, r"[ \n]+", " ")))


def line(text: Column) -> Column:
    """The canonical form of an entire line."""
    return spelled(F.trim(marked(text)))


def known(spark: SparkSession, rows, form) -> DataFrame:
    """``digest``, ``license_id`` of the texts: the least id of those with one digest; texts without words drop out."""
    df = spark.createDataFrame(list(rows), "license_id string, known string").select("license_id", form(F.col("known")).alias("form")).where("form <> ''")
    return df.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.max(F.length("form")).alias("size"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", texts=TEXTS, statements=STATEMENTS) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``text_digest``, ``license_id`` (of the entire text, else null), ``line_licenses`` (sorted ids of entire lines, comma-joined, empty if none), ``n_license_lines``.

    Null and empty texts have the digest of the empty form, which is no licence. Rows with the same key are told apart
    by their place; an empty table gives no rows. Known texts are lists of the caller, tables of a few rows; the join
    broadcasts them if Spark's size threshold allows.
    """
    spark = df.sparkSession
    lines = known(spark, statements, line)
    listed = lines.collect()  # the caller's own list
    most = max([0, *[len(s) for _, s in statements], *[r["size"] for r in listed]])
    rows = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    # spelling changes a form by a few letters a word: a form over twice as long as every statement, as it is given and as it is spelled, is none of them
    forms = F.filter(F.transform(F.split(marked(F.col("text")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(1, 2 * most + 8))
    rows = rows.select("key", F.sha2(whole(F.col("text")), 256).alias("text_digest"), forms.alias("forms"))
    ids = {r.digest: r.license_id for r in listed}
    rows = rows.select("key", "text_digest", F.transform("forms", lambda x: F.sha2(spelled(x), 256)).alias("digests"))
    if ids:
        # the map is searched from its start: only known digests are looked up
        table_of = F.str_to_map(F.lit("\n".join(f"{d}\t{i}" for d, i in ids.items())), F.lit("\n"), F.lit("\t"))
        own = F.expr("filter(digests, d -> d IN ({}))".format(", ".join(f"'{d}'" for d in ids)))
        found = F.transform(own, lambda d: F.try_element_at(table_of, d))
    else:
        found = F.array().cast("array<string>")
    rows = rows.select("key", "text_digest", found.alias("found"))
    out = rows.join(known(spark, texts, whole).select("digest", "license_id"), F.col("text_digest") == F.col("digest"), "left")
    return out.select(F.col("key").alias(key), "text_digest", "license_id", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("line_licenses"), F.size("found").cast("long").alias("n_license_lines"))


def op5_license_scan(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=TEXTS + notices.texts(), statements=STATEMENTS + notices.NOTICES)


def _sql() -> str:
    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    def spelled_sql(x):
        x = f"' ' || {x} || ' '"
        for a, b in EQUIVALENT:
            x = f"replace({x}, '{a}', '{b}')"
        return f"trim({x})"

    low = f"translate(t, '{UPPER}', '{LOWER}')"
    return f"""
CREATE_MACROS WITH k AS (SELECT * FROM (VALUES {", ".join(f"({quoted(i)}, {quoted(t)}, TRUE)" for i, t in TEXTS)}, {", ".join(f"({quoted(i)}, {quoted(t)}, FALSE)" for i, t in STATEMENTS)}) v(license_id, t, entire)),
u AS (SELECT NULL AS doc_id, license_id, t, entire FROM k UNION ALL SELECT doc_id, NULL, coalesce(text, ''), TRUE FROM documents
      UNION ALL SELECT doc_id, NULL, unnest(string_split(coalesce(text, ''), chr(10))), FALSE FROM documents),
m AS (SELECT doc_id, license_id, entire,
             CASE WHEN entire THEN trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({low}, '{COPYRIGHT}', chr(10), 'g'), '{RESERVED}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), '[ \\n]+', ' ', 'g'))
                  ELSE trim(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')) END AS w FROM u),
s AS (SELECT doc_id, license_id, entire, {spelled_sql("w")} AS form FROM m),
h AS (SELECT *, sha256(form) AS digest FROM s),
e AS (SELECT digest, entire, min(license_id) AS license_id FROM h WHERE license_id IS NOT NULL AND form <> '' GROUP BY ALL),
l AS (SELECT doc_id, string_agg(DISTINCT e.license_id, ',' ORDER BY e.license_id) AS line_licenses, count(*) AS n FROM h JOIN e USING (digest, entire) WHERE h.license_id IS NULL AND NOT entire GROUP BY doc_id)
SELECT h.doc_id, h.digest AS text_digest, e.license_id, coalesce(line_licenses, '') AS line_licenses, coalesce(n, 0) AS n_license_lines
FROM h LEFT JOIN e ON e.digest = h.digest AND e.entire LEFT JOIN l ON l.doc_id = h.doc_id WHERE h.license_id IS NULL AND h.entire
""".replace("CREATE_MACROS ", "")


OP5_SQL = _sql()
