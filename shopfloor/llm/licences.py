"""Licence scan by canonical digests. DataFrame functions only.

A text is normalised (lower case, title and copyright lines out, equivalent spellings to one, everything but letters
and digits to one space) and hashed; its SHA-256 is joined with the digests of the known licences, which
are normalised by the same expression. The whole document is looked up, and so is every one of its lines,
since notices stand on lines of their own within other text. Whole texts are the files of known_licences;
AGPL and the CC licences but CC0 and CC-BY-SA-4.0 are still missing there.

Cases: null and empty texts match nothing, nor does a text that is empty after normalisation; rows that
repeat are looked up one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shopfloor.llm.store import table

#: Spellings that mean the same (regular expression on lower case -> one form).
SPELLINGS = ((r"\blicence\b", "license"), (r"\blicenced\b", "licensed"), (r"\bsub-?licence\b", "sublicense"), (r"\bcopyright holders?\b", "copyright owner"), (r"https?://", ""), (r"\bversion\b|\bv\.", "v"), (r"&", " and "))
#: Anything within a line that is no letter or digit of any script.
_GAP = r"[^\p{L}\p{N}\n]"
#: What a line of a title or a copyright holds; such lines go at the head of a text, whether they have a year or not.
_TITLE = rf"(?:the{_GAP}+)?(?:(?:new|revised|modified|simplified|original|two{_GAP}?clause|three{_GAP}?clause|[0-4]{_GAP}?clause){_GAP}+)?(?:(?:mit|expat|x11|isc|0?bsd|zlib){_GAP}+(?:(?:zero|two|three|[0-4]){_GAP}?clause{_GAP}+)?)?(?:licen[cs]e|unlicense)(?:{_GAP}+(?:mit|expat|isc|0?bsd))?{_GAP}*"
#: Possessive, so however many lines the head has, they are passed once and nothing is tried again.
_HEAD = rf"\A(?:{_GAP}*(?:(?:copyright\b|\(c\)|©)[^\n]*|all rights reserved{_GAP}*|{_TITLE})?(?:\n|\z))++"
#: Lines that state a copyright: at the head of a text any, further down those with a year, a place for one, or a sign. No part crosses a line end.
COPYRIGHT = rf"{_HEAD}|(?md)^{_GAP}*+(?:(?:copyright\b|\(c\)|©)[^\n]*(?:\d{{4}}|[\[<{{](?:yyyy|year)\b)[^\n]*|copyright[^\p{{L}}\p{{N}}\n(©]*(?:\(c\)|©)[^\n]*|all rights reserved{_GAP}*)$"

#: Texts of notices and short licences.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
)


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of the files in known_licences, which are named after their SPDX id; also without what follows the terms, and with bullets for numbers."""
    out = []
    for file in sorted((resources.files(__package__) / "known_licences").iterdir(), key=lambda f: f.name):
        if file.name.endswith(".txt"):
            name, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
            out.append((name, text))
            if (end := re.search(r"END OF TERMS AND CONDITIONS", text)) is not None:
                out += [(name, text[: end.end()]), (name, text[: end.start()])]
            if name.startswith("BSD-"):
                out.append((name, re.sub(r"(?m)^\d\.", "*", text)))
    return out


#: (license, text) of all that is known.
KNOWN = (*NOTICES, *whole_texts())


def canonical(text: Column) -> Column:
    """Equal for texts that differ only in case, punctuation, white space, copyright lines or equivalent spellings."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    for pattern, form in SPELLINGS:
        out = F.regexp_replace(out, pattern, form)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """digest, license: one row a digest."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    return rows.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """doc_id, license (of the whole text, or null), n_license_lines, licenses (of single lines, sorted, comma-joined).
    `known` is an argument and as long as the caller wrote it, so its digests may be literals of the plan."""
    digests = known_digests(docs.sparkSession, known)
    pairs = [F.lit(x) for row in digests.collect() for x in (row["digest"], row["license"])]
    by_digest = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) > 0)
    found = F.filter(F.transform(lines, lambda x: by_digest[F.sha2(canonical(x), 256)]), lambda x: x.isNotNull())
    whole = docs.select("doc_id", F.sha2(canonical(F.coalesce("text", F.lit(""))), 256).alias("digest"), found.alias("found"))
    return whole.join(digests, "digest", "left").select("doc_id", "license", F.size("found").cast("long").alias("n_license_lines"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("licenses"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    """Line by line, in DuckDB's own terms: lines of the head up to the first other one, then lines that state a copyright, are left out."""
    other = r"[^\p{L}\p{N}]"
    states = rf"{other}*(copyright\b|\(c\)|©).*"
    title = (
        rf"(the{other}+)?((new|revised|modified|simplified|original|(two|three|[0-4]){other}?clause){other}+)?"
        rf"((mit|expat|x11|isc|bsd|0bsd|zlib){other}+((zero|two|three|[0-4]){other}?clause{other}+)?)?(license|licence|unlicense)({other}+(mit|expat|isc|bsd|0bsd))?"
    )
    head = rf"{states}|{other}*(all rights reserved|{title})?{other}*"
    dated = rf"{states}(\d{{4}}|[\[<{{](yyyy|year)\b).*|{other}*copyright[^\p{{L}}\p{{N}}(©]*(\(c\)|©).*|{other}*all rights reserved{other}*"
    lines = f"string_split(lower({text}), chr(10))"
    rest = f"{lines}[coalesce(nullif(list_position(list_transform({lines}, lambda x: regexp_full_match(x, '{head}', 's')), false), 0), 1000000000):]"
    out = f"array_to_string(list_filter({rest}, lambda x: NOT regexp_full_match(x, '{dated}', 's')), chr(10))"
    for pattern, form in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{form}', 'g')"
    return f"sha256(trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"


def op2_sql() -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
WITH k AS (SELECT {_sql_canonical('t')} AS digest, min(name) AS license FROM (VALUES {values}) v(name, t) GROUP BY 1
), d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT doc_id, license FROM (SELECT doc_id, {_sql_canonical('line')} AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE line <> '') JOIN k USING (digest)
), g AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM l GROUP BY doc_id)
SELECT d.doc_id, k.license, coalesce(n, 0) AS n_license_lines, coalesce(names, '') AS licenses
FROM d LEFT JOIN k ON {_sql_canonical('d.text')} = k.digest LEFT JOIN g USING (doc_id)
"""
