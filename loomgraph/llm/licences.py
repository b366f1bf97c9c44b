"""License scans by canonical digest lookup.

A text is brought to a canonical form: copyright notices dropped (lines that begin with one, not prose that is wrapped before
"copyright"), A-Z lower-cased, punctuation turned to spaces, equivalent
spellings made one.  Its SHA-256 is then hash-joined to the digests of known licences.  The same lookup is made for every
line, which finds the one-line notices that stand inside longer texts.

Cases: a null or empty text (or one of punctuation alone) has an empty canonical form and matches nothing; repeated lines
of one notice count once; known texts that come to the same digest are given under the first of their names.
"""

from __future__ import annotations

import hashlib
import json
import pkgutil
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import slices, staged, text_bytes

#: Bytes of text that are canonicalised together.
CHUNK = 8_000_000

# Spellings that licence matching treats as equal, each with the one that stands for it.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "colour": "color",
    "copyright holder": "copyright owner",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "non commercial": "noncommercial",
    "organisation": "organization",
    "per cent": "percent",
    "recognise": "recognize",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
}

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Known licences and notices by SPDX name, as published.
KNOWN = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS,
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


# the same texts under their usual titles
_TITLES = (("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("0BSD", "BSD Zero Clause License"), ("0BSD", "Zero-Clause BSD"))
KNOWN += tuple((n, f"{title}\n\n{next(t for m, t in KNOWN if m == n)}") for n, title in _TITLES)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
# A line is a notice that begins with the sign, with "copyright" and (c), the sign, a year or a place to fill in, or with (c) and one of
# these; "Copyright" before a name in capitals, unless one of licence prose; and (c) alone, unless the text counts its points (a), (b), (c).
_DATED = r"(?:\(c\)|©|copyright|(?:19|20)[0-9][0-9]|[<\[{])"
_SURE = re.compile(rf"(^|\n)[ \t]*(?:©|copyright[ \t:,]*{_DATED}|\(c\)[ \t]*{_DATED})[^\n]*".encode(), re.IGNORECASE)
_NAMED = re.compile(rb"(^|\n)[ \t]*Copyright[ \t]+(?:by[ \t]+)?(?!(?:Notice|Holder|Owner|Licen[cs]e|Law|Act|Treat|Statement|Right|Interest|Protection|Disclaimer|Permission)(?:s|ies|y)?\b)[A-Z][^\n]*")
_POINT = re.compile(rb"(^|\n)[ \t]*\(c\)[^\n]*", re.IGNORECASE)
_SPELLINGS = [(old.encode(), re.compile(b"(?<![^ ])" + old.encode() + b"(?![^ ])"), new.encode()) for old, new in SPELLINGS.items()]


def canonical(text: bytes) -> bytes:
    """The form in which texts of one licence are equal."""
    t = text.translate(_LOWER)
    if b"copyright" in t or b"(c)" in t or b"\xc2\xa9" in t:
        text = _NAMED.sub(rb"\1", _SURE.sub(rb"\1", text))
        if b"(b)" not in t:
            text = _POINT.sub(rb"\1", text)
        t = text.translate(_LOWER)
    t = b" ".join(t.translate(_BLANK).split())
    for old, pattern, new in _SPELLINGS:
        if old in t:
            t = pattern.sub(new, t)
    return t


def digest(text: bytes) -> str | None:
    """SHA-256 of the canonical form; None where that is empty."""
    form = canonical(text)
    return hashlib.sha256(form).hexdigest() if form else None


def canonical_sql(text: str) -> str:
    """canonical() as DuckDB SQL, save that it drops any line that begins with "copyright", (c) or the sign, prose too."""
    t = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    t = rf"regexp_replace({t}, '(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*', '\1', 'g')"
    t = rf"regexp_replace({t}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')"
    for old, new in SPELLINGS.items():
        t = rf"regexp_replace({t}, '(^| ){old.replace(' ', '  ')}( |$)', '\1{new.replace(' ', '  ')}\2', 'g')"
    return f"trim(replace({t}, '  ', ' '))"


def digests(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, key, digest, lines): the md5 of the text itself, the digest of its canonical form and those of its different lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", CHUNK):
                texts = text_bytes(b.column(1))
                lines = [sorted({d for x in set(t.split(b"\n")) if (d := digest(x))}) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array([digest(t) for t in texts], pa.string()), pa.array(lines, pa.list_(pa.string()))],
                    names=["id", "key", "digest", "lines"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, key binary, digest string, lines array<string>")


def whole_texts() -> list[tuple[str, str]]:
    """(SPDX name, text) of the whole licences of licence_texts.json as published, and of the other forms in which they are usual: without
    the appendix on how to apply them, and the short ones of BSD with a title, "All rights reserved." and bullets."""
    out = []
    for r in json.loads(pkgutil.get_data("loomgraph.llm", "licence_texts.json") or b"[]"):
        name, text = r["license_id"], r["text"]
        out.append((name, text))
        head, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out += [(name, head + end), (name, head)]
        if name.startswith("BSD-"):
            kind = name.split("-")[1]
            titles = ("", f"BSD {kind}-Clause License", f"The BSD {kind}-Clause License", *(("BSD License",) if kind == "3" else ()), *(("Simplified BSD License",) if kind == "2" else ()))
            bare = re.sub(r"(?m)^[ \t]*[0-9]\.", "*", text)
            out += [(name, f"{t}\n\n{rights}\n\n{x}") for t in titles for rights in ("", "All rights reserved.") for x in (text, bare)]
    return out


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(known_digest, license_id) of the known licences: by default of KNOWN and the whole texts, else of a table with license_id and text."""
    if known is None:
        return spark.createDataFrame(sorted({digest(t.encode()): n for n, t in reversed([*KNOWN, *whole_texts()])}.items()), "known_digest string, license_id string")
    return digests(known, "license_id", "text").where("digest is not null").groupBy(F.col("digest").alias("known_digest")).agg(F.min("id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: its identifier, digest, license_id (the licence that the entire text is, or null) and notices (the licences
    that single lines of it are, sorted and comma-joined, or null)."""
    table = known_digests(docs.sparkSession, known)
    rows = staged(digests(docs, id_col, text), "digests")
    # which notices a text has depends on the text alone, so copies share them
    lines = rows.select("key", F.explode("lines").alias("known_digest"))
    notices = lines.join(table, "known_digest").select("key", "license_id").distinct().groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("license_id")), ",").alias("notices"))
    return (
        rows.select("id", "key", "digest")
        .join(table.withColumnRenamed("known_digest", "digest"), "digest", "left")
        .join(notices, "key", "left")
        .select(F.col("id").alias(id_col), "digest", "license_id", "notices")
    )


def scan_sql() -> str:
    """scan() of documents as DuckDB SQL; of the known licences it has those of KNOWN."""
    known = " UNION ALL ".join("SELECT '" + n + "' AS license_id, '" + t.replace("'", "''") + "' AS text" for n, t in KNOWN)
    return f"""
WITH forms AS (SELECT license_id, {canonical_sql("text")} AS form FROM ({known})),
known AS (SELECT sha256(form) AS d, min(license_id) AS license_id FROM forms WHERE form <> '' GROUP BY 1),
rows_ AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, {canonical_sql("text")} AS form FROM documents),
lines AS (SELECT row_id, {canonical_sql("line")} AS form FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM rows_)),
found AS (SELECT row_id, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM (SELECT DISTINCT row_id, license_id FROM lines JOIN known ON sha256(form) = d WHERE form <> '') GROUP BY row_id)
SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, known.license_id AS license_id, notices
FROM rows_ LEFT JOIN known ON form <> '' AND sha256(form) = d LEFT JOIN found ON rows_.row_id = found.row_id
"""
