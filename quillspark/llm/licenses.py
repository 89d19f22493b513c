"""Licence scans: canonical digests of whole texts and whole lines against known ones."""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import LOWER, UPPER, text_or_empty
from quillspark.llm.license_texts import whole_texts
from quillspark.sinks.snapshots import materialize

# Spellings that licence matching guidelines treat as the same, as whole words.
EQUIVALENTS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencor", "licensor"),
    ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"), ("recognise", "recognize"),
    ("recognised", "recognized"), ("behaviour", "behavior"), ("programme", "program"), ("centre", "center"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("merchantability", "merchantability"),
    ("sub license", "sublicense"), ("sub licenses", "sublicenses"), ("non commercial", "noncommercial"),
    ("whilst", "while"), ("per cent", "percent"), ("wilful", "willful"), ("initialise", "initialize"),
    ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("cancelled", "canceled"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("artefact", "artifact"), ("catalogue", "catalog"), ("defence", "defense"), ("labelled", "labeled"),
)

# Published short licences and customary notices, by SPDX identifier.
KNOWN_TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

# A notice: marks followed by a year or a holder's placeholder, "copyright" and a sign together, or a line that ends
# in "all rights reserved". Other lines that begin with a mark are text ("copyright notice ...", a clause "(c) You ...").
_YEAR = r"[\[<{(]?(19|20)[0-9]{2}(?![0-9])"
_HOLDER = r"([\[<{(]+[^\n\]>})]{0,60}(year|yyyy|date|name|owner|holder|author|compan|organi)|yyyy|year[ \t]+name)"
NOTICE_LINE = (r"(^|\n)[ \t]*(((copyright|\(c\)|©)[ \t:,]*)+(" + _YEAR + "|" + _HOLDER + r")[^\n]*"
               r"|(copyright[ \t]*(\(c\)|©)|©[ \t]*copyright)[^\n]*"
               r"|(copyright|©)[^\n]*all rights reserved[. \t\r]*(?![^\n])"
               r"|all rights reserved\.?[ \t]*)")


def _same(out: Column, words: bool) -> Column:
    """Equivalents of one word, or those of several, between doubled spaces."""
    for word, same in EQUIVALENTS:
        if (" " not in word) == words:
            out = F.replace(out, F.lit(f" {word.replace(' ', '  ')} "), F.lit(f" {same.replace(' ', '  ')} "))
    return out


def _marked(text: Column) -> Column:
    """Words between doubled spaces, line breaks kept as words of their own."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), NOTICE_LINE, "\n")
    out = F.replace(F.regexp_replace(out, "[^a-z0-9\n]+", "  "), F.lit("\n"), F.lit("  \n  "))
    return _same(F.concat(F.lit(" "), out, F.lit(" ")), words=True)


def _finish(marked: Column) -> Column:
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.trim(marked), "[ \n]+", "  "), F.lit(" "))
    return F.trim(F.replace(_same(spaced, words=False), F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, one space between, without
    copyright notices and with one spelling of equivalent words."""
    return _finish(_marked(text))


# The same lines for an engine without lookahead: what must not follow is read to the end of the line instead.
NOTICE_LINE_RE2 = (NOTICE_LINE.replace(_YEAR + "|" + _HOLDER + r")[^\n]*",
                                       _YEAR.replace("(?![0-9])", r"([^0-9\n][^\n]*)?(?m:$)") + "|" + _HOLDER + r"[^\n]*)")
                   .replace(r"(?![^\n])", "(?m:$)"))


def canonical_sql(text: str) -> tuple[str, str]:
    """The rule for the SQL check: text -> marked, and marked -> canonical."""
    marked = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{NOTICE_LINE_RE2}', chr(10), 'g')"
    marked = f"' ' || replace(regexp_replace({marked}, '[^a-z0-9\n]+', '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || ' '"
    for word, same in EQUIVALENTS:
        if " " not in word:
            marked = f"replace({marked}, ' {word} ', ' {same} ')"
    done = "' ' || regexp_replace(trim({}), '[ \n]+', '  ', 'g') || ' '"
    for word, same in EQUIVALENTS:
        if " " in word:
            done = f"replace({done}, ' {word.replace(' ', '  ')} ', ' {same.replace(' ', '  ')} ')"
    return marked, f"trim(replace({done}, '  ', ' '))"


def plain_canonical(text: str) -> str:
    """The rule of ``canonical`` on one text without Spark."""
    text = re.sub(NOTICE_LINE, "\n", text.translate(str.maketrans(UPPER, LOWER)))
    words = re.findall("[a-z0-9]+", text)
    single = {a: b for a, b in EQUIVALENTS if " " not in a}
    out = "  ".join(single.get(w, w) for w in words)
    for a, b in EQUIVALENTS:
        if " " in a:
            out = f" {out} ".replace(f" {a.replace(' ', '  ')} ", f" {b.replace(' ', '  ')} ")[1:-1]
    return out.replace("  ", " ")


def _known(texts=None) -> list[tuple[str, list[str], str]]:
    given = [(a, [""], b) for a, b in (KNOWN_TEXTS if texts is None else texts)]
    return given + whole_texts(KNOWN_TEXTS[:3]) if texts is None else given


def plain_digests() -> dict[str, str]:
    """Digest -> identifier of the default texts without Spark, for the SQL check."""
    out: dict[str, str] = {}
    for license_id, titles, text in _known():
        body = plain_canonical(text)
        for title in titles:
            digest = sha256(f"{plain_canonical(title)} {body}".strip().encode()).hexdigest()
            out[digest] = min(license_id, out.get(digest, license_id))
    return out


def known_digests(spark: SparkSession, texts=None) -> DataFrame:
    """(digest, license_id): one row per canonical text; the first identifier by name counts.

    ``texts`` are pairs (license_id, text); by default ``KNOWN_TEXTS`` and the
    whole texts of ``license_texts``, each with and without its titles."""
    rows = spark.createDataFrame(_known(texts), "license_id string, titles array<string>, text string").select(
        "license_id", canonical(F.col("text")).alias("text"), F.explode("titles").alias("title"))
    whole = F.trim(F.concat_ws(" ", canonical(F.col("title")), F.col("text")))
    return rows.groupBy(F.sha2(whole, 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_digest, license_id (the whole text is that
    licence, else null), line_licenses (identifiers of lines that are a whole
    known notice, sorted, distinct, joined by commas; null if none).

    ``known(digest, license_id)`` may be a table of any size: both lookups are
    hash joins. Only the digests of lines travel, and equal lines of a document
    are one. Null and empty texts have the digest of the empty text, which is no
    licence. Repeated rows give equal rows.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    known = known.where(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256))
    marked = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                         _marked(text_or_empty(text_col)).alias("_m"))
    digests = materialize(marked.select(
        "doc_id", "row", F.sha2(_finish(F.col("_m")), 256).alias("text_digest"),
        F.transform(F.array_distinct(F.split("_m", "\n", -1)), lambda line: F.sha2(_finish(line), 256)).alias("lines")),
        "license_digests")
    lines = (digests.select("row", F.explode(F.array_distinct("lines")).alias("digest")).join(known, "digest")
             .groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("line_licenses")))
    return (digests.select("doc_id", "row", "text_digest")
            .join(known.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
            .join(lines, "row", "left").select("doc_id", "text_digest", "license_id", "line_licenses"))
