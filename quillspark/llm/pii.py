"""Personal data: transducers undo disguises and keep track of source positions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import text_or_empty
from quillspark.session import ship_package

# The kinds in their order and their patterns. Possessive forms
# give the same matches without going back over long runs.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like a Latin one.
HOMOGLYPHS = dict(zip("авеіјкмнорсѕтухԁһӏԛԝАВЕЅІЈКМНОРСТУХ", "abeijkmhopcstyxdhlqwABESIJKMHOPCTYX")) | dict(
    zip("αικνορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aikvopuxABEZHIKMNOPTYX")) | dict(zip("ıɑɡ∙․。｡﹒·", "iag......"))
# Digits as words in the languages of the documents.
DIGIT_WORDS = {w: str(d) for words in ("zero one two three four five six seven eight nine",
                                       "null eins zwei drei vier fünf sechs sieben acht neun",
                                       "zéro un deux trois quatre cinq six sept huit neuf",
                                       "cero uno dos tres cuatro cinco seis siete ocho nueve")
               for d, w in enumerate(words.split())} | {"oh": "0"}
AT_WORDS = ("at", "arroba", "arobase")
DOT_WORDS = ("dot", "punto", "point", "punkt")

DOT = "\ue000"   # a dot that was disguised, until the addresses around it are settled


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: an address holds one @, so each @ is tried with all that
    may stand before it and is not taken yet."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, free
        at = text.find("@", free)


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base identifiers as (kind, start, end), kinds in order."""
    found = [("email", s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def _plain(c: str) -> str | None:
    """What a character stands for in an identifier; None: itself."""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    category = unicodedata.category(c)
    if category == "Cf":
        return ""
    if category == "Zs":
        return " "
    if category == "Pd":
        return "-"
    if category == "Nd":
        return str(unicodedata.decimal(c))
    if c == DOT:
        return "\ufffd"
    same = unicodedata.normalize("NFKC", c)
    return same if same.isascii() and same.isprintable() and (len(same) == 1 or same.isalpha()) else None


# Homoglyphs, other digits, spaces and dashes, full-width and styled letters, invisible characters.
PLAIN = {c: p for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0080)])
         if (p := _plain(c)) is not None}
ODD = re.compile(r"[^\x00-\x9f\u00c0-\u0130\u0132-\u024f]")         # all but ASCII and Latin letters

_ANY_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_GAP = r"(?:[ \t]?[,-][ \t]{0,2}|[ \t]{1,2})"
_AT, _DOTS = "|".join(AT_WORDS), "|".join(DOT_WORDS)
WORDS = re.compile(r"[^\W_]+")
TRIGGERS = {*DIGIT_WORDS, *AT_WORDS, *DOT_WORDS, "plus", "double", "triple"} - {"at", "un", "oh"}
BRACKETED = re.compile(r"[\[({<]\s{0,3}(?:at|@|\.)", re.I)
SPACED = re.compile(r"[ \t]@|@[ \t]")
NAMED = re.compile(r" (?:at|arroba|arobase)[ \t]{1,3}[a-z0-9-]{1,63}+\.[a-z0-9]")
NEAR_DIGIT = re.compile(r"[0-9.+][OolI]|[OolI][0-9]")
ENTITIES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@", "&#46;": DOT, "&#x2e;": DOT, "&period;": DOT, "%2e": DOT,
            "&#43;": "+", "&#x2b;": "+", "&plus;": "+"}
BRACKETED_DOT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]{{0,3}}[\[({{<]\s{{0,3}}(?:{_DOTS}|\.)\s{{0,3}}[\])}}>][ \t]{{0,3}}(?=[A-Za-z0-9])", re.I)
WORD_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:[ \t]{{1,3}}(?:{_DOTS})[ \t]{{1,3}}|[ \t]{{0,3}}([-_*|/~])dot\1[ \t]{{0,3}})(?=[A-Za-z0-9])", re.I)
GLUED_DOT = re.compile(r"(?<=[a-z0-9])DOT(?=[a-z0-9])")
DIGIT = re.compile(rf"(?<![^\W_])(?:(double|triple)[ \t]{{1,2}})?({_ANY_DIGIT})(?![^\W_])({_GAP}(?=(?:(?:double|triple)[ \t]{{1,2}})?"
                   rf"(?:{_ANY_DIGIT})(?![^\W_])))?", re.I)
LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])(?=[OolI]*[0-9])[0-9OolI]*[OolI][0-9OolI]*+(?![A-Za-z0-9])|(?<=[0-9]\.)[OolI](?=\.[0-9])"
                           r"|(?<=\+)[OolI](?=[\x20(.-]{1,2}[0-9])")
BRACKETED_AT = re.compile(rf"(?<=[A-Za-z0-9])[ \t]{{0,3}}[\[({{<]\s{{0,3}}(?:{_AT}|@)\s{{0,3}}[\])}}>][ \t]{{0,3}}(?=[A-Za-z0-9])", re.I)
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?:[ \t]{1,3}@[ \t]{0,3}|@[ \t]{1,3})(?=[A-Za-z0-9])")
WORD_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:[ \t]{{1,3}}(?:{_AT})[ \t]{{1,3}}|[ \t]{{0,3}}([-_*|/~])at\1[ \t]{{0,3}})"
                     rf"(?=[A-Za-z0-9-]{{1,63}}?([.{DOT}])[A-Za-z0-9])", re.I)
GLUED_AT = re.compile(rf"(?<=[a-z0-9])AT(?=[a-z0-9-]{{1,63}}{DOT}[a-z0-9])")
SPACED_DOT = re.compile(r"(?<=[A-Za-z])[ \t]{1,3}\.[ \t]{1,3}(?=[A-Za-z])")
PLUS = re.compile(r"(?<![^\W_])plus[ \t]{1,2}(?=[0-9])", re.I)


class Tape:
    """A text under rewriting, with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int64)
        self.end = self.start + 1

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str | None]) -> None:
        """One transducer: what ``to`` gives replaces a match (None: it stays) and
        each new character points at the whole of it."""
        text, starts, ends, done = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = to(m)
            if new is None or m.end() == m.start():
                continue
            text += [self.text[done: m.start()], new]
            starts += [self.start[done: m.start()], np.full(len(new), self.start[m.start()])]
            ends += [self.end[done: m.start()], np.full(len(new), self.end[m.end() - 1])]
            done = m.end()
        if text:
            self.text = "".join([*text, self.text[done:]])
            self.start = np.concatenate([*starts, self.start[done:]])
            self.end = np.concatenate([*ends, self.end[done:]])


def _spelled(m: re.Match) -> str | None:
    """A digit word counts beside another one, a digit, a plus or a disguised dot."""
    text, digit = m.string, DIGIT_WORDS[m[2].lower()]
    if not m[3]:
        before, after = text[max(0, m.start() - 12): m.start()], text[m.end(): m.end() + 2]
        last = re.search(rf"(?:({_ANY_DIGIT}){_GAP}|[0-9][ -]?|[+.{DOT}]|plus[ \t]{{1,2}})$", before, re.I)
        if not last and not m[1] and not re.match(rf"[ -]?[0-9]|[.{DOT}]", after):
            return None
    return digit * {"double": 2, "triple": 3}.get((m[1] or "").lower(), 1)


def _word_at(m: re.Match) -> str | None:
    """Between words, 'at' needs a disguised dot behind it or a name that looks like an account."""
    if m[2] == DOT:
        return "@"
    if m[1]:
        return None
    name = LOCAL.search(m.string, max(0, m.start() - 64), m.start())
    return "@" if name and re.search(r"[A-Za-z]", name[0]) and re.search(r"[0-9]|[a-z0-9][._+][A-Za-z0-9]", name[0]) else None


def _disguised(text: str) -> bool:
    """Whether any rule but the one of odd characters may apply: cheap tests first."""
    lower = text.lower()
    return bool("DOT" in text or any(e in lower for e in ENTITIES) or not TRIGGERS.isdisjoint(WORDS.findall(lower))
                or BRACKETED.search(text) or ("@" in text and SPACED.search(text)) or NAMED.search(lower) or NEAR_DIGIT.search(text))


def normalise(text: str) -> Tape | None:
    """The text without disguises; None where there is none."""
    odd = not text.isascii() and not PLAIN.keys().isdisjoint(ODD.findall(text))
    if not odd and not _disguised(text):
        return None
    tape = Tape(text)
    if odd:
        tape.rewrite(ODD, lambda m: PLAIN.get(m[0]))
    tape.rewrite(re.compile("|".join(map(re.escape, ENTITIES)), re.I), lambda m: ENTITIES[m[0].lower()])
    for dot in (BRACKETED_DOT, WORD_DOT, GLUED_DOT):
        tape.rewrite(dot, lambda m: DOT)
    tape.rewrite(DIGIT, _spelled)
    tape.rewrite(LETTER_DIGITS, lambda m: re.sub("[lI]", "1", re.sub("[Oo]", "0", m[0])))
    tape.rewrite(BRACKETED_AT, lambda m: "@")
    tape.rewrite(SPACED_AT, lambda m: "@")
    tape.rewrite(WORD_AT, _word_at)
    tape.rewrite(GLUED_AT, lambda m: "@")
    if "@" in tape.text:
        tape.rewrite(SPACED_DOT, lambda m: ".")
    tape.rewrite(re.compile(DOT), lambda m: ".")
    tape.rewrite(PLUS, lambda m: "+")
    return tape


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, base) of a text by start, then kind, then end.

    Base spans match the text as it is. The others match what the transducers make
    of it, are given in positions of the source, and overlap no base span of their kind."""
    base = detect(text)
    spans = [(*span, True) for span in base]
    tape = normalise(text)
    if tape is not None:
        taken = {k: sorted((s, e) for kind, s, e in base if kind == k) for k in KINDS}
        for kind, s, e in detect(tape.text):
            start, end = int(tape.start[s]), int(tape.end[e - 1])
            places = np.searchsorted([x[0] for x in taken[kind]], end) if taken[kind] else 0
            if not places or taken[kind][places - 1][1] <= start:
                spans.append((kind, start, end, False))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text")
        out = [[dict(zip(("kind", "start", "end", "base"), span)) for span in find(t.as_py())] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(out, SPANS)], names=["doc_id", "row", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, row, spans (array of kind, start, end, base).

    Positions count code points, ends are exclusive. Kinds: email, ip, card, phone.
    ``base`` spans match the text as it stands. The others come from disguises:
    look-alike letters, foreign digits and invisible characters; 'at' and 'dot' as
    words, in brackets, or with spaces around the sign; digits as words in four
    languages, letters that stand for digits, 'plus'. Whole texts are read, and
    each is handled on its own in one pass per rule, however long. Null and
    empty texts have no spans; repeated rows and ids stay apart by ``row``; an
    empty table gives an empty result; other columns are not read.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_find_batches, f"doc_id {kind}, row long, spans array<struct<kind: string, start: int, end: int, base: boolean>>")


def masked(text: str) -> str:
    """The text with each span, overlapping ones together, replaced by its first kind."""
    out, done, spans = [], 0, find(text)
    at = 0
    while at < len(spans):
        kind, start, end, _ = spans[at]
        while at < len(spans) and spans[at][1] < end:
            end = max(end, spans[at][2])
            at += 1
        out += [text[done:start], f"<{kind.upper()}>"]
        done = end
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all found data in ``text_col`` replaced by ``<KIND>``; null texts
    stay null, other columns and repeated rows stay as they are."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if t is None else masked(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
    return docs.mapInArrow(run, docs.schema)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of base spans by kind, base_sha256, spans, n_added.

    Without spans the texts that are joined are empty."""
    found = find_pii(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
