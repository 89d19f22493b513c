"""Personal data: base spans against the plain patterns, disguised ones by construction."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in (("card", CARD, 14, 19), ("phone", PHONE, 10, 15)):
        for m in pattern.finditer(text):
            d = re.sub(r"[^0-9]", "", m[0])
            if least <= len(d) <= most and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


PARTS = ["a@b.c", "@", ".", "x.y", "_", "%", "+", "1", "23", "4.5", "255", "256", "0255", " ", "-", "(", ")", "+1 (743) 555-3824",
         "4465758382889437", "é", "\n", "a", "Z-", "192.168.0.1", "..", "5 5-5", "at", " dot ", "oh"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_matches_plain_patterns(text):
    assert sorted(pii.detect(text), key=lambda x: (x[1], pii.KINDS.index(x[0]))) == plain(text)
    found = pii.find(text)
    assert [f[:3] for f in found if f[3]] == plain(text)
    for kind, s, e, base in found:
        assert 0 <= s < e <= len(text)
        if not base:
            assert all(e <= s2 or e2 <= s for k, s2, e2, b in found if b and k == kind)


DISGUISED = [
    ("email", "john.doe [at] example [dot] com"), ("email", "john(at)mail.example.com"), ("email", "john {AT} example{dot}co{dot}uk"),
    ("email", "john at example dot com"), ("email", "john dot doe at mail dot example dot com"), ("email", "jоhn@exаmple.com"),
    ("email", "ｊohn＠example．com"), ("email", "jo\u200bhn@exam\u00adple.com"), ("email", "john @ example.com"),
    ("email", "john @ example . com"), ("email", "john_at_example_dot_com"), ("email", "johnATexampleDOTcom"),
    ("email", "john&#64;example&#46;com"), ("email", "j.doe7 at example.com"), ("email", "juan arroba ejemplo punto es"),
    ("email", "john <at> example <dot> com"), ("email", "john -at- example -dot- com"),
    ("ip", "192[.]168[.]0[.]1"), ("ip", "192 dot 168 dot 0 dot 1"), ("ip", "one nine two dot one six eight dot zero dot one"),
    ("ip", "１９２．１６８．０．１"), ("ip", "l92.168.O.1"), ("ip", "192(dot)168(dot)0(dot)1"),
    ("card", "４４６５７５８３８２８８９４３７"), ("card", "4465\u00a07583\u00a08288\u00a09437"), ("card", "4465\u20137583\u20138288\u20139437"),
    ("card", "four four six five seven five eight three eight two eight eight nine four three seven"),
    ("card", "44\u200b65758382889437"), ("card", "double four six five 7583 8288 9437"),
    ("phone", "+1 seven four three five five five three eight two four"), ("phone", "plus one seven four three 555 3824"),
    ("phone", "＋1 (743) 555-3824"), ("phone", "+1 (743) 555\u20113824"), ("phone", "plus 1 743 555 3824"),
    ("phone", "+un sept quatre trois cinq cinq cinq trois huit deux quatre"), ("phone", "+1 (743) 5SS-3824".replace("S", "5")),
    ("phone", "+I (743) 555-38Z4".replace("Z", "2")), ("phone", "+٤٩ ١٥١ ٢٣٤٥٦٧٨"),
]


def test_disguises_are_found_at_their_source_positions():
    for kind, item in DISGUISED:
        for before, after in (("", ""), ("Schreib uns: ", ", bitte"), ("é文\n", "\nend of it"), ("the thing (", ") was")):
            text = before + item + after
            spans = [f for f in pii.find(text) if f[0] == kind]
            assert [(s, e) for _, s, e, _ in spans] == [(len(before), len(before) + len(item))], (text, pii.find(text))


CLEAN = ["We met at noon. Dot the i and look at it.", "Un point de vue, at the dot of five", "look-at-me.com is a site, at that",
         "five six seven eight, then nine", "plus 3 autres", "see 1.2.3 and 3 point 5", "come at example. Then go", "cat dot dog",
         "а б в г д, почта", "3l of milk, 10l of oil, O2", "lunch at two, dinner at eight", "1O 2O", "x @ y", "&amp; &#64;"]


def test_clean_texts_get_nothing():
    for text in CLEAN:
        assert pii.find(text) == [], (text, pii.find(text))


def test_mapping_keeps_base_and_order():
    text = "a@b.co or c [at] d [dot] org, 10.0.0.1 and 10[.]0[.]0[.]2"
    assert [f[0] + ("" if f[3] else "*") for f in pii.find(text)] == ["email", "email*", "ip", "ip*"]
    assert pii.masked(text) == "<EMAIL> or <EMAIL>, <IP> and <IP>"


DOCS = "doc_id long, text string, row int, spans string, base boolean"


def test_digests(spark):
    long = "word " * 60_000
    texts = [None, "", "a@b.co", "a@b.co", long + "x [at] y [dot] com " + long, "9" * 100_000, "a" * 100_000, "+1" + " " * 100_000, "@" * 50_000]
    rows = [(i, t, 7, "s", True) for i, t in enumerate(texts)] + [(None, "1.2.3.4", 7, "s", True), (2, "a@b.co", 7, "s", True)]
    out = pii.pii_digests(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(out) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    by_id = {r.doc_id: r for r in out}
    assert by_id[0].base_sha256 == by_id[1].base_sha256 == empty and by_id[0].spans == ""
    assert by_id[2].spans == "email:0:6" and by_id[2].n_email == 1 and by_id[2].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest()
    assert by_id[4].spans == f"email:{len(long)}:{len(long) + 18}" and by_id[4].n_email == 0 and by_id[4].n_added == 1
    assert by_id[4].base_sha256 == empty and by_id[None].n_ip == 1
    assert pii.pii_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_redact_keeps_other_columns(spark):
    rows = [(1, "mail a [at] b [dot] org now", 7, "s", True), (2, None, 8, "t", False)]
    out = sorted(map(tuple, pii.redact(spark.createDataFrame(rows, DOCS)).collect()))
    assert out == [(1, "mail <EMAIL> now", 7, "s", True), (2, None, 8, "t", False)]
