from __future__ import annotations

import pytest

from folio.llm.pii import Finder, found_lines, mask, scan, word_use

NAMES = [(g, "given") for g in ("Corlela", "Salemo", "Talene", "Slate", "José-Talu", "Anne-Vela")] + [(f, "family") for f in ("Castrevel", "Ostermann", "Quarry", "van der Ostelen", "O’Brellan", "Ñuvrmark")]
FINDER = Finder(NAMES, ["slate", "quarry"])
CASES = [
    ("Mail x_y.z+tag@dev.mail.example if it breaks.", [("email", "x_y.z+tag@dev.mail.example")]),
    ("contact : a_b [at] corp [dot] test", [("email", "a_b [at] corp [dot] test")]),
    ("see mccoy AT corp-lab DOT example, reply", [("email", "mccoy AT corp-lab DOT example")]),
    ('<a href="mailto:UP@CASE.EXAMPLE">', [("email", "UP@CASE.EXAMPLE")]),
    ("git clone git@forge.example:team/x.git", []),
    ("npm add @slate/pkg@3.1.0 and https://u:p@h.example/ and cc @core-team", []),
    ("Ring 07700 900165 after six.", [("phone", "07700 900165")]),
    ("tel:+44 20 7946 0556", [("phone", "+44 20 7946 0556")]),
    ("phone,(212) 555-0145,office", [("phone", "(212) 555-0145")]),
    ("T +1-303-555-0147 ext. 36", [("phone", "+1-303-555-0147 ext. 36")]),
    ("unter 0221/4710969.", [("phone", "0221/4710969")]),
    ("le 06.39.98.31.26 le soir", [("phone", "06.39.98.31.26")]),
    ("al 600-000-285 y 900 00 68 51", [("phone", "600-000-285"), ("phone", "900 00 68 51")]),
    ("0033 639 98 74 12", [("phone", "0033 639 98 74 12")]),
    ("build 20250383-8365 part no. 80-97553-7 ticket #1335349, lines 234-547 on 192.0.2.184:14679", []),
    ("total 1 293 639 bytes 2025-12-24 07:18:26 position 48.63229, 16.75857 v1.2.3", []),
    ("SSN 921-39-9495 in clear", [("id_number", "921-39-9495")]),
    ("NI number QQ 83 85 74 C was kept", [("id_number", "QQ 83 85 74 C")]),
    ("Steuer-ID 00 947 722 623 im", [("id_number", "00 947 722 623")]),
    ("NIR 1 50 05 99 015 041 42 et n° sécu 2701099259234 18", [("id_number", "1 50 05 99 015 041 42"), ("id_number", "2701099259234 18")]),
    ("passport no. X53828067, Ausweis-Nr. LM3FCCCFR im", [("id_number", "X53828067"), ("id_number", "LM3FCCCFR")]),
    ("DNI: 99206175-E en claro", [("id_number", "99206175-E")]),
    ("Ship to 86 Oldferry Street, Apt 3", [("address", "86 Oldferry Street")]),
    ("au 18, rue des Tanneries-Bleues, 00307", [("address", "18, rue des Tanneries-Bleues")]),
    ("geht an Ostelweg 101c, und Altföhrer Straße 138", [("address", "Ostelweg 101c"), ("address", "Altföhrer Straße 138")]),
    ("a Calle del Alcotán, 164, 00859", [("address", "Calle del Alcotán, 164")]),
    ("lane 19 of the scheduler is idle", []),
    ("Thanks to Corlela Castrevel for", [("name", "Corlela Castrevel")]),
    ("by TALENE OSTERMANN on", [("name", "TALENE OSTERMANN")]),
    ("(Ostermann, Salemo)", [("name", "Ostermann, Salemo")]),
    ("Reported by Ostermann, Ullovin on Monday", [("name", "Ostermann, Ullovin")]),
    ("Dear Ms Unlisted, hello", [("name", "Unlisted")]),
    ("Hola Sr.\nOstermann,", [("name", "Ostermann")]),
    ("Assigned to: Jorin Ostermann", [("name", "Jorin Ostermann")]),
    ("Talene A. and W. Castrevel", [("name", "Talene A."), ("name", "W. Castrevel")]),
    ("José-Talu van der Ostelen", [("name", "José-Talu van der Ostelen")]),
    ("Slate Quarry asked; ## Slate strict; Slate release: see", [("name", "Slate Quarry")]),
    ("On Monday Wei Zhang wrote: no", [("name", "Wei Zhang")]),
    ("Contact: Petra Novak", [("name", "Petra Novak")]),
    ("Contact: Support Team", []),
    ("IBAN GB82 WEST 1234 5698 7654 32 and not GB83 WEST 1234 5698 7654 32", [("account", "GB82 WEST 1234 5698 7654 32")]),
    ("card 4111 1111 1111 1111, not 4111 1111 1111 1112", [("account", "4111 1111 1111 1111")]),
    ("call 321-4567 now; rows 321-4567", [("phone", "321-4567")]),
    ("Signed-off-by: Xenra Pollo <", [("name", "Xenra Pollo")]),
    ("Upper Pellworth Tide Gauge, the Cold Slate module moved", []),
]


@pytest.mark.parametrize(("text", "items"), CASES)
def test_items(text, items):
    got = FINDER.find(text)
    assert [(k, text[a:b]) for a, b, k in got] == items


def test_mask_changes_nothing_else():
    text = "Hi Ms Unlisted,\r\nmail a.b@c.example or +44 20 7946 0556."
    assert mask(text, FINDER.find(text)) == "Hi Ms [NAME],\r\nmail [EMAIL] or [PHONE]."
    assert mask(None, []) is None and FINDER.find(None) == [] and FINDER.find("") == []


def test_length_changing_case_and_long_text():
    text = "İ" * 50 + "\n" + "word " * 50_000 + "\na.b@c.example"
    assert [(text.count("\n", 0, a), k) for a, _, k in FINDER.find(text)] == [(2, "email")]


def test_many_items_take_linear_time():
    import time

    began = time.time()
    assert len(FINDER.find("a.b@c.example x\n" * 40_000)) == 40_000
    assert FINDER.find("Dr. " * 50_000) == []
    assert time.time() - began < 20


def test_ordinary_words_come_from_the_corpus(spark):
    lex = spark.createDataFrame(NAMES, "name string, name_part string")
    docs = spark.createDataFrame([(1, "the slate is on the slate. Slate runs; Talene Ostermann"), (2, "Talene and slate, @quarry a.quarry"), (3, None)], "doc_id bigint, text string")
    assert {r[0]: r[1:] for r in word_use(docs, lex).collect()} == {"slate": (3, 1), "talene": (0, 2), "ostermann": (0, 1)}
    assert found_lines(docs, lex).count() == 1


def test_tables(spark):
    lex = spark.createDataFrame([*NAMES, (None, "given")], "name string, name_part string")
    df = spark.createDataFrame([(1, "x\nTalene Ostermann a@b.example, c@b.example", 0), (2, None, 0), (3, "", 0), (1, "x\nTalene Ostermann a@b.example, c@b.example", 1)], "doc_id bigint, text string, items int")
    assert sorted(map(tuple, found_lines(df, lex).collect())) == [(1, 2, "email"), (1, 2, "name")]
    assert scan(df.where("false"), lex).count() == 0
    assert found_lines(df, lex.where("false")).where("pii_type = 'email'").count() == 1
    with pytest.raises(ValueError):
        scan(df, lex, max_names=3)
