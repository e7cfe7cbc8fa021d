from __future__ import annotations

import pytest

from folio.llm.mojibake import found_ids, repair, repair_text

GOOD = [
    "Ningún búsqueda contó su etiqueta sin la línea. ¿Por qué?",
    "NÃO APAGUE A página: VERSÃO DA função.",
    "À 639 reprises, le modèle génère l'ancien « clé »…",
    "Die äußere Länge – “quoted” – don’t; 3 € §4 5° ±2 × ÷",
    "Буфер пишет запрос и индекс. Её ёмкость. КАПС",
    "如果文件过大，则先拆分再处理。",
    "処理の再試行を確認してから境界を行う。",
    "étude 🏳️‍🌈 👩‍🔬 ﷽",
    "Każdy źródło sprawdza gałąź.",
    "한국어 문장입니다",
    'a lone "�" marks bytes; U+FFFD',
    "plain &amp; ascii &eacute;",
    "m² km² 10³",
]


@pytest.mark.parametrize("text", GOOD)
def test_correct_text_is_no_case(text):
    assert repair_text(text) == (text, 0, "")


ORIGINALS = [
    ("Si la línea está vacía, el código cierra 891 veces.", "utf-8", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251"]),
    ("Danach löscht der Verzeichnis die große Übersicht.", "utf-8", ["cp1252", "latin-1", "cp437", "mac_roman"]),
    ("Файл закрывает ошибка и узел.", "utf-8", ["cp1251", "cp1252", "latin-1", "cp866"]),
    ("Ключ хранит очередь и каталог.", "cp1251", ["latin-1"]),
    ("Каталог читает буфер и курсор.", "koi8_r", ["cp1251"]),
    ("Jeśli źródło jest za duży, węzeł zwraca błąd.", "iso8859_2", ["latin-1"]),
    ("記録の更新を確認してから検査を行う。", "shift_jis", ["latin-1"]),
    ("如果压缩过大，则先失败再边界。", "gbk", ["latin-1"]),
]


@pytest.mark.parametrize(("text", "really", "read"), [(t, a, b) for t, a, bs in ORIGINALS for b in bs])
def test_wrong_decodings_come_back(text, really, read):
    raw = text.encode(really)
    try:
        bad = raw.decode(read)
    except UnicodeDecodeError:  # undefined bytes pass as controls
        bad = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw)
    assert repair_text(f"x {bad}\nplain")[0] == f"x {text}\nplain"


@pytest.mark.parametrize("times", range(2, 8))
def test_repeated_wrong_decodings(times):
    text = bad = "Si la configuración está vacía."
    for _ in range(times):
        bad = bad.encode().decode("latin-1")
    assert repair_text(bad)[0] == text


@pytest.mark.parametrize(("text", "really", "read"), [("Si la configuración está vacía, señor.", "cp437", "cp1252"), ("Si la configuración está vacía, señor.", "cp1252", "cp437"), ("Файл закрывает ошибка и узел.", "iso8859_5", "latin-1"), ("Файл закрывает ошибка и узел.", "iso8859_5", "cp1251"), ("Файл закрывает ошибка и узел.", "cp1251", "koi8_r"), ("記録の更新を確認", "utf-8", "gb18030")])
def test_pairs_of_legacy_pages(text, really, read):
    try:
        bad = text.encode(really).decode(read)
    except UnicodeDecodeError:
        pytest.skip("undefined bytes")
    assert repair_text(f"x {bad} y")[0] == f"x {text} y"


def test_letters_are_preferred_to_signs():
    text = "// Буфер хранит проверка и ошибка."
    assert repair_text(text.encode("koi8_r").decode("cp1251"))[0] == text


def test_hopeless_lines_take_bounded_time():
    import random
    import time

    rnd = random.Random(5)
    line = " ".join("".join(rnd.choice("aéöñжш漢") for _ in range(8)) for _ in range(60))
    for _ in range(3):
        line = line.encode().decode("latin-1")
    began = time.time()
    repair_text("".join(c if rnd.random() > 0.05 else "\ufffd" for c in line))
    repair_text("".join(chr(rnd.randrange(0x80, 0x250)) for _ in range(3_000)))
    assert time.time() - began < 15


def test_damage_that_nothing_undoes_is_reported_and_kept():
    bad = "ÃƒxÃ¢y Â¬Ã½ÂzÐ¿ÑÑÂ Ã±Ãç"
    new, n, _ = repair_text(f"ok\n{bad}\nok")
    assert n == 1 and new.split("\n")[::2] == ["ok", "ok"]


def test_lost_marks_are_found_but_kept():
    assert repair_text("don�t trust")[:2] == ("don�t trust", 1)


def test_only_the_bad_line_changes():
    bad = "línea".encode().decode("cp1252")
    assert repair_text(f"été\r\n{bad} ok\r\n")[0] == "été\r\nlínea ok\r\n"


def test_tables(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "línea".encode().decode("cp1252"), 3), (3, "línea".encode().decode("cp1252"), 4), (4, "línea", 5), (5, "é " * 200_000, 6)]
    df = spark.createDataFrame(rows, "id int, text string, restored int")
    assert [r["id"] for r in found_ids(df).collect()] == [3]
    assert [(r["id"], r["restored"]) for r in repair(df).collect()] == [(3, "línea")] * 2
    assert found_ids(df.where("false")).count() == 0
