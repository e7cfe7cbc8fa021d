from __future__ import annotations

import pytest

from folio.llm.chunking import found_ids, pieces

TEXTS = {
    "paragraphs": "One sentence. Another one.\n\n" * 400,
    "lines": "x" * 50 + "\n" + "y" * 7000,
    "wide": "漢字かな交じり文。" * 600,
    "emoji": "👩‍🔬🏳️‍🌈é" * 400,
    "solid": "z" * 9000,
    "crlf": "a b c\r\n\r\n" * 900,
    "mixed": "é" * 1023 + "x" + "漢" * 2000,
}


@pytest.mark.parametrize(("limit", "overlap"), [(1000, 50), (1024, 0), (997, 333)])
def test_pieces_cover_the_text(spark, limit, overlap):
    df = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    rows: dict[str, list] = {}
    for r in pieces(df, limit=limit, overlap=overlap).orderBy("id", "piece_no").collect():
        rows.setdefault(r["id"], []).append(r)
    for name, text in TEXTS.items():
        raw, own = text.encode(), rows[name]
        assert [r["piece_no"] for r in own] == list(range(1, own[0]["n_pieces"] + 1))
        at = 0
        for k, r in enumerate(own):
            body = r["piece"].encode()
            assert "�" not in r["piece"] and len(body) == r["n_bytes"] <= limit
            assert raw[r["byte_start"] : r["byte_start"] + len(body)] == body
            assert r["byte_start"] + r["overlap_bytes"] == at
            if k:
                want = min(overlap, at)
                while raw[at - want] & 0xC0 == 0x80:
                    want -= 1
                assert r["overlap_bytes"] == want
            at = r["byte_start"] + len(body)
        assert at == len(raw)


def test_boundaries_are_natural(spark):
    df = spark.createDataFrame([("p", TEXTS["paragraphs"])], "id string, text string")
    own = pieces(df, limit=1000, overlap=20).orderBy("piece_no").collect()
    assert all(r["piece"].endswith("\n\n") for r in own)


def test_edges(spark):
    df = spark.createDataFrame([("n", None, 1), ("e", "", 2), ("exact", "é" * 51_200, 3), ("over", "é" * 51_200 + "x", 4), ("over", "é" * 51_200 + "x", 5)], "id string, text string, piece int")
    assert [r["id"] for r in found_ids(df).collect()] == ["over"]
    assert sorted((r["id"], r["n_pieces"]) for r in pieces(df).where("piece_no = 1").collect()) == [("exact", 1), ("over", 2), ("over", 2)]
    assert pieces(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        pieces(df, limit=100, overlap=100)
