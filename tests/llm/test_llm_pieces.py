import random

import pytest
from pyspark.sql import functions as F

from matchloom.llm import pieces as P

SCHEMA = "id long, text string, piece_no string, __item string"


def _text(rng, n):
    out = []
    while sum(map(len, out)) < n:
        out.append(rng.choice(["word", "a", "longer-word", "句子", "x" * rng.choice([5, 90]), "Ende."]) + rng.choice([" ", "\n", ". ", "。", ", ", "、", "  ", "\n\n", ""]))
    return "".join(out)


def test_pieces_make_up_the_text_and_keep_the_limit():
    rng = random.Random(4)
    for _ in range(300):
        limit = rng.choice([40, 100, 600])
        overlap = rng.choice([0, 5, limit // 10])
        text = _text(rng, rng.choice([1, limit, limit + 1, 5 * limit]))
        got = P.cut(text, limit, overlap)
        assert all(0 < b - a <= limit for a, b, _, _ in got)
        assert "".join(text[a + o : b] for a, b, o, _ in got) == text
        assert all(o <= overlap for _, _, o, _ in got) and got[0][2] == 0
        longest = max((len(s) for s in P._BOUNDARY.split(text)), default=0)
        assert any(h for *_, h in got) == (longest > limit and len(text) > limit)
        for a, b, _, hard in got[:-1]:
            assert hard or P._BOUNDARY.match(text[b - 1])


def test_strong_boundaries_are_kept():
    text = "First sentence here is long enough. Second one, with a comma, is here as well. Third."
    got = [text[a:b].strip() for a, b, _, _ in P.cut(text, 50, 0)]
    assert got == ["First sentence here is long enough.", "Second one, with a comma, is here as well. Third."]


def test_operator(spark):
    rows = [(1, "a b " * 200), (1, "a b " * 200), (2, "x" * 700), (3, None), (4, ""), (5, "short"), (None, "y " * 400), (6, "é" * 600), (7, "，" * 650), (8, "word " * 40000)]
    df = spark.createDataFrame([(i, t, "p", "q") for i, t in rows], SCHEMA)
    got = P.split_oversized(df, "id", "text", 600, 60).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {1, 2, 7, 8}
    texts = dict(r for r in rows if r[0])
    for i, rs in by.items():
        rs.sort(key=lambda r: r["piece_no"])
        assert "".join(r["text"][r["overlap"] :] for r in rs) == texts[i]
        assert all(len(r["text"]) == r["end_char"] - r["start_char"] + 1 <= 600 for r in rs)
    kinds = {r["id"]: r["cut_kind"] for r in P.cut_kinds(df, "id", "text", 600).collect()}
    assert kinds == {1: "soft", 2: "hard", 7: "soft", 8: "soft"}
    assert P.cut_kinds(spark.createDataFrame([], SCHEMA), "id", "text").count() == 0
    with pytest.raises(ValueError):
        P.split_oversized(df, "id", "text", 10, 6)


def test_lines_of_a_piece():
    cut = [(0, 8, 0, False), (5, 12, 3, False), (12, 13, 0, False)]
    assert [p["lines"] for p in P.covered("x" * 13, cut, [3, 4, 7], [5, 2, 4])] == [[3, 4], [4, 7], [7]]
    assert [p["lines"] for p in P.covered("x" * 11, [(0, 5, 0, False), (5, 11, 0, False)], [3, 4, 7], [5, 2, 4])] == [[3], [4, 7]]
    assert [p["lines"] for p in P.covered("x" * 20, [(0, 20, 0, False)], [3, 4], [5, 2])] == [None]
    assert [p["lines"] for p in P.covered("x" * 20, [(0, 20, 0, False)], None, None)] == [None]


def test_pieces_with_their_lines(spark):
    lines = ["a" * 30 + " end.", "b " * 300 + "b", " c " * 5]
    text = " ".join(x.strip() for x in lines)
    blocks = [(1, "d", text, [3, 1, 2, 2, None]), (2, "d", "y " * 400, [1, 9]), (3, None, "z " * 400, None), (4, "d", "short", [1])]
    df = spark.createDataFrame(blocks, "id long, doc string, text string, src array<int>")
    known = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(lines)] + [("d", 1, lines[0]), ("d", 2, None), (None, 3, "x")], "doc string, no int, text string")
    got = {}
    for r in P.split_with_lines(df, "id", "text", "doc", "src", known, "doc", "no", "text", 200, 20).orderBy("id", "piece_no").collect():
        got.setdefault(r["id"], []).append(r)
    assert set(got) == {1, 2, 3}
    assert "".join(r["text"][r["overlap"] :] for r in got[1]) == text and all(r["lines_exact"] for r in got[1])
    for r in got[1]:
        at, want = 0, []
        for i, t in enumerate(lines):
            if at < r["end_char"] and at + len(t.strip()) >= r["start_char"]:
                want.append(i + 1)
            at += len(t.strip()) + 1
        assert r["source_lines"] == want
    assert all(r["source_lines"] == [1, 9] and not r["lines_exact"] for r in got[2]) and all(r["source_lines"] is None for r in got[3])


def test_a_boundary_is_as_strong_however_long_its_gap():
    assert [s for *_, s in P.segments("End." + " " * 40 + "next word", 600)] == [4.0, 1.0, 1.0]


def test_a_very_long_text_is_cut_in_a_moment(spark):
    df = spark.createDataFrame([(1, "some words, in a row. " * 200_000, "p", "q")], SCHEMA)
    assert P.split_oversized(df, "id", "text").agg(F.count("*"), F.max(F.char_length("text"))).first()[1] <= 600
