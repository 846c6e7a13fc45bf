"""The folds over a document's sentences against independent, slower readings of the same rules."""

import random

from matchloom import dims
from matchloom.config import Config
from matchloom.operators import blocks as B
from matchloom.operators import segment, sections
from matchloom.plans import pipeline


def _spec_pack(rows, breaks, limit, gap):
    """The same rules, told as: for every sentence, does it begin a block?"""
    out, words = [], 0
    for i, (text, lines) in enumerate(rows):
        n = len(text.split())
        topic = i > 0 and (any(x in breaks for x in lines) or min(lines) - max(rows[i - 1][1]) > gap)
        if not out or topic or words + n > limit:
            out.append([[], True if not out else topic])
            words = 0
        parts = [text] if n <= limit else B.oversized(text, limit)
        for p in parts:
            m = len(p.split())
            if n > limit and out[-1][0] and words + m > limit:
                out.append([[], False])
                words = 0
            out[-1][0].append(p)
            words += m
    return [(a, b) for a, b in out]


def test_packing_follows_the_rules():
    rng = random.Random(5)
    for _ in range(300):
        rows, line = [], 1
        for _ in range(rng.randint(0, 12)):
            line += rng.choice([0, 1, 1, 2, 3, 4])
            words = ["w"] * rng.choice([1, 3, 10, 20, 39, 40, 41, 90])
            if len(words) > 40 and rng.random() < 0.7:
                words[20] += rng.choice([",", ";"])
            rows.append((" ".join(words), [line]))
        breaks = {rng.randint(1, line) for _ in range(2)}
        got = [([t for t, _ in items], lead) for items, lead in B.pack(rows, breaks, 40, 2)]
        assert got == _spec_pack(rows, breaks, 40, 2)
        assert all(sum(len(t.split()) for t in ts) <= 40 or len(ts) == 1 for ts, _ in got)


def test_short_blocks_merge_once_and_never_over_a_heading():
    b = lambda t, n: ([(t, (n,))], False)
    got = B.merge_short([b("short", 1), b("next", 2), b("tail", 3)], set(), 40, 20)
    assert [[t for t, _ in items] for items, _ in got] == [["short", "next"], ["tail"]]
    got = B.merge_short([b("short", 1), b("next", 2)], {2}, 40, 20)
    assert len(got) == 2


def test_oversized_cuts_at_the_first_delimiter_that_helps():
    assert B.oversized("a; b, and c", 1) == ["a", "b, and c"]
    assert B.oversized("a, and b, c", 1) == ["a", "and b, c"]
    assert B.oversized("a, b, c", 1) == ["a", "b", "c"]
    assert B.oversized("a b c", 2) == ["a b", "c"]


def test_inference():
    lists = [i for i, (s, r, _) in enumerate(dims.SIGNALS) if r == "list of items"]
    got = B.infer(["skills", "unknown"], [[], lists], [0.2, 0.3], 0.5)
    assert got[1][0] == "skills" and abs(got[1][2] - 0.8) < 1e-9
    degree = [i for i, (s, r, _) in enumerate(dims.SIGNALS) if r == "degrees"]
    assert B.infer(["unknown"], [degree], [0.8], 0.3)[0][:2] == ("education", "education")
    assert B.infer(["unknown"], [[]], [0.5], 0.5)[0] == ("unknown", "unknown", 0.0, True, False, "No signals matched for section inference", [])
    # an earlier inference is seen, the next block's section as it came in is seen only if nothing came before
    assert [x[0] for x in B.infer(["skills", "unknown", "unknown"], [[], lists, lists], [0.2, 0.2, 0.2], 0.5)] == ["skills"] * 3
    assert B.infer(["other"], [degree], [0.1], 0.5)[0] == ("education", None, None, False, True, None, None)


def test_a_document_from_end_to_end(spark):
    text = "SKILLS\n• Python, Java, SQL\n• Docker\n\nWORK EXPERIENCE\nDeveloper at Acme since 2019. Built things and led a team.\n\nPage 1 of 2\n"
    docs = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "doc_id string, text string")
    out = pipeline.processed(docs, Config())
    blocks = {r["block_no"]: r for r in out["blocks"].collect()}
    assert {r["doc_id"] for r in blocks.values()} == {"a"}
    assert "skills" in {r["section"] for r in blocks.values()} and "experience" in {r["section"] for r in blocks.values()}
    assert all(r["source_lines"] == sorted(set(r["source_lines"])) and 0 <= r["position"] <= 1 for r in blocks.values())
    assert not any("Page 1" in r["text"] for r in blocks.values())
    heads = {r["heading_text"]: r["section"] for r in out["headings"].collect()}
    assert heads == {"SKILLS": "skills", "WORK EXPERIENCE": "experience"}


def test_headings(spark):
    rows = ["Education", "EDUCATION:", "Skills & Expertise", "CGPA: 8.5", "SOME OTHER THING", "Odd stuff:", "x" * 81, "", None]
    lines = spark.createDataFrame([("d", i, t, not t) for i, t in enumerate(rows, 1)], "doc_id string, line_no int, text string, is_empty boolean")
    got = {r["line_no"]: (r["section"], round(r["confidence"], 2)) for r in sections.detect_headings(lines).collect()}
    assert got == {1: ("education", 0.95), 2: ("education", 0.9), 3: ("skills", 0.95), 5: ("other", 0.6), 6: ("other", 0.55)}


def test_missing_lines(spark):
    lines = spark.createDataFrame([("a", 2), ("a", 2), ("a", 5), ("b", 1)], "doc_id string, line_no int")
    assert sorted(r["line_no"] for r in segment.missing_lines(lines).collect()) == [1, 3, 4]
