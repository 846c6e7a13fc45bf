import pytest

from matchloom.llm import sentences as S


def cut(*lines, item=False):
    text = list(lines)
    out, at = [], (0, 0)
    for a, ac, b, bc in S.run_ends(text, item):
        out.append("\n".join([text[a][ac:], *text[a + 1 : b], text[b][: bc + 1]]) if a != b else text[a][ac : bc + 1])
        at = (b, bc + 1)
    rest = "\n".join([text[at[0]][at[1] :], *text[at[0] + 1 :]]).strip()
    return out, rest


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It works. We ship!", ["It works.", "We ship!"]),
        ("Ask Dr. Lee or Ms. Ray, e.g. by mail. Then wait.", ["Ask Dr. Lee or Ms. Ray, e.g. by mail.", "Then wait."]),
        ("It cost 3.50 at 5 p.m. sharp. Fine.", ["It cost 3.50 at 5 p.m. sharp.", "Fine."]),
        ('She said, "Can we go? It is late." and left. Done.', ['She said, "Can we go? It is late." and left.', "Done."]),
        ('"All is well." He slept.', ['"All is well."', "He slept."]),
        ("(This is a note.) Next one.", ["(This is a note.)", "Next one."]),
        ("Then came it ... and nobody knew. Wait… What?", ["Then came it ... and nobody knew.", "Wait…", "What?"]),
        ("I left Acme Inc. In May I was back.", ["I left Acme Inc.", "In May I was back."]),
        ("At Acme Inc. I built it.", ["At Acme Inc. I built it."]),
        ("It ran.Then it stopped. See node.js and ASP.NET docs.", ["It ran.", "Then it stopped.", "See node.js and ASP.NET docs."]),
        ("Done. npm packages came. iOS too.", ["Done.", "npm packages came.", "iOS too."]),
        ("Am 3. Mai kam Dr. Weiß, d. h. spät. Gut.", ["Am 3. Mai kam Dr. Weiß, d. h. spät.", "Gut."]),
        ("„Geht das? Ja.“ war die Frage. Ende.", ["„Geht das? Ja.“ war die Frage.", "Ende."]),
        ("« Oui. Non. » a dit M. Petit. Fin.", ["« Oui. Non. » a dit M. Petit.", "Fin."]),
        ("¿Qué tal? El Sr. Paz (v. pág. 3). Bien.", ["¿Qué tal?", "El Sr. Paz (v. pág. 3).", "Bien."]),
        ("他说「先测。再动。」就走了。好！", ["他说「先测。再动。」就走了。", "好！"]),
        ("上司は「金曜に出す。」と言いました。本当？", ["上司は「金曜に出す。」と言いました。", "本当？"]),
        ("यह ठीक है। क्या? डॉ. राय आए।", ["यह ठीक है।", "क्या?", "डॉ. राय आए।"]),
        ("هل هذا صحيح؟ نعم. في شركة Acme Corp. عملت.", ["هل هذا صحيح؟", "نعم.", "في شركة Acme Corp. عملت."]),
        ("ผมดูแลระบบและย้ายงานจนเสร็จสิ้น คุณจะทำงานกับเพื่อน 12 คนในทีมนี้", ["ผมดูแลระบบและย้ายงานจนเสร็จสิ้น", "คุณจะทำงานกับเพื่อน 12 คนในทีมนี้"]),
        ("ALL IS WELL. NOBODY KNEW DR. LEE.", ["ALL IS WELL.", "NOBODY KNEW DR. LEE."]),
        ('An "unclosed quotation. It goes on. Yes.', ['An "unclosed quotation.', "It goes on.", "Yes."]),
    ],
)
def test_sentences(text, want):
    assert cut(text)[0] == want


def test_wrapped_lines_and_fragments():
    assert cut("One is", "here. Two", "is there") == (["One is\nhere."], "Two\nis there")
    assert cut("Address: 11 Old Mill Rd.") == ([], "Address: 11 Old Mill Rd.")
    assert cut("Python, Java") == ([], "Python, Java")
    assert cut("1. It works. Yes.", item=True)[0] == ["It works.", "Yes."]


SCHEMA = "doc_id string, line_no int, text string, end_char string"


def test_operator(spark):
    rows = [
        ("a", 1, "WORK", ""), ("a", 2, "It is", ""), ("a", 3, "done. Now", ""), ("a", 3, "done. Now", ""), ("a", 5, "lost. Yes!", ""), ("a", 6, None, ""), ("a", 7, "- One. Two.", ""), ("a", 8, "dev | Acme Inc. | 2010", ""),
        ("a", 9, "", ""), ("b", 1, "x " * 5000 + "end.", ""), (None, 1, "No doc.", ""), ("b", None, "No line.", ""), ("c", 1, None, ""), ("c", 2, "   ", ""), ("a", 10, "1/2", ""),
    ]
    lines = spark.createDataFrame(rows, SCHEMA).repartition(4)
    heads = spark.createDataFrame([("a", 1), ("a", 1)], "doc_id string, line_no int")
    got = sorted((r["doc_id"], r["line_no"], r["end_char"]) for r in S.sentence_ends(lines, headings=heads).collect())
    assert got == [("a", 3, 5), ("a", 5, 5), ("a", 5, 10), ("a", 7, 6), ("a", 7, 11), ("b", 1, 10004)]
    text = {(r["line_no"], r["end_char"]): (r["start_line"], r["text"], r["list_level"]) for r in S.sentences(lines.filter("doc_id = 'a'"), headings=heads).collect()}
    assert text[(3, 5)] == (2, "It is done.", 0) and text[(7, 6)] == (7, "One.", 1)
    assert S.sentence_ends(lines.limit(0)).count() == 0


def test_the_trie_finds_whole_abbreviations_only():
    assert S.abbreviation_before("see Dr.", 6) == "dr"
    assert S.abbreviation_before("the hydr.", 8) is None
    assert S.abbreviation_before("a Ph.D.", 6) == "ph.d"


def test_openers_that_are_never_closed():
    assert cut("(We go now. He said “yes to it. They left. It ends.") == (["(We go now.", "He said “yes to it.", "They left.", "It ends."], "")
    assert len(S.ends_of("We go (or “they stay. " * 20_000)) == 20_000  # in one second pass, not one for each


def test_words_of_any_length():
    for n in (10, 59, 60, 61, 5000):
        word = "x" * n
        assert cut(f"Read {word}@mail.Now or never. It ends.")[0][-1] == "It ends."
        assert cut(f"We read the {word}. Then it ends.") == ([f"We read the {word}.", "Then it ends."], "")
