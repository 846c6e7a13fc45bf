import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as X


@pytest.fixture(scope="module")
def ask(spark):
    def run(build, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
        return [r[0] for r in df.orderBy("i").select(build(F.col("c"))).collect()]

    return run


def test_cleaning(ask):
    got = ask(X.cleaned, "ﬁnance", "Hello\x00World\x07Test", "  Hello   World  ", "a\tb", None, "cafÃ©", "　x\xa0")
    assert got == ["finance", "HelloWorldTest", "Hello World", "a b", "", "café", "x"]


def test_page_marks(ask):
    marks = ["Page 1 of 5", "page 3 of 10", "- 2 -", "3/10", "[5]", "42"]
    assert ask(X.is_artifact, *marks) == [True] * 6
    assert ask(X.is_artifact, "Python 3.10", "Experience: 5+ years", "12345", "", None) == [False] * 5


def test_normalisation_keeps_protected_tokens(ask):
    got = ask(X.normalised, "* item", "A. Smith", "“x” – y", "3. years ago", "-a.b@c.io", "see https://x.org/a–b – now", "C++ and C#, .NET, node.js", "", None)
    assert got == ["• item", "• Smith", '"x" - y', "3. years ago", "-a.b@c.io", "see https://x.org/a–b - now", "C++ and C#, .NET, node.js", "", None]


@pytest.mark.parametrize("text", ["GPA 3.8/4.0", "Python 3.10", "CI/CD, TCP/IP, PL/SQL", "ISO 27001", "+1 415-555-0100", "a@b.co", "v2.1", "0.75"])
def test_technical_terms_survive(text, ask):
    assert ask(X.normalised, text) == [text]


def test_sentences(ask):
    got = ask(X.sentences, "One is here. Two is there! Three?", "Uses Node.js. It works", "E.g. This one. Next", "See 3.8/4.0 GPA. Done", "Wait... What", "")
    assert got == [["One is here.", "Two is there!", "Three?"], ["Uses Node.js.", "It works"], ["E.g. This one.", "Next"], ["See 3.8/4.0 GPA.", "Done"], ["Wait... What"], []]


def test_a_protected_word_hides_the_boundary_before_it(ask):
    assert ask(X.sentences, "Great. Dr. Smith left") == [["Great. Dr. Smith left"]]


def test_shapes(ask):
    assert ask(X.is_heading_shape, "WORK EXPERIENCE", "Skills:", "Key Projects", "This is a sentence.", "Nice to Have", "ÜBER UNS", "Year 2020", "") == [True, True, True, False, False, True, False, False]
    assert ask(X.is_list_item, "• x", "1. x", "a) x", "iv. x", "-", "text") == [True, True, True, True, False, False]


def test_terms_and_words(ask):
    assert ask(X.terms, "C++ and C# with Python, python a") == [["c#", "c++", "python"]]
    assert ask(X.word_count, " a  b　c ", "") == [3, 0]


def test_embedding_text_has_no_word_boundary(ask):
    assert ask(X.embedding_text, "Experienced engineer", "Skills: Java", "skills") == ["d engineer", "Java", "skills"]


def test_years(ask):
    assert ask(X.candidate_years, "5+ years of experience", "2010-2015", "2019 to present", "none") == [5, 5, 7, 1]
    assert ask(X.required_years, "at least 3 years", "no") == [3, 0]


def test_file_names(ask):
    assert ask(X.sanitised_name, "../../etc/pass wd.pdf", "a\x00b.docx", "__.pdf", "x//y\\z.PDF", "über uns.pdf") == ["etc_pass_wd.pdf", "ab.docx", "unnamed.pdf", "x_y_z.PDF", "über_uns.pdf"]


def test_mandatory(ask):
    assert ask(X.is_mandatory, "You must have a car", "at  least 3", "mustard", "non-negotiable", "nice") == [True, True, False, True, False]
