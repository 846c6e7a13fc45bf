import pytest

from matchloom.llm import pii as P


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail a.b+c@x-y.example, ok", [("a.b+c@x-y.example", "email")]), ("write to me (at) inbox (dot) test now", [("me (at) inbox (dot) test", "email")]), ("me＠inbox.test", [("me＠inbox.test", "email")]),
        ("Tel. (415) 555-0180", [("(415) 555-0180", "phone")]), ("call 1-307-555-0164 ext. 606 today", [("1-307-555-0164 ext. 606", "phone")]), ("Mobil +49 (0)30 23125 924", [("+49 (0)30 23125 924", "phone")]),
        ("携帯 ０９０（００００）０８０９", [("０９０（００００）０８０９", "phone")]), ("هاتف: ٠٥٠-٠٠٠٠١٨٢", [("٠٥٠-٠٠٠٠١٨٢", "phone")]),
        ("SSN 912-34-5678", [("912-34-5678", "id_number")]), ("Passport No. X99381707", [("X99381707", "id_number")]), ("DNI 99548067L", [("99548067L", "id_number")]), ("Steuer-ID: 00 654 747 970", [("00 654 747 970", "id_number")]),
        ("24B Heron Street, Apt. 21, Silverhithe", [("24B Heron Street, Apt. 21, Silverhithe", "address")]), ("Am Torfstich 93a, 00883 Puerto Almendro.", [("Am Torfstich 93a, 00883 Puerto Almendro", "address")]),
        ("12, rue des Tanneurs", [("12, rue des Tanneurs", "address")]), ("Calle Olmo 12, 00194 Hollinsford", [("Calle Olmo 12, 00194 Hollinsford", "address")]), ("住所：霧野県鳴瀬市東篝町5丁目22番13号", [("霧野県鳴瀬市東篝町5丁目22番13号", "address")]),
        ("请联系欧阳屿白，电话19900000826。", [("欧阳屿白", "name"), ("19900000826", "phone")]),
        ("Ticket no. 4471-22-36, version 2.29.1 of 12.03.2007, host 192.0.2.30, 1.250.000,50 euros, 2010 - 2015", []), ("Im Januar 2004 kam ich", []), ("", []),
    ],
)
def test_spans(text, want):
    got = P.find(text)[0]
    assert sorted((text[a:b], k) for a, b, k in got) == sorted(want)


def test_validators():
    assert P.luhn("4539578763621486") and not P.luhn("4539578763621487")
    assert P.nir_key("255081416802538") and not P.nir_key("255081416802539")
    assert P.dni_letter("12345678Z") and not P.dni_letter("12345678A")
    assert P.cn_check("11010519491231002X") and not P.cn_check("110105194912310021")
    assert P.steuer_check("86095742719") and not P.steuer_check("86095742710")
    assert P.thai_check("1101700203450") == (P.thai_check("1101700203450"))


SCHEMA = "src string, row_key string, text string, start int, pii_kind string"
ROWS = [
    ("l", "1", "Name: Mara Quill"), ("l", "2", "Jo van der Molt, Acme Labs, +1 415 555 0100"), ("l", "3", "Later MARA VAN DER MOLT wrote it, with Spring Boot and M. Quill."), ("l", "4", "Quill, Mara"), ("l", "5", None), ("l", "6", ""),
    ("l", "7", "We met at Heron Street Studios."), ("l", "3", "Later MARA VAN DER MOLT wrote it, with Spring Boot and M. Quill."), (None, "8", "Name: Ann Lee"), ("l", None, "Name: Ann Lee"), ("l", "9", "Dr. Mara Quill " * 3000),
]


def test_names_are_learnt_from_contexts_and_found_elsewhere(spark):
    df = spark.createDataFrame([(*r, 0, "") for r in ROWS], SCHEMA)
    got = {}
    for r in P.personal_spans(df).collect():
        got.setdefault(r["row_key"], []).append((r["start_char"], r["end_char"], r["pii_kind"]))
    text = {k: t for _, k, t in ROWS}
    names = {k: sorted(text[k][a - 1 : b] for a, b, kind in v if kind == "name") for k, v in got.items()}
    assert names["1"] == ["Mara Quill"] and names["2"] == ["Jo van der Molt"] and names["4"] == ["Quill, Mara"]
    assert names["3"] == ["M. Quill", "MARA VAN DER MOLT"] and len(names["9"]) == 3000
    assert set(got) == {"1", "2", "3", "4", "9"}
    clean = {r["row_key"]: (r["text"], r["items"]) for r in P.redacted(df.filter("row_key is not null and src is not null and row_key <> '9'")).collect()}
    assert clean["2"] == ("[NAME], Acme Labs, [PHONE]", 2) and clean["5"] == (None, 0) and clean["7"] == (text["7"], 0)
    assert P.personal_spans(df.limit(0)).count() == 0


POISON = [
    ("l", f"p{i}", t) for i, t in enumerate(["Power BI, Airflow, BigQuery, Spark", "Spring Boot, GitLab CI, Jenkins", "Kafka | Power BI | Hive", "M.A. Logistics, Univ. Silverhithe, 2018, 8.7/10.0", "We moved from Qt to Power BI with Spring Boot."] * 20)
] + [("l", "q0", "Power BI | +1 415 555 0100")]


def test_strings_of_items_teach_no_names(spark):
    rows = [*POISON, ("l", "1", "Name: Mara Quill"), ("l", "2", "Mara Quill, Acme Labs, mara@acme.test"), ("l", "3", "Later Mara Quill wrote it.")]
    got = P.personal_spans(spark.createDataFrame(rows, "src string, row_key string, text string")).filter("pii_kind = 'name'").collect()
    assert sorted((r["row_key"], r["start_char"], r["end_char"]) for r in got) == [("1", 7, 16), ("2", 1, 10), ("3", 7, 16)]


def _names(text, given, family):
    out = []
    for a, b, _ in P.find(text)[1]:
        out += [text[a + x : a + y] for x, y in P.resolve(text[a:b], set(given.split()), set(family.split()))]
    return sorted(set(out))


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("my colleague Quill, Mara (m@x.test) will", ["Quill, Mara"]), ("Ask for Ms. Quill, Mara-Jo at the desk", ["Quill, Mara-Jo"]), ("done. de la Quill, Mara a écrit", ["de la Quill, Mara"]), ("Pregunte por D. Quill, Mara en", ["Quill, Mara"]),
        ("D. Quill, Acme Labs", ["D. Quill"]), ("Contact : M. Mara Quill, tél.", ["Mara Quill"]), ("M. Quill, Acme", ["M. Quill"]), ("Contact : M. J. Quill", ["J. Quill"]), ("Jo Quill, Mara Quill", ["Jo Quill", "Mara Quill"]), ("QUILL, MARA J. | x", ["QUILL, MARA J."]),
        ("Mara Quill Mail QUILL-M1@X.TEST", ["Mara Quill"]), ("Quill Clinic, Mara", []), ("Jo J. Quill, Mara", ["Jo J. Quill"]),
    ],
)
def test_forms_of_names(text, names):
    assert _names(text, "mara jo", "quill") == names


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("I lived at 12 Heron Court. Then", "12 Heron Court"), ("I lived at 12 Heron Ave. Then", "12 Heron Ave"), ("I lived at 12 Old Mill Rd..", "12 Old Mill Rd."), ("12 Old Mill Rd., Bellmoor", "12 Old Mill Rd., Bellmoor"), ("a@b.test 12 Old Mill Rd.", "12 Old Mill Rd."),
        ("Anschrift: Kupferstr. 8 Steuer-ID: x", "Kupferstr. 8"), ("Kupferstr. 8 a, Bellmoor", "Kupferstr. 8 a, Bellmoor"),
    ],
)
def test_ends_of_addresses(text, want):
    assert [text[a:b] for a, b, k in P.find(text)[0] if k == "address"] == [want]


def test_numbers_are_not_cut_by_a_neighbour():
    text = "+86 199 0000 0731 身份证：990101197606175116"
    assert [text[a:b] for a, b, _ in sorted(P.find(text)[0])] == ["+86 199 0000 0731", "990101197606175116"]
    assert [k for _, _, k in P.find("SIN 046 454 286")[0]] == ["id_number"] and P.find("Batch 130 692 544")[0] == []
    assert [k for _, _, k in P.find("Personnummer 811228-9874")[0]] == ["id_number"]


@pytest.mark.parametrize(
    ("text", "value"),
    [("欧阳屿白，手机", "欧阳屿白"), ("移しました。葛城野紬乃", "葛城野紬乃"), ("葛城野紬乃でした。Montvire", "葛城野紬乃"), ("نوران الكرمونتي. بدأت", "نوران الكرمونتي"), ("कहा। कबीर सूर्यकोटी", "कबीर सूर्यकोटी"), ("欧阳屿白", "欧阳屿白")],
)
def test_names_at_the_edges_of_wrapped_lines_are_looked_up(text, value):
    assert value in [text[a:b] for a, b, _ in P.find(text)[1]]


def test_redaction():
    assert P.redact("abc def", [(5, 7, "name"), (1, 3, "email")]) == "[EMAIL] [NAME]"
    assert P.redact("abcdef", [(1, 4, "phone"), (3, 5, "name")]) == "[PHONE]ef"
    assert P.redact(None, []) is None


def _examples(tree):
    """Strings that between them use every alternative and every end of every character class of a parsed pattern."""
    parts = []
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(arg)])
        elif op == "IN":
            kinds = {"CATEGORY_DIGIT": "7", "CATEGORY_WORD": "x", "CATEGORY_SPACE": " "}
            parts.append([c for o, a in arg for c in ([chr(a)] if str(o) == "LITERAL" else [chr(a[0]), chr(a[1])] if str(o) == "RANGE" else [kinds[str(a)]])])
        elif op == "BRANCH":
            parts.append([x for b in arg[1] for x in _examples(b)])
        elif op == "SUBPATTERN":
            parts.append(_examples(arg[3]))
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, item = arg
            parts.append([x * max(low, 1) for x in _examples(item)] + ([""] if low == 0 else []))
        else:
            assert op in ("AT", "ASSERT", "ASSERT_NOT"), op
    # each with all optional parts around it, and with none
    return ["".join([*base[:i], v, *base[i + 1 :]]) for base in ([p[0] for p in parts], [p[-1] for p in parts]) for i, p in enumerate(parts) for v in p] or [""]


def test_what_an_address_pattern_takes_its_filter_lets_through():
    import re

    for k, p in enumerate(P._STREETS):
        texts = [x for x in dict.fromkeys(_examples(re._parser.parse(p))) if P._ADDRESSES[k].search(x)]
        assert texts and [x for x in texts if k not in P._countries(x)] == []
    for text in ("12 avenue Victor Hugo, 75001 Paris", "12 Élan Street", "GARTENSTRAßE 5", "Am Élan 5"):
        assert [k for _, _, k in P.find(text)[0]] == ["address"]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("请联系欧阳屿白。 คุณสมชาย ใจดีมาก", ["欧阳屿白", "สมชาย ใจดีมาก"]), ("我们的团队负责系统。 श्री कबीर सूर्यकोटी", ["कबीर सूर्यकोटी"]), ("我们的团队负责系统。 السيد ريان الزهرابيل", ["ريان الزهرابيل"]),
        ("ทีมงาน 请联系欧阳屿白。", ["欧阳屿白"]), ("السيد ريان الزهرابيل, श्री कबीर सूर्यकोटी", ["कबीर सूर्यकोटी", "ريان الزهرابيل"]),
    ],
)
def test_names_of_every_script_of_a_text(text, names):
    assert sorted(text[a:b] for a, b, k in P.find(text)[0] if k == "name") == sorted(names)
