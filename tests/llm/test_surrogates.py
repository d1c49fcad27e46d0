import re

from paperfold.llm import surrogates
from paperfold.llm.queries import QUERIES
from tests.llm.helpers import ODD, table, texts

PATTERNS = (r"[\w.+-]+@[\w-]+\.[\w.]*\w", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w)", r"\+1 \(\d+\) \d+-\d+")


def right(number):
    digits = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(re.sub(r"\D", "", number)))]
    return sum(d - 9 * (d > 9) for d in digits) % 10 == 0


def replaced(spark, texts_, key="k"):
    out = surrogates.replaced(table(spark, list(enumerate(texts_))), key).orderBy("doc_id").collect()
    return [r.text for r in out]


def test_types_and_coreference(spark):
    a, b, c, d, e = replaced(spark, [
        "Mail bob.Smith+1@Mail8.example.com or BOB.SMITH+1@MAIL8.EXAMPLE.COM.", "call +1 (344) 555-6605; +1 (344) 5556605", "cards 4398874246221956, 4398-8742-4622-1956 but not 4398874246221957",
        "ip 61.131.143.218, version 1.2.3, 300.1.1.1 and 1.2.3.4.5", "ssn 123-45-6789",
    ])
    one, two = re.findall(r"\S+@\S+\w", a)
    assert one.upper() == two and re.fullmatch(r"[a-z]{3}\.[a-z]{5}\+\d@[a-z]{4}\d\.[a-z]{7}\.com", one) and "smith" not in one
    assert re.fullmatch(r"call \+\d \(\d{3}\) \d{3}-\d{4}; \+\d \(\d{3}\) \d{7}", b) and "6605" not in b
    assert len(set(re.sub(r"\D", "", x) for x in b[5:].split(";"))) == 1
    x, y, z = re.findall(r"[\d-]{16,}", c)
    assert x == y.replace("-", "") and right(x) and x != "4398874246221956" and z == "4398874246221957"
    assert re.fullmatch(r"ip \d+(\.\d+){3}, version 1\.2\.3, 300\.1\.1\.1 and 1\.2\.3\.4\.5", d) and "61.131" not in d
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4}", e) and e != "ssn 123-45-6789"


def test_persons(spark):
    (a,) = replaced(spark, ["Mr. John Smith met Frau Anna Müller and Mr Smith, Dr. SMITH; Госпожа Анна Иванова"])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Frau (\w+) (\w+) and Mr (\w+), Dr\. (\w+); Госпожа (\w+) (\w+)", a)
    assert m[1] in surrogates.MALE_LATIN and m[3] in surrogates.FEMALE_LATIN and m[7] in surrogates.FEMALE_CYRILLIC
    assert m[2] == m[5] == m[6].capitalize() and re.fullmatch("[А-Я][а-я]+", m[8]) and m[2] != m[4]


def test_forms_of_names(spark):
    """Any number of names, initials, particles and titles, with any blanks, and nothing of them left."""
    out = replaced(spark, [
        "Mr. Jean Luc Pierre Martin and Mr. Martin", "Mr. John Q. Public met Mr Public", "Dr. J. Smith, Dr. J.R.R. Smith", "Herr Dr. Ludwig van der Berg\u00a0Hoff; Mr.Smith",
        "Mrs.  Anna\tMaria\nSmith", "Mr. Malcolm X told Mr. Smith I think", "Mr. " + "Abc " * 3000 + "end",
    ])
    m = re.fullmatch(r"Mr\. ([A-Z]\w+) ([A-Z]\w+) ([A-Z]\w+) ([A-Z]\w+) and Mr\. (\w+)", out[0])
    assert m[4] == m[5] and not {"Jean", "Luc", "Pierre", "Martin"} & set(m.groups())
    m = re.fullmatch(r"Mr\. (\w+) ([A-PR-Z])\. (\w+) met Mr (\w+)", out[1])
    assert m[3] == m[4] != "Public" and m[1] != "John"
    m = re.fullmatch(r"Dr\. ([A-IK-Z])\. (\w+), Dr\. [A-Z]\.[A-Z]\.[A-Z]\. (\w+)", out[2])
    smith = m[2]
    assert smith == m[3] != "Smith"
    m = re.fullmatch("Herr Dr\\. (\\w+) van der (\\w+)\u00a0(\\w+); Mr\\.(\\w+)", out[3])
    assert m[1] in surrogates.MALE_LATIN and m[2] != "Berg" and m[3] != "Hoff" and m[4] == smith
    m = re.fullmatch(r"Mrs\.  (\w+)\t(\w+)\n(\w+)", out[4])
    assert m[1] in surrogates.FEMALE_LATIN and m[2] != "Maria" and m[3] == smith
    assert re.fullmatch(rf"Mr\. \w+ (?!X)[A-Z] told Mr\. {smith} I think", out[5])
    assert "Abc" not in out[6] and out[6].endswith(" end") and len(out[6].split()) == 3002


def test_distinct_after_clashes(spark, monkeypatch):
    """With a drawing that gives few values, clashing units are drawn again until all differ."""
    texts_ = [f"Mr. Name{chr(97 + k)}x Surname{chr(97 + k)}y" for k in range(26)] + ["Mr. Anton Karl"]
    out = replaced(spark, texts_)
    again = {(r.kind, r.canon): r.attempt for r in surrogates.redrawn(table(spark, list(enumerate(texts_))), "k").collect()}
    assert sum(k == "given-m" for k, _ in again) >= 10  # 27 names, 16 values at first
    assert len(set(x.split()[1] for x in out)) == 27 and len(set(x.split()[2] for x in out)) == 27
    assert not {x.split()[1].lower() for x in out} & {x.split()[1].lower() for x in texts_}


def test_crowded_forms(spark, monkeypatch):
    """Forms with more than half of their values in the data still get surrogates that differ and are not in the data."""
    write, n = surrogates.table, []

    def counted(df, label):
        n.append(label)
        assert len(n) < 80, "drawn without end"
        return write(df, label)

    monkeypatch.setattr(surrogates, "table", counted)
    mails = [f"{chr(97 + k // 26)}@{chr(97 + k % 26)}.de" for k in range(450)]
    phones = [f"+1{k:04}" for k in range(6000)]
    out = " ".join(replaced(spark, [" ".join(mails)] + [" ; ".join(phones[k : k + 100]) for k in range(0, 6000, 100)]))
    for old, pattern in ((mails, r"[a-z]+@[a-z]\.de"), (phones, r"\+\d{5,}")):
        new = re.findall(pattern, out)
        assert len(new) == len(set(new)) == len(old) and not set(new) & set(old)


def test_keys_differ(spark):
    assert replaced(spark, ["a@b.org"], "k") == replaced(spark, ["a@b.org"], "k") != replaced(spark, ["a@b.org"], "l")


def test_whole_table(spark, folder):
    before = dict(texts(folder))
    mapped = {}
    for r in QUERIES["op6_surrogates"](spark, str(folder)).collect():
        found = [m for p in PATTERNS for m in re.findall(p, before[r.doc_id])]
        found += [m for m in re.findall(r"(?<!\w)[3-6]\d{15}(?!\w)", before[r.doc_id]) if right(m)]
        assert r.n_entities == len(found)
        assert not [m for m in found if m in r.text]
        new = [m for p in PATTERNS for m in re.findall(p, r.text)]
        for p in PATTERNS:
            old, new = re.findall(p, before[r.doc_id]), re.findall(p, r.text)
            assert len(old) == len(new)
            for a, b in zip(old, new, strict=True):
                assert mapped.setdefault(a, b) == b
        if not found:
            assert r.text == before[r.doc_id]
    assert len(mapped) == len(set(mapped.values())) > 3


def test_odd_rows(spark):
    rows = ODD + [(9, "x@y.org " * 3), (9, "x@y.org"), (None, "x@y.org")]
    frame = table(spark, rows)
    out = surrogates.replaced(frame, "k")
    assert out.columns == [*frame.columns, "n_entities"]
    got = out.collect()
    assert sorted(str(r.text) for r in got if not r.n_entities) == sorted(str(t) for _, t in ODD)
    assert sorted(r.n_entities for r in got if r.n_entities) == [1, 1, 3] and len({w for r in got if r.n_entities for w in r.text.split()}) == 1
    assert surrogates.replaced(table(spark, []), "k").count() == 0
