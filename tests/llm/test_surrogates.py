import re

from siltstone.llm.surrogates import op4_surrogates, resolve, with_surrogates

MAIL = re.compile(r"[^\s@]+@[^\s@]+\.[a-z]+")


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MENTIONS = re.compile(
    r"(?P<mail>(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})|(?P<phone>(?<![0-9+])\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9]))"
    rf"|(?P<card>(?<![0-9])[2-6][0-9]{{15}}(?![0-9]))|(?P<ip>(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9]))"
)


def test_whole_table_by_brute_force(spark):
    """All mentions, found in Python, are replaced and nothing else; one entity, one surrogate of its format."""
    sf = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op4_surrogates(spark, sf).collect()}
    assert got.keys() == texts.keys()
    mapped, domains = {}, {}
    for k, text in texts.items():
        found = [m for m in MENTIONS.finditer(text) if m.lastgroup != "card" or luhn(m[0])]
        assert got[k].n_entities == len(found)
        assert got[k].entity_kinds == ",".join(sorted({{"mail": "email"}.get(m.lastgroup, m.lastgroup) for m in found}))
        at, pattern = 0, ""
        for m in found:
            pattern += re.escape(text[at : m.start()]) + {"mail": r"([^\s@]+@[^\s@]+)", "phone": r"(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})", "card": "([2-6][0-9]{15})", "ip": r"([0-9]+(?:\.[0-9]+){3})"}[m.lastgroup]
            at = m.end()
        new = re.fullmatch(pattern + re.escape(text[at:]), got[k].text, re.S)
        assert new, (text, got[k].text)
        for m, said in zip(found, new.groups()):
            kind, old = m.lastgroup, m[0]
            if kind == "mail":
                old, said = old.lower(), said.lower()
                assert len(old) == len(said) and [c for c in old if not c.isalnum()] == [c for c in said if not c.isalnum()]
                assert old.rpartition(".")[2] == said.rpartition(".")[2]
                assert domains.setdefault(old.split("@")[1], said.split("@")[1]) == said.split("@")[1]
            if kind == "card":
                assert luhn(said) and said[0] == old[0]
            assert mapped.setdefault((kind, old), said) == said
    assert len({(k[0], v) for k, v in mapped.items()}) == len(mapped) > 300
    assert not {(k[0], v) for k, v in mapped.items()} & mapped.keys()
    assert len(set(domains.values())) == len(domains) and not set(domains.values()) & domains.keys()


def rewritten(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in with_surrogates(df, "k").orderBy("doc_id").collect()]


def test_names_without_title_and_parts_of_names(spark):
    a, b, c, d = rewritten(
        spark,
        "Dr. Anna Schmidt came. Anna Schmidt left; Frau Schmidt's car. Schmidt said so. Schmidtchen",
        "Prof. Dr. Anna Schmidt, HERR Müller-Lüdenscheidt and Mr Schmidt; Schmidt",
        "I miss Paris. Κύριος Παπαδόπουλος. Господин Иванов, ГОСПОЖА Иванова; قال السيد محمد علي",
        "Anna Schmidt, who has no title here",
    )
    m = re.fullmatch(r"Dr\. (\w+) (\w+) came\. (\w+) (\w+) left; Frau (\w+)'s car\. (\w+) said so\. Schmidtchen", a)
    given, surname = m[1], m[2]
    assert m.groups() == (given, surname, given, surname, surname, surname) and given != "Anna" and surname != "Schmidt"
    m = re.fullmatch(r"Prof\. Dr\. (\w+) (\w+), HERR (\w+) and Mr (\w+); (\w+)", b)
    assert (m[1], m[2], m[4], m[5]) == (given, surname, surname, surname) and m[3] not in (surname, "Müller")
    m = re.fullmatch(r"I miss Paris\. Κύριος ([\u0370-\u03ff]+)\. Господин ([а-яА-Я]+), ГОСПОЖА ([а-яА-Я]+); قال السيد ([\u0600-\u06ff]+) ([\u0600-\u06ff]+)", c)
    assert m[2] != "Иванов" and m[3].endswith("ова") and "محمد" not in c and "علي" not in m[5]
    assert d == "Anna Schmidt, who has no title here"


def test_numbers_keep_what_they_are(spark):
    (a,) = rewritten(spark, "+49 30 123456, +351 21 123 4567, 1699999999999, 4111111111111112, 172.20.3.4, 172.32.3.4, 169.254.1.1, a.b@x.org, c.d@X.ORG")
    m = re.fullmatch(r"\+49 (\d\d) (\d{6}), \+351 (\d\d \d{3} \d{4}), 1699999999999, 4111111111111112, (172\.20\.\d+\.\d+), (\d+)\.\d+\.\d+\.\d+, 169\.254\.(\d+\.\d+), [a-z]\.[a-z]@([a-z])\.org, [a-z]\.[a-z]@([A-Z])\.(?:org|ORG)", a)
    assert m and m[2] != "123456" and m[4] != "172.20.3.4" and m[5] != "172" and m[6] != "1.1" and m[7] == m[8].lower() != "x"


def test_used_up_spaces(spark):
    """All addresses of a private range are real; and a space with a single entity in it."""
    rows = [("ip", "", f"192.168.{i}.{j}", "n") for i in range(1, 255) for j in range(1, 255)] + [("ssn", "", "1", "n")]
    entities = spark.createDataFrame(rows, "kind string, scope string, norm string, gender string")
    got = resolve(entities, "k", 3).collect()
    assert len({r.surrogate for r in got}) == len(got) == len(rows)
    assert all(r.surrogate != r.norm for r in got)
    assert all(r.surrogate.startswith("192.168.") for r in got if r.kind == "ip")
    assert [r.surrogate[0] + str(len(r.surrogate) > 1) for r in got if r.kind == "ssn"] == ["1True"]


def test_formats_and_coreference(spark):
    docs = [
        (1, "Mail Jane.Doe@Mail.example.com, JANE.DOE@MAIL.EXAMPLE.COM or jane.doe@mail.example.com."),
        (2, "Card 4111 1111 1111 1111 and 4111111111111111; phone +1 (974) 555-3436."),
        (3, "Frau Müller met Mr. John Smith; Mrs Smith wrote to г-жа Иванова and 123-45-6789 at 10.1.2.3."),
        (4, None),
        (5, ""),
        (6, "clean text 12 34, version 1.2.3"),
        (3, "Frau Müller met Mr. John Smith; Mrs Smith wrote to г-жа Иванова and 123-45-6789 at 10.1.2.3."),
        (None, "x" * 20000 + " 4111111111111111 " + "a.b@c.de " * 500),
    ]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, N_entities int, row string")
    rows = with_surrogates(df, "k").collect()
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    one = by[1][0].text
    a, b, c = MAIL.findall(one.replace(",", " ").replace("COM", "com"))
    assert b.replace("com", "COM") == c.rstrip(".").upper() or b.lower() == c.rstrip(".")
    assert a[0].isupper() and a.lower() == c.rstrip(".") and "jane" not in one.lower()
    two = by[2][0].text
    first, second = re.search(r"\d{4} \d{4} \d{4} \d{4}", two)[0], re.search(r"\d{16}", two)[0]
    assert first.replace(" ", "") == second != "4111111111111111" and luhn(second) and second[0] == "4"
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", two) and "974" not in two[-20:]
    three = by[3][0].text
    assert by[3][1].text == three
    assert re.fullmatch(r"Frau [A-Z]\w+ met Mr\. [A-Z]\w+ [A-Z]\w+; Mrs [A-Z]\w+ wrote to г-жа [А-Я][а-я]+ and \d{3}-\d\d-\d{4} at 10\.\d+\.\d+\.\d+\.", three)
    assert "Smith" not in three and "Müller" not in three
    assert by[4][0].text is None and by[5][0].text == "" and by[6][0].text == docs[5][1]
    assert by[None][0].n_entities == 501 and "a.b@c.de" not in by[None][0].text
    assert {r.row for r in rows} == {"k"}
    assert with_surrogates(df.limit(0), "k").count() == 0


def test_collisions_are_resolved(spark):
    # one-letter users of a five-letter address space collide, at times with real ones
    users = [("user", "b.cc", chr(97 + i), "n") for i in range(26)] + [("user", "c.cc", chr(97 + i), "n") for i in range(20)]
    names = [("given", "", f"Name{i}", "fmn"[i % 3]) for i in range(60)] + [("surname", "", f"Some{i}", "n") for i in range(200)]
    entities = spark.createDataFrame([("ssn", "", f"{i:09d}", "n") for i in range(50)] + users + names, "kind string, scope string, norm string, gender string")
    got = resolve(entities, "k").collect()
    assert len(got) == entities.count() == len({(r.kind, r.scope, r.surrogate) for r in got})
    assert not {(r.kind, r.scope, r.surrogate) for r in got} & {(r.kind, r.scope, r.norm) for r in got}


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "Mr Smith, a.b@c.de")], "doc_id long, text string")
    plan = with_surrogates(df, "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
