import re

import pytest
from pyspark.sql import functions as F

from obsframe.llm import surrogates

KEY = "secret"


def replaced(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["text"] for r in surrogates.replace_entities(docs, KEY).orderBy("doc_id").collect()]


def luhn(digits):
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


FORMS = [
    ("mail jane.doe@mail.example.com now", r"mail [a-z]{4}\.[a-z]{3}@[a-z]{4}\.[a-z]{7}\.com now"),
    ("call +1 (171) 555-2028.", r"call \+1 \(\d{3}\) \d{3}-\d{4}\."),
    ("+1!! (171)!! 555-2028!!", r"\+1!! \(\d{3}\)!! \d{3}-\d{4}!!"),
    ("at 106.158.249.239.", r"at \d+\.\d+\.\d+\.\d+\."),
    ("id 123-45-6789", r"id \d{3}-\d{2}-\d{4}"),
    ('token = "97AA0C3105535F423F352535E4AC53B5FEFE076A"', r'token = "[0-9A-F]{40}"'),
    ("GB82 WEST 1234 5698 7654 32", r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d"),
]


@pytest.fixture(scope="module")
def out(spark):
    return replaced(spark, [t for t, _ in FORMS])


@pytest.mark.parametrize("n", range(len(FORMS)))
def test_format_is_kept(out, n):
    assert re.fullmatch(FORMS[n][1], out[n]) and out[n] != FORMS[n][0]


def test_cards_keep_their_check_digit(spark):
    cards = ["4111 1111 1111 1111", "5500000000000004", "0558474048242795"]
    for before, after in zip(cards, replaced(spark, cards)):
        a, b = (re.sub(r"\D", "", c) for c in (before, after))
        assert a != b and len(a) == len(b) and luhn(a) == luhn(b)


def test_mentions_of_one_entity_agree(spark):
    a, b, c, d = replaced(spark, ["Ann.Lee@x-y.example.com", "ANN.LEE@X-Y.EXAMPLE.COM", "+1 (171) 555-2028", "+1*** (171)%%% 555-2028"])
    assert a.lower() == b.lower() and b == b.upper()
    assert re.sub(r"\D", "", c) == re.sub(r"\D", "", d) != "11715552028"


def test_names_keep_title_gender_script_and_surname(spark):
    mr, mrs, alone, frau, russian = replaced(spark, ["Mr John Smith", "Mrs Mary Smith", "Dr Smith", "Frau Anna Müller", "г-жа Анна Петрова"])
    title, first, last = mr.split()
    assert title == "Mr" and first.lower() in [n.lower() for n in surrogates.FIRST_NAMES["male", "latin"]]
    assert mrs.split()[1].lower() in [n.lower() for n in surrogates.FIRST_NAMES["female", "latin"]]
    assert last == mrs.split()[2] == alone.split()[1] != "Smith"
    assert frau.startswith("Frau ") and "Müller" not in frau
    assert re.fullmatch(r"г-жа [А-Яа-я]+ [А-Яа-я]+", russian) and "Петрова" not in russian


def test_collisions_are_resolved(spark):
    """Of 150 surnames many fall on the same two syllables; all surrogates differ, and none is an original."""
    forms = [f"any name{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(150)]
    entities = spark.createDataFrame([("name", f) for f in forms], "kind string, form string")
    first = {r["s"] for r in entities.select(surrogates.propose(KEY, 0).alias("s")).collect()}
    assert len(first) < 150
    got = surrogates.assign(entities, KEY).collect()
    assert len(got) == 150 == len({r["surrogate"] for r in got}) and not {r["surrogate"] for r in got} & set(forms)


def test_a_surrogate_is_never_another_entity(spark):
    one = spark.createDataFrame([("ip", "1.2.3.4")], "kind string, form string")
    taken = surrogates.assign(one, KEY).first()["surrogate"]
    both = surrogates.assign(one.unionAll(spark.createDataFrame([("ip", taken)], one.schema)), KEY).collect()
    assert not {r["surrogate"] for r in both} & {"1.2.3.4", taken} and len({r["surrogate"] for r in both}) == 2


def test_key_decides(spark):
    docs = spark.createDataFrame([(1, "ip 10.20.30.40")], "doc_id long, text string")
    a, b, c = (surrogates.replace_entities(docs, k).first()["text"] for k in ("k1", "k1", "k2"))
    assert a == b != c


def test_odd_rows_and_clashing_columns(spark):
    long = "plain words " * 20000 + "x1@y2.com"
    rows = [(1, None, 5), (2, "", 5), (3, "a 1 b", 5), (4, "to x1@y2.com", 5), (4, "to x1@y2.com", 5), (None, "to x1@y2.com", 5), (6, long, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_entities int").withColumns({"kind": F.lit("own"), "_id": F.lit(9)})
    got = surrogates.replace_entities(docs, KEY).collect()
    assert len(got) == 7 and {r["kind"] for r in got} == {"own"} and {r["_id"] for r in got} == {9}
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["text"], by[2]["text"], by[3]["text"]) == (None, "", "a 1 b")
    assert by[1]["n_entities"] == by[3]["n_entities"] == 0 and by[6]["n_entities"] == 1
    assert len({r["text"] for r in got if r["doc_id"] in (4, None)}) == 1 and by[6]["text"].startswith("plain words ")
    assert not any("x1@y2.com" in (r["text"] or "") for r in got)
    assert surrogates.replace_entities(docs.limit(0), KEY).count() == 0


@pytest.mark.parametrize("text", ["version 1.2.3 of 2024", "12345678", "a@b", "5 @ home", "Mr. lower", "abcdef0123456789"])
def test_ordinary_text_stays(spark, text):
    assert replaced(spark, [text]) == [text]


def test_many_surnames_keep_one_surrogate_each(spark):
    """More surnames than two syllables give: each keeps its surrogate alone, with any title and with any first name."""
    names = ["Name" + chr(97 + n // 26) + chr(97 + n % 26) for n in range(400)]
    firsts = ["First" + chr(97 + n) for n in range(25)]
    texts = [f"Dr {n}, Mr {firsts[i % 25]} {n}, Mrs {firsts[i % 7]} {n}" for i, n in enumerate(names)]
    got = [[m.split()[1:] for m in t.split(", ")] for t in replaced(spark, texts)]
    last = [{m[-1] for m in mentions} for mentions in got]
    assert all(len(s) == 1 for s in last) and len(set.union(*last)) == 400 and not set.union(*last) & set(names)
    for at, n in ((1, 25), (2, 7)):
        pairs = {(firsts[i % n], mentions[at][0]) for i, mentions in enumerate(got)}
        assert len(pairs) == n == len({new for _, new in pairs})


def test_secrets_without_digits_are_replaced(spark):
    secrets = ["AKIA" + "IOSFODNNEXAMPLEQ", "ghp_" + "abcdefghijKLMNOPqrst", "sk-" + "ABCDEFGHIJKLMNOPQ", "abcdefab" * 4, "ABCDEFAB" * 4]
    out = replaced(spark, [f"the key is {s} here" for s in secrets])
    assert all(re.fullmatch(r"the key is \S+ here", t) and s not in t for s, t in zip(secrets, out))


@pytest.mark.parametrize("n", [64, 65, 129, 5000])
def test_long_secrets_and_addresses_are_replaced_whole(spark, n):
    key, run, local = "sk_" + "aB3" * (n // 3 + 1), "0a1b" * (n // 4 + 9), "j" * n
    text = f"x {key} y {run} z {local}@mail.example.org and {'q' * n} stays"
    found = surrogates.replace_entities(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()["text"]
    x, new_key, y, new_run, z, new_mail, *rest = found.split(" ")
    assert (x, y, z, rest) == ("x", "y", "z", ["and", "q" * n, "stays"])
    assert len(new_key) == len(key) and new_key[3:] != key[3:] and not any(key[i : i + 12] in found for i in range(3, len(key) - 12))
    assert re.fullmatch("[0-9a-f]+", new_run) and len(new_run) == len(run) and new_run != run
    assert new_mail.endswith(".org") and len(new_mail) == n + len("@mail.example.org") and local not in found.replace("q", "")
