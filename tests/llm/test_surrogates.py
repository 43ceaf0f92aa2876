import re

import pytest

from quarry.llm.surrogates import GIVEN, replace_entities

TEXTS = [
    (1, "Mail Ann.Lee+x@mail.example.org or ann.lee+x@MAIL.example.org, card 4111 1111 1111 1111."),
    (2, "Card 4111-1111-1111-1111; call +1 (017) 555-7713 or 1 (017) 555 7713. IP 192.168.3.4 and 8.8.8.8, not 1.2.3 or 999.1.1.1."),
    (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"### 4785380592391139$$$ SSN 123-45-6789, DE89 3704 0044 0532 0130 00'),
    (4, "Mrs. Anna Berg met Mr Karl Berg and Herr Otto Weiß; Anna Berg left. госпожа Анна Каренина и господин Вронский."),
    (5, "Nothing personal, version 2.0, in 1999; 12345 apples."),
]


@pytest.fixture(scope="module")
def out(spark):
    return {r["doc_id"]: r for r in replace_entities(spark, spark.createDataFrame(TEXTS, "doc_id long, text string"), key="k1").collect()}


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10


def test_originals_are_gone_and_the_rest_stays(out):
    everything = "\n".join(r["text"] for r in out.values())
    for s in ("Ann.Lee", "ann.lee", "4111", "555-7713", "192.168.3.4", "8.8.8.8", "04dbebab", "4785380592391139", "123-45-6789", "3704 0044", "Berg", "Otto", "Weiß", "Каренина", "Вронский"):
        assert s not in everything
    assert out[5]["text"] == TEXTS[4][1] and out[5]["n_entities"] == 0
    assert "not 1.2.3 or 999.1.1.1" in out[2]["text"] and out[3]["text"].startswith('token = "')


def test_coreference(out):
    a, b = re.findall(r"\S+@\S+?(?=[ ,])", out[1]["text"])
    assert a == b and out[1]["n_distinct"] == 2
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", out[1]["text"] + out[2]["text"])
    assert len(cards) == 2 and len({re.sub(r"\D", "", c) for c in cards}) == 1 and " " in cards[0] and "-" in cards[1]


def test_format_type_gender_and_script(out):
    assert luhn(re.search(r"card ([\d ]+)\.", out[1]["text"])[1]) == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} or 1 \(\d{3}\) \d{3} \d{4}\.", out[2]["text"])
    assert re.search(r"IP 192\.168\.\d+\.\d+ and \d+\.\d+\.\d+\.\d+,", out[2]["text"])
    assert re.fullmatch(r'token = "[0-9a-f]{40}"### \d{16}\$\$\$ SSN \d{3}-\d\d-\d{4}, DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d', out[3]["text"])
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+) (\w+) and Herr (\w+) (\w+); (\w+) (\w+) left\. госпожа (\w+) (\w+) и господин (\w+)\.", out[4]["text"])
    assert m[1] in GIVEN["latin", "f"] and m[3] in GIVEN["latin", "m"] and m[5].endswith("o") and m[5] != "Otto"
    assert m[1] == m[7] and m[2] == m[8] and m[9] in GIVEN["cyrillic", "f"] and re.fullmatch("[а-яА-Я]+", m[11])


def rewritten(spark, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in sorted(replace_entities(spark, df, **options).collect())]


def test_key_and_distinctness(spark, out):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    again = {r["doc_id"]: r["text"] for r in replace_entities(spark, df.repartition(3), key="k1").collect()}
    assert again == {i: r["text"] for i, r in out.items()}
    other = {r["doc_id"]: r["text"] for r in replace_entities(spark, df, key="k2").collect()}
    assert all(other[i] != again[i] for i in (1, 2, 3, 4))
    many = [f"x{i % 10}@a.co y{i // 10}@a.co 10.0.{i % 250}.{i // 250} 555-{i:03d}-0000" for i in range(600)]
    real = {w for t in many for w in t.split()}
    new = {}
    for before, after in zip(many, rewritten(spark, *many), strict=True):
        for old, now in zip(before.split(), after.split(), strict=True):
            assert new.setdefault(old, now) == now and now not in real
    assert len(set(new.values())) == len(new)


def test_a_space_that_is_nearly_full(spark):
    """60,000 of 65,536 addresses: every surrogate is one of them again, and no two are the same."""
    per = 600
    lines = [" ".join(f"192.168.{i // 256}.{i % 256}" for i in range(a, a + per)) for a in range(0, 60_000, per)]
    got = rewritten(spark, *lines)
    pairs = dict(zip(" ".join(lines).split(), " ".join(got).split(), strict=True))
    assert len(pairs) == 60_000 == len(set(pairs.values()))
    assert all(re.fullmatch(r"192\.168\.\d+\.\d+", v) and v != k for k, v in pairs.items())


def test_titles_in_every_position(spark):
    titles = ["Mr", "Mr.", "Mrs", "Dr.", "Herr", "Frau", "Señora", "Prof. Dr.", "Sir"]
    frames = ["{} left.", "Then {} agreed and left.", "Then {}, who agreed, left.", "It was {}", "({}) said", "of {}'s house", "{}\nand others", "to {}; again"]
    names = ["Qqsmith", "Qqweber-Vvlang", "O'Qqneil", "Aaron Qqsmith", "von Qqsmith", "J. Qqsmith", "McQqdonald"]
    texts = [f.format(f"{t} {n}") for t in titles for f in frames for n in names]
    for before, after in zip(texts, rewritten(spark, *texts), strict=True):
        assert "Qq" not in after and "qqneil" not in after and "Aaron" not in after, (before, after)
        t = next(t for t in sorted(titles, key=len, reverse=True) if t in before)
        frame = next(f for f in frames if before.startswith(f.split("{}")[0] + t) and before.endswith(f.split("{}")[1]))
        start, end = frame.split("{}")
        assert after.startswith(f"{start}{t} ") and after.endswith(end), (before, after)
    assert rewritten(spark, "Then Mr Smith agreed and Frau Weber left.")[0].count("Smith") == 0


def test_context_and_coreference_of_persons(spark):
    a, b, c, d, e = rewritten(
        spark,
        "John Smith met us. Dr Smith and Mr Ian Smith agreed.",
        "My name is Priya Sharma. Later Priya Sharma left; nobody but Sharma knew.",
        "Write to Wei Chen <wei.chen@a.co>; Ana Ruiz and Wei Chen said so.",
        "Nothing here: New York, Apache License, General Public License and The End.",
        "Mr Smith-Sharma came, and Mrs Chen's son.",
    )
    smith = re.fullmatch(r"(\w+) (\w+) met us\. Dr (\w+) and Mr (\w+) (\w+) agreed\.", a)
    assert smith[1] in GIVEN["latin", "m"] and smith[2] == smith[3] == smith[5] != "Smith"
    priya = re.fullmatch(r"My name is (\w+) (\w+)\. Later (\w+) (\w+) left; nobody but (\w+) knew\.", b)
    assert priya[1] == priya[3] != "Priya" and priya[2] == priya[4] == priya[5] != "Sharma"
    wei = re.fullmatch(r"Write to (\w+) (\w+) <\S+@\S+>; (\w+) (\w+) and (\w+) (\w+) said so\.", c)
    assert wei[1] == wei[5] and wei[2] == wei[6] and len({"Wei", "Chen", "Ana", "Ruiz", *wei.groups()}) == 8
    assert d == "Nothing here: New York, Apache License, General Public License and The End."
    assert re.fullmatch(rf"Mr {smith[2]}-{priya[2]} came, and Mrs {wei[2]}'s son\.", e)


def mod97(account):
    s = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_check_digits_and_ranges(spark):
    accounts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606", "DE88 3704 0044 0532 0130 00"]
    got = rewritten(spark, *accounts)
    assert [mod97(x) == 1 for x in got] == [True, True, True, False]
    assert all(x[:2] == y[:2] and [c.isdigit() for c in x] == [c.isdigit() for c in y] and x[8:] != y[8:] for x, y in zip(accounts, got, strict=True))
    assert got[0][4:] == got[3][4:]
    numbers = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899, 0, 666, 900, 999) for g in (0, 1, 99) for s in (0, 1, 9999)]
    valid = lambda x: (x[:3] not in ("000", "666") and x[0] != "9", x[4:6] != "00", x[7:] != "0000")
    new = rewritten(spark, *numbers)
    assert len(set(new)) == len(numbers) and [valid(x) for x in new] == [valid(x) for x in numbers]


def test_long_secrets_and_public_addresses(spark):
    secret = "ab" * 200
    new = rewritten(spark, secret, *(f"{a}.20.30.40" for a in (0, 1, 9, 11, 126, 127, 128, 172, 173, 192, 193, 223, 224, 255)), "172.16.0.1", "172.32.0.1", "192.169.0.1")
    blocks = [new[0][i : i + 32] for i in range(0, 384, 32)]
    assert len(set(blocks)) == len(blocks) and re.fullmatch("[0-9a-f]{400}", new[0])
    firsts = [int(x.split(".")[0]) for x in new[1:]]
    reserved = {0, 10, 127, *range(224, 256)}
    assert firsts[0] == 0 and firsts[5] == 127 and firsts[-5] == 224 and firsts[-4] == 255 and not reserved & {*firsts[1:5], *firsts[6:12]}
    assert re.fullmatch(r"172\.(1[6-9]|2\d|3[01])\.\d+\.\d+", new[-3]) and not re.match(r"172\.(1[6-9]|2\d|3[01])\.", new[-2]) and not new[-1].startswith("192.168.")


def test_awkward(spark, awkward, nothing):
    got = replace_entities(spark, awkward).collect()
    assert len(got) == 10
    assert [r["text"] for r in got if r["doc_id"] in (1, 2)] in ([None, ""], ["", None])
    assert [r["n_entities"] for r in got if r["doc_id"] is None] == [1]
    assert replace_entities(spark, nothing).isEmpty()


def test_no_python_on_the_executors(spark):
    plan = replace_entities(spark, spark.createDataFrame(TEXTS, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonRDD", ""))
