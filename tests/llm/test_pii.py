import hashlib
import re

from strataloom.llm import pii
from tests.llm.helpers import AWKWARD, frame


def valid_card(number):
    digits = [int(d) for d in reversed(re.sub(r"\D", "", number))]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def texts(spark, docs):
    return {r["doc_id"]: r for r in pii.surrogate_texts(frame(spark, docs)).collect()}


def test_kinds_formats_and_coreference(spark):
    docs = [
        (1, "Mail Anna.K@mail3.example.com or +1 (017) 555-7713."),
        (2, "anna.k@mail3.example.com, +1 017 555-7713"),
        (3, "Pay 4539 1488 0343 6467, or 4539148803436467; not 4539148803436468."),
        (4, "Frau Anna Keller met Herr KELLER at 10.20.30.40."),
        (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" but 24be64439e3e49cf46b2d7c90f3602a3d0b907ff'),
        (6, "Мария Иванова и Господин Иванов"),
    ]
    got = texts(spark, docs)
    one, two = got[1]["text"], got[2]["text"]
    mail = re.search(r"Mail (\S+) or", one)[1]
    assert mail == two.split(",")[0] and re.fullmatch(r"[a-z]{4}\.[a-z]@[a-z]{4}\d\.[a-z]{7}\.example", mail)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.$", one) and re.sub(r"\D", "", one.split("or")[-1]) == re.sub(r"\D", "", two.split(",")[1])
    spaced, plain, decoy = re.fullmatch(r"Pay (\d{4} \d{4} \d{4} \d{4}), or (\d{16}); not (\d{16})\.", got[3]["text"]).groups()
    assert spaced.replace(" ", "") == plain != "4539148803436467" and valid_card(plain) and plain[0] == "4" and decoy == "4539148803436468"
    title, given, name, upper = re.fullmatch(r"(Frau) (\w+) (\w+) met Herr (\w+) at \d+\.\d+\.\d+\.\d+\.", got[4]["text"]).groups()
    assert given in pii.GIVEN["f", "latin"] and given != "Anna" and name != "Keller" and upper == name.upper()
    secret = re.fullmatch(r'token = "([0-9a-f]{40})" but (\w+)', got[5]["text"])
    assert secret[1] != secret[2] == "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    she, name, he = re.fullmatch(r"(\w+) (\w+) и Господин (\w+)", got[6]["text"]).groups()
    assert she in pii.GIVEN["f", "cyrillic"] and name.endswith("нова") and he.endswith("нов")
    assert got[4]["kinds"] == ["given", "ip", "surname"] and got[3]["n_entities"] == 2


def test_surrogates_are_distinct_and_new(spark, monkeypatch):
    values = [f"10.0.{i}.{j}" for i in range(6) for j in range(6)]
    # so few surrogates that many attempts collide, and some are entities themselves
    original = pii.surrogate
    few = lambda kind, value, attempt, stream: f"concat('10.0.0.', cast(({pii.number_at(stream, '0')} + 7 * {attempt}) % 160 AS string))"
    monkeypatch.setattr(pii, "surrogate", few)
    rows = pii.assigned(spark.createDataFrame([("ip", v) for v in values], "kind string, value string"), attempts=200).collect()
    made = [r["surrogate"] for r in rows]
    assert len(set(made)) == len(values) and not set(made) & set(values) and any(r["attempt"] for r in rows)
    monkeypatch.setattr(pii, "surrogate", original)


def test_attempts_reach_the_texts(spark, monkeypatch):
    few = lambda kind, value, attempt, stream: f"CASE WHEN {kind} = 'ip' THEN concat('9.9.9.', cast(({pii.number_at(stream, '0')} + 13 * {attempt}) % 40 AS string)) END"
    monkeypatch.setattr(pii, "surrogate", few)
    docs = [(i, f"at 10.0.0.{i} and 10.0.0.{(i + 1) % 12}") for i in range(12)]
    got = texts(spark, docs)
    names = {i: re.findall(r"9\.9\.9\.\d+", got[i]["text"]) for i in got}
    assert len({n[0] for n in names.values()}) == 12
    assert all(names[i][1] == names[(i + 1) % 12][0] for i in names)


def test_given_names_are_a_permutation():
    names = pii.given_names()
    assert sorted(names) == sorted(names.values()) and all(k != v for k, v in names.items())


def test_awkward_rows(spark):
    got = texts(spark, AWKWARD)
    assert {i: r["text"] for i, r in got.items()} == dict(AWKWARD) and not any(r["n_entities"] for r in got.values())
    assert pii.surrogate_texts(frame(spark, AWKWARD).limit(0)).count() == 0
    rows = pii.surrogate_texts(frame(spark, [(None, "x@mail.example.com"), (1, "x@mail.example.com"), (1, "plain")])).collect()
    assert len({r["text"] for r in rows if r["n_entities"]}) == 1 and len(rows) == 3


def test_long_texts_without_blanks(spark):
    docs = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "a.b-" * 50_000), (4, "@" * 100_000), (5, "A" * 100_000)]
    assert {i: r["text"] for i, r in texts(spark, docs).items()} == dict(docs)


def test_secrets_phones_and_cards_of_any_form(spark):
    gone = {
        1: ('password = "hunter2x"', "hunter2x"),
        2: ('{"api_key": "q7!x y\\"z9", "user": "bob"}', 'q7!x y\\"z9'),
        3: ("DB_PASSWORD='p@ss,w0rd!'; next", "p@ss,w0rd!"),
        4: ("secret: ab1, then", "ab1"),
        5: ("call (555) 555-1234 now", "(555) 555-1234"),
        6: ("call 0044 20 7946 0958 now", "0044 20 7946 0958"),
        7: ("call 555-867-5309 or", "555-867-5309"),
        8: ("ruf 0171 5551234 an", "0171 5551234"),
        9: ("appelez 06 12 34 56 78.", "06 12 34 56 78"),
        10: ("call +15558675309 now", "+15558675309"),
        11: ("pay 3782 822463 10005 now", "3782 822463 10005"),
        12: ("token: Bearer abc.def-1 x", "abc.def-1"),
        13: ("passwd=****", "****"),
        14: ("+33 6 12 34 56 78 est", "+33 6 12 34 56 78"),
    }
    same = {50: "on 01.02.2020 12:30 and 2020-01-02", 51: '"password": null, token = ""', 52: "pay 3782 822463 10006", 53: "the token and a password", 54: "120 200 300 400 at 0.12345678901"}
    got = texts(spark, [(i, t) for i, (t, _) in gone.items()] + list(same.items()))
    for i, (text, value) in gone.items():
        before, after = text.split(value)
        new = got[i]["text"]
        assert new.startswith(before) and new.endswith(after) and new[len(before) : len(new) - len(after)] != value, new
        assert got[i]["n_entities"] == 1
    assert {i: got[i]["text"] for i in same} == same
    assert got[2]["kinds"] == ["secret"] and got[5]["kinds"] == ["phone"] and got[11]["kinds"] == ["card"]
    assert re.search(r"\(\d{3}\) \d{3}-\d{4} now", got[5]["text"]) and valid_card(re.search(r"\d{4} \d{6} \d{5}", got[11]["text"])[0])


def test_long_secrets_take_time_in_proportion(spark):
    """A value of 1 MB, and one line of many settings."""
    import time

    docs = [(1, "password = " + "Ab3é" * 250_000), (2, "token=" * 20_000), (3, "secret = " + "0a" * 100_000)]
    began = time.time()
    got = texts(spark, docs)
    assert time.time() - began < 60
    new = got[1]["text"].removeprefix("password = ")
    assert len(new) == 1_000_000 and re.fullmatch(r"([A-Z][a-z][0-9][a-z])+", new) and got[1]["kinds"] == ["secret"]
    assert re.fullmatch("secret = [0-9a-f]{200000}", got[3]["text"])


def test_short_secrets_find_free_surrogates(spark):
    got = texts(spark, [(i, f"password = {i}") for i in range(10)])
    made = [got[i]["text"] for i in range(10)]
    assert len(set(made)) == 10 and not set(made) & {f"password = {i}" for i in range(10)}


# ---------------------------------------------------------------- brute force over all kinds


def numbers(kind, value, attempt=0):
    seed = f"{pii.KEY}:{kind}:{attempt}:{value}"
    digits = hashlib.sha256(seed.encode()).hexdigest() + hashlib.sha256(f"2{seed}".encode()).hexdigest()
    return digits, lambda i: int(digits[2 * (i % 64) : 2 * (i % 64) + 2], 16)


def letters(text, at):
    if re.fullmatch(r"(?=.*[a-f])[0-9a-f]+", text):
        return "".join("0123456789abcdef"[at(i) % 16] for i in range(len(text)))
    out = ""
    for i, c in enumerate(text):
        out += str(at(i) % 10) if c in "0123456789" else chr(65 + at(i) % 26) if c.isupper() else chr(97 + at(i) % 26) if c.isalpha() else c
    return out


def check_sum(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total


def replaced(kind, raw):
    """What stands in place of one entity, worked out from the definition."""
    if kind == "email":
        value = raw.lower()
        digits, at = numbers(kind, value)
        local, domain = value.split("@")
        back = digits[::-1]
        return letters(local, at) + "@" + letters(domain.rsplit(".", 1)[0], lambda i: int(back[2 * (i % 64) : 2 * (i % 64) + 2], 16)) + ".example"
    if kind == "ip":
        _, at = numbers(kind, raw)
        return f"{1 + at(0) % 223}.{at(1)}.{at(2)}.{1 + at(3) % 254}"
    if kind == "secret":
        return letters(raw, numbers(kind, raw)[1])
    value = re.sub("[^0-9+]" if kind == "phone" else "[^0-9]", "", raw)
    _, at = numbers(kind, value)
    if kind == "phone":
        kept = 2 if re.match("[+][17]", value) else 3 if re.match("[+]|00[17]", value) else 4 if value.startswith("00") else 1 if value.startswith("0") else 0
        new = value[:kept] + letters(value[kept:], at)
    else:
        body = value[0] + letters(value, at)[1:-1]
        new = body + str(-check_sum(body + "0") % 10)
    digits = iter(new.replace("+", ""))
    return "".join(next(digits) if c.isdigit() else c for c in raw)


ENTITIES = {
    "email": ["Ann.Bee@mail.example.com", "x_1@a.org"],
    "phone": ["+10175557713", "+1 017 555 7713", "+1 0175557713", "+49 (30) 123 4567", "+1.017.555.7713", "(555) 555-1234", "0044 20 7946 0958"],
    "ip": ["10.1.2.33", "255.0.0.1"],
    "card": ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005"],
    "secret": ["hunter2x", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"],
}


def test_every_kind_against_brute_force(spark):
    templates = {"secret": 'set password = "{}" now'}
    docs, wanted, k = [], {}, 0
    for kind, values in ENTITIES.items():
        for raw in values:
            template = templates.get(kind, "before {} after, and {} again\n")
            k += 1
            docs.append((k, template.replace("{}", raw)))
            wanted[k] = template.replace("{}", replaced(kind, raw))
    rows = {r["doc_id"]: r["text"] for r in pii.surrogate_texts(frame(spark, docs)).collect()}
    assert rows == wanted
    # one number in three ways of writing has one surrogate
    assert len({re.sub("[^0-9+]", "", replaced("phone", p)) for p in ENTITIES["phone"][:3]}) == 1
    assert all(check_sum(re.sub("[^0-9]", "", replaced("card", c))) % 10 == 0 for c in ENTITIES["card"])
