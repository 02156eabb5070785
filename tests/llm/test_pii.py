import datetime as dt
import random

from pyspark.sql import functions as F

from lexiweave.llm.pii import Params, luhn_digit, permute, pseudonymise, pseudonymise_documents

KEY = b"k"


def test_permutation_is_one_to_one():
    for n in (1, 2, 37, 1000):
        assert sorted(permute(i, n, KEY, "x") for i in range(n)) == list(range(n))


def test_formats_checks_and_links():
    text = "a 4111 1111 1111 1111 b 4111111111111111 c +1 (436) 555-8670 d 56.187.231.175. e 1999-12-31 f 12/31/1999 g ab.9@x.example.com h DE89 3704 0044 0532 0130 00"
    new, found = pseudonymise(text, KEY)
    assert [k for k, *_ in found] == ["card", "card", "phone", "ip", "date", "date", "email", "iban"]
    parts = new.split(" ")
    first, second = "".join(parts[1:5]), parts[6]
    assert first == second and luhn_digit(first[:-1]) == first[-1] and first != "4111111111111111"
    assert dt.date.fromisoformat(new.split(" e ")[1][:10]) and len(new) == len(text) + sum(len(a) - len(b) for a, b in [(new.split(" d ")[1].split(" ")[0], "56.187.231.175.")])
    assert pseudonymise(text, KEY)[0] == new != pseudonymise(text, b"other")[0]


def test_values_that_fail_their_check_stay():
    text = "4111111111111112 and 300.1.1.1 and 1999-13-01 and 000-12-3456 and 12345"
    assert pseudonymise(text, KEY) == (text, [])


def test_a_failed_candidate_hides_no_value():
    iban = "ES91 2100 0418 4502 0005 1332"
    alone = pseudonymise(iban, KEY)[0]
    for tail in ("EUR", "2024", "AMOUNT", "AB12 CD34", "2024 EUR."):
        assert pseudonymise(f"to {iban} {tail}", KEY) == (f"to {alone} {tail}", [("iban", 3, 3 + len(iban))])
    assert pseudonymise(iban.replace(" ", "") + " EUR", KEY)[0] == alone.replace(" ", "") + " EUR"
    assert pseudonymise(f"AB12 {iban}", KEY)[0] == f"AB12 {alone}"
    card = "4111 1111 1111 1111"
    for lead in ("ID12 ", "1234 "):
        new, found = pseudonymise(lead + card, KEY)
        assert found == [("card", 5, 24)] and new == lead + pseudonymise(card, KEY)[0] != lead + card


def test_rows(spark, docs, no_docs):
    out = pseudonymise_documents(docs.withColumn("spans", F.lit(1)), Params(KEY))
    assert out.count() == docs.count() and out.where("n_found > 0").count() == 0
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, docs.select("doc_id", "text").collect()))
    assert pseudonymise_documents(no_docs, Params(KEY)).count() == 0


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_planted_values_in_rows(spark):
    """Planted values are found in every row, pass their checks by plain rules, and stay linked; the words around them stay."""
    rng = random.Random(8)
    cards = [next(str(n) for n in iter(lambda: rng.randrange(4 * 10**15, 5 * 10**15), None) if luhn(str(n))) for _ in range(6)]
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(6)]
    rows = [(i if i % 4 else None, f"row {i} pays {cards[i % 6]} from {ips[i % 5]} end") for i in range(40)]
    rows += [(99, "clean words " * 30_000 + cards[0]), (100, "clean"), (100, "clean"), (None, None), (None, "")]
    out = pseudonymise_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_card", F.lit(7)), Params(KEY)).collect()
    assert len(out) == len(rows)
    linked = {}
    for r in out:
        old = [t for i, t in rows if i == r.doc_id and (t or "")[:8] == (r.text or "")[:8]]
        if (r.text or "").startswith("row"):
            _, n, _, card, _, ip, end = r.text.split()
            assert (r.n_card, r.n_ip, r.n_found, end) == (1, 1, 2, "end") and luhn(card) and len(card) == 16
            assert all(0 <= int(x) < 256 for x in ip.split("."))
            for was, now in ((cards[int(n) % 6], card), (ips[int(n) % 5], ip)):
                assert linked.setdefault(was, now) == now != was
        elif r.doc_id == 99:
            assert r.text == "clean words " * 30_000 + linked.get(cards[0], r.text[-16:]) and r.n_card == 1
        else:
            assert r.text in old and r.n_found == 0
    assert len(set(linked.values())) == len(linked) == 11
