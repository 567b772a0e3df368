import random

import pytest

from replicata.llm import pii

GIVEN, FAMILY = [f"Ga{c}ra" for c in "bdfklmnprst"], [f"Fo{c}ski" for c in "bdfklmnprst"]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = []
    for i, g in enumerate(GIVEN):
        for j, f in enumerate(FAMILY):
            texts.append(f"Signed by {g} {f} on receipt. The {f} buffer was replaced on 2024-01-02. Order 12 0345 00067 is still open.")
            texts.append(f"Reviewed with Dr. {f} last week. Call +1-207-555-01{i:02} now.\nBest regards,\n{g} {f}\n{g.lower()}.{f.lower()}@lab.example")
    texts += [f"Signed by Unknowna Newmani{c} on receipt. Call 207 555 01{i:02} now." for i, c in enumerate("abcdefgh", 30)]
    texts += ["Thanks to the North Bench. Passport or ID on file: QQ 12 34 56 A.", "", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, kind string")
    # half of the families are missing from the lexicon
    lex = spark.createDataFrame([(g, "given") for g in GIVEN] + [(f, "family") for f in FAMILY[::2]] + [(None, "given")], "token string, role string")
    found = {}
    for r in pii.find_pii(docs, lex).collect():
        found.setdefault(r.doc_id, set()).add((r.kind, r.pii_value))
    return texts, found, docs, lex


def test_names_by_context(corpus):
    texts, found, _, _ = corpus
    for i, t in enumerate(texts):
        if t and t.startswith("Signed by Ga"):
            assert {v for k, v in found[i] if k == "name"} == {t[10 : t.index(" on receipt")]}
        if t and "Unknowna" in t:
            assert ("name", t[10 : t.index(" on receipt")]) in found[i]
        if t and "Reviewed" in t:
            assert len([1 for k, _ in found[i] if k == "name"]) == 2 and len([1 for k, _ in found[i] if k == "email"]) == 1
    assert not any("North" in v for x in found.values() for _, v in x)


def test_numbers_by_context(corpus):
    texts, found, _, _ = corpus
    assert not any("0345" in v for x in found.values() for _, v in x)
    for i, t in enumerate(texts):
        if t and "Unknowna" in t:
            assert [v for k, v in found[i] if k == "phone"] == [t[t.index("Call ") + 5 : t.index(" now")]]
    assert ("id_number", "QQ 12 34 56 A") in found[len(texts) - 3]


def test_redacted(corpus):
    texts, _, docs, lex = corpus
    out = {r.doc_id: r.text for r in pii.find_pii(docs, lex, redacted=True).collect()}
    assert len(out) == len(texts) and out[len(texts) - 1] is None and out[len(texts) - 2] == ""
    assert out[0].startswith("Signed by <NAME> on receipt. The ") and "<EMAIL>" in out[1] and "<PHONE>" in out[1]


def test_shapes():
    def values(t):
        return [(c.kind, c.value) for c in sorted(pii.shaped(t)[0], key=lambda c: c.start)]

    assert values("a.b+c@x-y.example, d [at] lab [dot] example; e AT lab DOT test; f @ q.test.") == [("email", v) for v in ("a.b+c@x-y.example", "d [at] lab [dot] example", "e AT lab DOT test", "f @ q.test")]
    assert values("pKi@pH8.49 by @curation-bot, meet at noon") == []
    for a in ("221B Elm Street, Oldtown NW1 6XE", "12 North Elm Street", "Flat 3, 17 Elm Court, Oldtown", "9 Elm Ave., Apt 4, Oldtown, 12345", "5 Elm Blvd\nOldtown 12345", "P.O. Box 12, Oldtown 12345", "Ulmenstraße 4, 12345 Altstadt", "Ulmenweg 7a, D-12345 Altstadt", "Ulmenstr. 9", "4 bis, avenue Orme, 12345 Vieuxbourg", "12 rue de Orme, 12345 Vieuxbourg", "Calle Olmo 5, 12345 Villavieja", "C/ Olmo 10, 2º B", "Avda. de Olmo, 84, Villavieja"):
        assert values(f"see {a}.") == [("address", a)], a
    for p in ("+49 30 23125 688", "0049 30 23125 216", "(517) 555-0176", "1 (505) 555 0168", "657 555 0103 ext. 87", "01.99.00.35.45", "030 23125-342", "030/23125745", "555 01 0103"):
        assert values(f"tel {p}.") == [("phone", p)], p
    # numbers of other kinds are no candidates, or weak ones that only their context could make phones
    assert not [c.value for c in pii.shaped("HTX-00040068, Lot 3772-4304, Barcode 3488 3397 96, Order 0057-768-0089, item 4458-28-7")[0] if c.seed]
    assert values("HTX-00040068, Lot 3772-4304, Barcode 3488 3397 96, item 4458-28-7") == []


def test_addresses_and_disguised_mail_by_context(spark):
    """Street words that no list has, and mail in a disguise that may be a sentence, are learned from where known ones stand."""
    streets = ["Elm Street", "Oak Road", "Ash Lane", "Fir Avenue", "Yew Court", "Bay Drive"]
    texts = [f"Please ship to: {n} {s}, Oldtown 12345. Write to us via {s.split()[0].lower()}{n}@lab.example today. In batch {n} the Plate {n} was full." for n in range(2, 9) for s in streets]
    odd = ["Via Roma 12, 20121 Milano", "7 Strada Verde, 50121 Firenze", "Via della Rosa 3, 20121 Milano"]
    texts += [f"Please ship to: {a}. Write to us via anna{i} at lab.example today. In batch 3 the Plate {i}3 was full." for i, a in enumerate(odd)]
    texts += ["We met Via Roma 12 people, and look at results.csv today. Please see Fold 4, 12345 Rows."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lex = spark.createDataFrame([("Ada", "given")], "token string, role string")
    got = {(r.doc_id, r.kind, r.pii_value) for r in pii.find_pii(docs, lex).collect()}
    first = len(texts) - 4
    for i, a in enumerate(odd):
        assert {x for x in got if x[0] == first + i} == {(first + i, "address", a), (first + i, "email", f"anna{i} at lab.example")}
    assert not [x for x in got if x[0] == first + 3]
    assert all(len([x for x in got if x[0] == i]) == 2 for i in range(first))
    out = {r.doc_id: r.text for r in pii.find_pii(docs, lex, redacted=True).collect()}
    assert out[first] == "Please ship to: <ADDRESS>. Write to us via <EMAIL> today. In batch 3 the Plate 03 was full."


def test_kept_against_brute_force():
    rng = random.Random(4)
    kept, have = pii.Kept(), []
    for _ in range(300):
        s = rng.randrange(400)
        e = s + rng.randrange(1, 8)
        free = all(e <= a or s >= b for a, b in have)
        assert kept.add(s, e) == free
        have += [(s, e)] * free


def test_repeated_documents_and_long_texts(spark):
    line = "Signed for Ada Byron at noon, mail ada@lab.example. "
    docs = spark.createDataFrame([(1, line), (1, line), (2, line * 3000), (3, None), (None, line)], "doc_id bigint, text string")
    lex = spark.createDataFrame([("Ada", "given"), ("Byron", "family")], "token string, role string")
    want = [("email", "ada@lab.example"), ("name", "Ada Byron")]
    got = [tuple(r) for r in pii.find_pii(docs, lex).collect()]
    assert sorted(got, key=str) == sorted([(i, *w) for i in (1, 2, None) for w in want], key=str)
    assert pii.find_pii(docs, lex, redacted=True).count() == 5


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    lex = spark.createDataFrame([], "token string, role string")
    assert pii.find_pii(docs, lex).count() == 0
