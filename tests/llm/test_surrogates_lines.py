"""Surrogates and line templates: formats, distinctness, brute force, edges."""

import re

import pytest

from loadshape.llm import line_templates as L
from loadshape.llm import surrogates as P

TEXT = ("Mail anna.b@corp.com or call +49 (030) 555-1234, card 4111 1111 1111 1111, host 10.0.0.7. "
        "Mrs Anna Smith met Mr Smith; госпожа Иванова. api_key = \"abcdef0123456789abcd\" id 123-45-6789 "
        "DE89 3704 0044 0532 0130 00")


def test_mentions_and_formats():
    found = {kind for _, _, kind, _ in P.mentions(TEXT)}
    assert found == {"email", "phone", "card", "ip", "name-f", "name-", "secret", "ssn", "iban"}
    for _, _, kind, entity in P.mentions(TEXT):
        s = P.surrogate(kind, entity)
        assert s != entity and s == P.surrogate(kind, entity) and s != P.surrogate(kind, entity, key=b"other")
        if kind in ("card", "ssn", "phone", "iban"):
            assert re.sub(r"\d", "9", re.sub("[A-Z]", "A", s)) == re.sub(r"\d", "9", re.sub("[A-Z]", "A", entity))
    assert P._check_digit_holds(re.sub(r"\D", "", P.surrogate("card", "4111 1111 1111 1111")))
    assert re.fullmatch("[А-Я][а-я]+", P.surrogate("name-", "Иванова"))
    assert P.surrogate("name-f", "Anna").endswith("a") and P.surrogate("name-m", "John").endswith("n")
    assert list(P.mentions("version 1.2 of 2026, 100 words, 3.14.15")) == []


def test_replacement_is_consistent_and_complete(spark):
    rows = [(1, TEXT), (2, "again anna.b@corp.com and Smith, Mr Smith"), (3, None), (4, ""), (None, "10.0.0.7"), (1, TEXT), (5, "no data " * 9000)]
    df = spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, doc_id long, n_email int")
    got = P.replace_private(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[3].text == "" and by[5].text == rows[-1][1] and by[5].n_replaced == 0
    assert "anna.b@corp.com" not in by[1].text and "4111" not in by[1].text
    assert by[1].n_email == by[2].n_email == 1 and by[1].n_person == 4
    mail = re.search(r"\S+@\S+", by[1].text)[0]
    assert mail in by[2].text
    person = P.surrogate("name-", "Smith")
    assert by[1].text.count(person) == 2 and f"Mr {person}" in by[2].text
    assert by[None].text in by[1].text and len({r.text for r in got if r.doc_id == 1}) == 1
    assert P.replace_private(df.limit(0)).count() == 0


def test_clashing_surrogates_are_resolved(spark, monkeypatch):
    # a space of 30 first choices for 60 entities, and one surrogate that is itself an entity
    real = P.surrogate
    monkeypatch.setattr(P, "surrogate", lambda kind, entity, attempt=0, key=P.KEY: f"10.0.{attempt}.{int(entity.split('.')[3]) % 30}")
    found = spark.createDataFrame([("ip", f"9.9.9.{i}") for i in range(60)] + [("ip", "10.0.1.5")], "kind string, entity string")
    rows = P.resolve(found).collect()
    assert len(rows) == 61 and len({r.surrogate for r in rows}) == 61
    assert not {r.surrogate for r in rows} & {r.entity for r in rows}
    monkeypatch.setattr(P, "surrogate", real)


def test_exceptions_reach_the_documents(spark, monkeypatch):
    texts = [f"host 9.9.9.{i} up" for i in range(40)] + ["9.9.9.1 and 9.9.9.31"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few = {("ip", f"9.9.9.{i}"): f"8.8.8.{i % 30}" for i in range(40)}
    real = P.surrogate
    monkeypatch.setattr(P, "surrogate", lambda kind, entity, attempt=0, key=P.KEY: few[kind, entity] if not attempt else real(kind, entity, attempt, key))
    rows = {r.doc_id: r.text for r in P.replace_private(df).collect()}
    out = [re.search(r"\S+\.\S+", rows[i])[0] for i in range(40)]
    assert len(set(out)) == 40
    assert rows[40] == f"{out[1]} and {out[31]}"


LINES = [(1, "user 17 logged in from berlin\nunique words stand here alone today\nshort one\n"),
         (2, "user 99 logged in from paris\nother unique content goes here now"),
         (3, "user 5 logged in from rome\n\n  \n"), (4, None), (5, ""), (None, "user 6 logged in from berlin"), (6, "short one"), (7, "short one"),
         (8, "short one"), (9, "All rights reserved by us."), (10, "All rights reserved by us.\nx"), (11, "All rights reserved by us."),
         (12, "All rights reserved by me."), (13, "All rights reserved by us.\nAll rights reserved by us.")]


def test_line_templates(spark):
    df = spark.createDataFrame([(t, i, 1) for i, t in LINES], "text string, doc_id long, line int")
    got = {r.doc_id: r for r in L.drop_templates(df).collect()}
    assert len(got) == len(LINES)
    # a null id comes first, so its login line stays and the other three go
    assert got[None].n_dropped == 0
    assert got[1].kept_text == "unique words stand here alone today\nshort one\n"
    assert got[2].kept_text == "other unique content goes here now" and got[3].kept_text == "\n  \n"
    assert [got[i].n_dropped for i in (4, 5, 6, 7, 8)] == [0] * 5
    assert got[9].n_dropped == 0 and got[10].kept_text == "x" and got[11].n_dropped == 1 and got[12].n_dropped == 1
    assert got[13].n_dropped == 2 and got[13].kept_text == ""
    assert L.drop_templates(df.limit(0)).count() == 0


def test_two_documents_are_not_recurring(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert [r.n_dropped for r in L.drop_templates(df).collect()] == [0, 0, 0]
    more = df.unionByName(spark.createDataFrame([(3, "a b c 9 e")], df.schema))
    assert sorted((r.doc_id, r.n_dropped) for r in L.drop_templates(more).collect()) == [(1, 0), (1, 0), (2, 1), (3, 1)]


@pytest.mark.parametrize("kind", ["card", "ip", "email", "name-m"])
def test_surrogates_rarely_clash(kind):
    sample = {"card": "4111111111{:06d}", "ip": "10.1.{}.7", "email": "user{}@corp.com", "name-m": "John{}"}[kind]
    out = [P.surrogate(kind, sample.format(i)) for i in range(200)]
    assert len(set(out)) > 190


def test_many_short_addresses_get_distinct_surrogates(spark):
    found = spark.createDataFrame([("email", f"1@a{i}.com") for i in range(300)] + [("phone", f"+1 00 {i:02}") for i in range(100)]
                                  + [("secret", "_" * 16)], "kind string, entity string")
    rows = P.resolve(found).collect()
    assert len(rows) == 401 == len({(r.kind, r.surrogate) for r in rows})
    assert not {r.surrogate for r in rows} & {r.entity for r in rows}


def test_untitled_names_grouped_phones_and_key_words():
    def found(text):
        return [(kind, entity) for _, _, kind, entity in P.mentions(text)]

    smith = [("name-m", "John"), ("name-", "Smith")]
    assert found("Mr John Smith met Ann Lee. Smith said, and Lee too; Blacksmith, Smithson") == [
        *smith, ("name-f", "Ann"), ("name-", "Lee"), ("name-", "Smith"), ("name-", "Lee")]
    assert found("Smith came. Then Mary Ann Lee and Mr Smith") == [
        ("name-", "Smith"), ("name-f", "Mary"), ("name-f", "Ann"), ("name-", "Lee"), ("name-", "Smith")]
    assert found("John came to Berlin City") == []
    for phone in ("555-123-4567", "030 5551234", "555.123.4567", "06 12 34 56 78", "0049 30 555123"):
        assert found(f"call {phone}, now") == [("phone", phone)]
    assert found("on 2024-01-15 or 01-02-2024, 0.123456 of 01.2024; 12 345 678, 192-168-1") == []
    for text in ("API_KEY=abcdef0123456789abcd", "Password: abcdef0123456789abcd", 'x "Token": "abcdef0123456789abcd"'):
        assert found(text) == [("secret", "abcdef0123456789abcd")]


def test_a_leaf_has_several_templates(spark):
    def line(*tail):
        return " ".join(["we use cookies", *tail])

    same = line(*(f"s{chr(97 + k)}" for k in range(17)))
    alone = [line(*(f"{x}{chr(97 + k)}" for k in range(17))) for x in "pqr"]
    vary = [line(*(f"t{chr(97 + k)}" for k in range(14)), *(f"{x}{c}" for c in "abc")) for x in "uvw"]
    two = ["all of it x y"] * 4 + ["all of it z w"] * 4             # two recurring lines, nothing in common behind the lead
    short = ["all rights reserved here", "all rights reserved there", "all rights reserved nowhere"]
    texts = [same] * 5 + alone + vary + two + short
    got = {r.doc_id: r.n_dropped for r in L.drop_templates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [0, 1, 1, 1, 1] + [0] * 3 + [0, 1, 1] + [0, 1, 1, 1] * 2 + [0] * 3
