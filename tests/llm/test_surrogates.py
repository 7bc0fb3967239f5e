"""Surrogates: nothing personal stays, formats stay, entities stay distinct and the same everywhere."""

from __future__ import annotations

import random

import pytest

from usertrail.llm import surrogates as S

KEY = b"test key"


@pytest.mark.parametrize("text, kinds", [
    ("mail the.27@mail6.example.com, now", ["email"]), ("THE.27@MAIL6.EXAMPLE.COM!!", ["email"]),
    ("jo.éà+x@mail-1.example.co.uk.", ["email"]), ("call +1 (017) 555-7713 or 555-123-4567", ["phone", "phone"]),
    ("from 240.56.125.154%%% it", ["ip"]), ("4929348385146306$$$ and 4111 1111 1111 1111", ["card", "card"]),
    ("ssn 123-45-6789.", ["ssn"]), ("DE89 3704 0044 0532 0130 00 x", ["iban"]),
    ('token = "f231efbfd1fdb295f161be24c505140eae764acc"', ["secret"]), ("Dear Mrs. Anna Schmidt and Иван Петров", ["name", "name"]),
    ("version 3.0, 12 monkeys, 2024", []), ("The and. Of", []), ("", []),
])
def test_kinds_and_formats(text, kinds):
    found = S.entities(text)
    assert [e[2] for e in found] == kinds
    new, replaced = S.replace(text, {}, KEY)
    assert replaced == kinds
    assert not any(e[3] in new for e in found)
    assert [e[2] for e in S.entities(new)] == kinds  # of the same type again
    for (_, _, kind, value, _), (_, _, _, other, _) in zip(found, S.entities(new)):
        if kind not in ("name", "ip"):
            assert [c.isdigit() for c in value if not c.isalnum() or kind != "secret"] == [
                c.isdigit() for c in other if not c.isalnum() or kind != "secret"]
            assert value.isupper() == other.isupper()


def test_gender_script_card_and_host():
    for gender, title in (("f", "Mrs"), ("m", "Herr")):
        new, _ = S.replace(f"{title} Kim Novak", {}, KEY)
        assert new.split(" ")[1] in S.GIVEN[gender, "LATIN"]
    new, _ = S.replace("Ольга Иванова", {}, KEY)
    assert new.split(" ")[0] in S.GIVEN["f", "CYRILLIC"] and S.script(new[-1]) == "CYRILLIC"
    valid, other = S.replace("4111111111111111 4111111111111112", {}, KEY)[0].split(" ")
    assert S.luhn(valid) and not S.luhn(other)
    a, b = S.replace("ann@corp.example.com bob@corp.example.com", {}, KEY)[0].split(" ")
    assert a.split("@")[1] == b.split("@")[1] and a != b
    # mentions of one entity stay one entity
    a, b = S.replace("+1 (017) 555-7713 and 1-017 555.7713"[:17] + " +1 017 555 7713", {}, KEY)[0].split(" +1 0", 1)[0], ""
    new, _ = S.replace("+1 (017) 555-7713 / +1 (017) 555 7713", {}, KEY)
    first, second = new.split(" / ")
    assert S.canonical("phone", first) == S.canonical("phone", second)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, kind string, th int")


def test_collisions_are_redrawn(spark):
    rng = random.Random(1)
    ips = sorted({".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(400)})
    rows = [(i % 50 if i % 50 else None, f"{a} and {rng.choice(ips)} and {a}") for i, a in enumerate(ips)]
    docs = frame(spark, rows)
    new = {}
    for r in S.replace_all(docs, KEY, bits=7).collect():  # 128 first draws for 400 entities
        before, after = r.doc.text.split(" and "), r.text.split(" and ")
        for a, b in zip(before, after):
            assert new.setdefault(a, b) == b  # the same everywhere
    assert len(set(new.values())) == len(new) == 400  # distinct
    assert not set(new.values()) & set(ips)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (None, "a@b.example"), (3, "a@b.example"), (3, "a@b.example"), (4, "x" * 100_000)]
    out = S.replace_all(frame(spark, rows), KEY).collect()
    assert len(out) == 6 and {r.text for r in out if r.doc.doc_id == 1} == {None}
    assert len({r.text for r in out if r.doc.text == "a@b.example"}) == 1
    assert S.replace_all(frame(spark, []), KEY).count() == 0


def test_query_hides_all(spark):
    from usertrail.llm.queries import op5_surrogates
    sf = "/root/testdata/sf0.001"
    new = {r.doc_id: r for r in op5_surrogates(spark, sf).collect()}
    n = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        found = S.entities(r.text)
        n += len(found)
        assert not any(e[3] in new[r.doc_id].text for e in found)
        if not found:
            assert new[r.doc_id].text == r.text
    assert n > 20


def test_formats_with_too_few_values_get_numbered_surrogates(spark):
    """More mail addresses with one letter than there are letters: all distinct, none left, the same everywhere."""
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåèéêëìíîïòó"
    mails = [f"{c}@corp.example.com" for c in letters] + ["anna@corp.example.com"]
    docs = frame(spark, [(i, f"write to {m} or {m}") for i, m in enumerate(mails)])
    found = [r.text.removeprefix("write to ").split(" or ") for r in S.replace_all(docs, KEY).select("text").collect()]
    assert all(a == b for a, b in found)
    new = {a for a, _ in found}
    assert len(new) == len(mails) and not new & set(mails)
    assert any(n.startswith("email-") for n in new) and any(n.endswith(".com") for n in new)
    assert S.render("card", "1234 5678", S.numbered("card", "12345678", "", KEY)).startswith("card-")


@pytest.mark.parametrize("text, kinds", [
    ("ISBN 9781234567897", []), ("order 1234567890123", []), ("4111 1111 1111 1112", ["card"]), ("Ines Ines Ines", []),
    ("fe80::1ff:2 at 12:30:45, std::dec", ["ip"]), ("my name is Priya Sharma", ["name"]), ("Regards,\nWei Chen", ["name"]),
    ("Dr Anna Keller. Keller said KELLER", ["name"] * 3), ("Keller said", []),
])
def test_what_is_an_entity(text, kinds):
    assert [e[2] for e in S.entities(text)] == kinds


def test_coreference_of_names_and_account_numbers():
    new, _ = S.replace("Mr Keller, Hugo Keller and Keller; Mr Kellner", {}, KEY)
    first, full, third = new.split("; ")[0].replace(" and ", ", ").split(", ")
    assert first.split(" ")[1] == full.split(" ")[1] == third != new.split(" ")[-1]
    new, _ = S.replace("DE89 3704 0044 0532 0130 00", {}, KEY)
    assert new[2:4] == S._check_digits("DE", new[4:].replace(" ", "")) and new != "DE89 3704 0044 0532 0130 00"


def test_one_gender_for_an_entity_and_hosts_apart(spark):
    hosts = [f"{a}{b}.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(1, "Dr Anna Kellerova"), (2, "Frau Anna Kellerova"), (3, "Dr Kim Novak"), (4, "Mr Kim Novak"), (5, "Mrs Kim Novak")]
    rows += [(10 + i, f"someone.{i}@{h}") for i, h in enumerate(hosts)]
    new = {r.doc.doc_id: r.text for r in S.replace_all(frame(spark, rows), KEY).select("doc", "text").collect()}
    assert new[1].removeprefix("Dr ") == new[2].removeprefix("Frau ")
    assert new[1].split(" ")[1] in S.GIVEN["f", "LATIN"]
    three = {new[k].split(" ", 1)[1] for k in (3, 4, 5)}
    assert len(three) == 3 and len({n.split(" ")[-1] for n in three}) == 1
    replaced = {h: new[10 + i].split("@")[1] for i, h in enumerate(hosts)}
    assert len(set(replaced.values())) == len(hosts) and not set(replaced.values()) & set(hosts)


def plain_rounds(known, bits, most=24):
    """{entity: (attempt, surrogate)} by a loop over a dict."""
    held = {e: (0, S.draw(*e, 0, KEY, bits, of)) for e, of in known.items()}
    real = {(e[0], e[1]) for e in known}
    for attempt in range(1, most + 1):
        first = {}
        for e, (at, s) in held.items():
            first[e[0], s] = min(first.get((e[0], s), (at, *e[1:])), (at, *e[1:]))
        lost = [e for e, (at, s) in held.items() if (e[0], s) in real or first[e[0], s] != (at, *e[1:])]
        for e in lost:
            held[e] = (attempt, S.draw(*e, attempt, KEY, bits, known[e]) if attempt < most else S.numbered(*e, KEY, known[e]))
    return {e: s for e, (_, s) in held.items()}


def test_query_against_a_plain_version(spark):
    """Texts made of known mentions: the whole is replaced as a loop over dicts replaces it."""
    rng = random.Random(5)
    titles = {"Mr": "m", "Mrs": "f", "Dr": ""}
    mentions = [("email", m, "") for m in {f"{rng.choice('abcdef')}{rng.choice('xyz')}@{rng.choice('pqrs')}{rng.choice('tu')}.org" for _ in range(60)}]
    mentions += [("ip", f"10.{rng.randrange(200)}.3.{rng.randrange(200)}", "") for _ in range(40)]
    mentions += [("name", f"{rng.choice(['Kim', 'Sascha', 'Robin'])} {rng.choice(['Ode', 'Uhl', 'Wix', 'Zak'])}", g) for g in ("m", "f", "", "m")
                 for _ in range(10)]
    docs = [[rng.choice(mentions) for _ in range(rng.randrange(4))] for _ in range(150)]
    title = {g: t for t, g in titles.items()}

    def text(mentioned):
        return " ~ ".join(f"{title[g]} {v}" if kind == "name" else v for kind, v, g in mentioned)

    genders = {}
    for kind, v, g in {m for d in docs for m in d if m[0] == "name" and m[2]}:
        genders.setdefault(v.lower(), set()).add(g)

    def settled(kind, v, g):
        of_name = genders.get(v.lower(), set())
        return kind, v.lower(), g or (min(of_name) if len(of_name) == 1 else "")

    used = {settled(*m) for d in docs for m in d}
    parts = {("host", c.split("@")[1], "") if k == "email" else ("surname", c.split(" ")[1], "") for k, c, _ in used if k != "ip"}
    bits = 5
    new_parts = plain_rounds(dict.fromkeys(parts), bits)
    new = plain_rounds({e: new_parts.get(("host", e[1].split("@")[-1], "")) or new_parts.get(("surname", e[1].split(" ")[-1], "")) for e in used}, bits)
    out = {r.doc.doc_id: r.text for r in S.replace_all(frame(spark, [(i, text(d)) for i, d in enumerate(docs)]), KEY, bits=bits).collect()}
    for i, d in enumerate(docs):
        expected = text([(kind, S.render(kind, v, new[settled(kind, v, g)]), g) for kind, v, g in d])
        assert out[i] == expected
    assert len(set(new.values())) == len(new)
