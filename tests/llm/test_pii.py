import random

from ranqa.llm import pii as P

KEY = b"k1"
VALID = {
    "email": ["und.34@mail7.example.com", "A.b-9@x.org", "éa1@mail.example.com"],
    "phone": ["+1 (017) 555-7713", "(017) 555-7713", "017-555-7713", "+1 212.555.0000"],
    "card": ["4845168114407329", "4845 1681 1440 7329", "378282246310005", "3782-822463-10005"],
    "ssn": ["123-45-6789", "899-99-9999"],
    "iban": ["DE89370400440532013000", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00",
             "GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034"],
    "ip": ["97.51.17.173", "0.0.0.0", "255.255.255.255"],
    "date": ["2024-02-29", "31.12.2099", "12/31/1999"],
}
LEFT = ["4845168114407328", "000-12-3456", "666-12-3456", "DE89370400440532013001", "256.1.1.1", "1.2.3", "2023-02-29",
        "31.04.2020", '"04dbebab91ab85687d33eeaaf9ac699e1188f962"', "2.0.", "555-7713", "x@y", "97.51.17.173.4",
        "DE89 3704 0044 0532 0130 01", "DE89 3704 0044 0532 0130", "DE89 3704 0044 0532 0130 00AB", "ZZ89 3704 0044 0532 0130 00",
        "2024-02-29Tea", "2024-02-30T10:00:00Z"]


def test_feistel_is_a_permutation():
    f = P.Feistel(KEY)
    for n in (1, 2, 3, 10, 97, 1000):
        out = [f.apply("x", x, n) for x in range(n)]
        assert sorted(out) == list(range(n))
        assert [f.apply("x", y, n, back=True) for y in out] == list(range(n))
    assert [f.apply("x", x, 1000) for x in range(1000)] != [P.Feistel(b"k2").apply("x", x, 1000) for x in range(1000)]


def test_pseudonyms_validate_link_and_invert():
    p, back = P.Pseudonymiser(KEY), P.Pseudonymiser(KEY, back=True)
    for kind, values in VALID.items():
        for v in values:
            new, found = p.text(f"see {v}, or")
            assert [f["kind"] for f in found] == [kind], (kind, v, found)
            put = new[4:-4]
            assert put != v and len(put) == len(v)
            assert [a if not a.isalnum() else a.isdigit() for a in put] == [a if not a.isalnum() else a.isdigit() for a in v]
            assert [f["kind"] for f in p.text(new)[1]] == [kind]  # still passes its check
            assert back.text(new)[0] == f"see {v}, or"
    digits = lambda s: "".join(c for c in s if c.isdigit())
    phones = [digits(p.text(v)[0])[-10:] for v in VALID["phone"][:3]]
    assert len(set(phones)) == 1  # the same number in other separators
    assert digits(p.text(VALID["card"][0])[0]) == digits(p.text(VALID["card"][1])[0])
    assert p.text(VALID["iban"][0])[0] == p.text(VALID["iban"][2])[0].replace(" ", "")
    for v in LEFT:
        assert p.text(f"a {v} b") == (f"a {v} b", [])
    rnd = random.Random(1)
    for _ in range(300):
        v = ".".join(str(rnd.randrange(256)) for _ in range(4))
        assert back.text(p.text(v)[0])[0] == v


def test_what_follows_a_value():
    p, back = P.Pseudonymiser(KEY), P.Pseudonymiser(KEY, back=True)
    date = p.text("2024-02-29")[0]
    assert p.text("at 2024-02-29T10:00:00Z.")[0] == f"at {date}T10:00:00Z."
    iban, card = p.text("BE68 5390 0754 7034")[0], p.text("4845 1681 1440 7329")[0]
    for after in (" EUR", " PAID NOW", " 12", ", then", " 4845 1681 1440 7329"):
        new, found = p.text(f"BE68 5390 0754 7034{after}")
        assert new.startswith(iban) and back.text(new)[0] == f"BE68 5390 0754 7034{after}"
    assert new == f"{iban} {card}" and [f["kind"] for f in found] == ["iban", "card"]
    assert found[1]["start"] == len(iban) + 1 and found[1]["length"] == len(card)
    for before in ("AB12", "BE12"):  # groups that look like an IBAN up to the card's end
        assert p.text(f"{before} 4845 1681 1440 7329") == (f"{before} {card}", [{"kind": "card", "start": 5, "length": len(card)}])


def test_other_digits_stay(spark):
    """Full-width and Arabic digits in the shapes of all kinds, beside a value that is found."""
    values = [v for kind in VALID if kind != "email" for v in VALID[kind]]
    tables = [str.maketrans("0123456789", "".join(chr(zero + i) for i in range(10))) for zero in (0xFF10, 0x660)]
    rows = [(i, f"a {v.translate(t)} b 97.51.17.173, {v[:-1]}{v[-1].translate(t)}", "x") for i, (v, t) in enumerate(
        (v, t) for v in values for t in tables)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    out = P.pseudonymise(docs, KEY)
    got = {r.doc_id: r for r in out.collect()}
    for i, text, _ in rows:
        assert "ip" in [f.kind for f in got[i].pii]
        assert got[i].text[:text.index(" b ")] == text[:text.index(" b ")]
    assert {r.doc_id: r.text for r in P.pseudonymise(out, KEY, back=True).collect()} == {r[0]: r[1] for r in rows}


def test_documents(spark):
    rows = [(1, "call +1 (017) 555-7713 or 97.51.17.173. now", "x"), (1, "call +1 (017) 555-7713 or 97.51.17.173. now", "x"),
            (2, None, "x"), (3, "", "x"), (None, "w " * 300_000 + "4845168114407329", "x"), (4, "plain", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    out = P.pseudonymise(docs, KEY)
    assert out.columns == ["doc_id", "text", "pii"]
    got = out.collect()
    assert [(r.doc_id, [f.kind for f in r.pii]) for r in got] == [
        (1, ["phone", "ip"]), (1, ["phone", "ip"]), (2, []), (3, []), (None, ["card"]), (4, [])]
    assert got[0] == got[1] and got[2].text is None and got[5].text == "plain"
    assert [(r.doc_id, r.text) for r in P.pseudonymise(out, KEY, back=True).collect()] == [(r[0], r[1]) for r in rows]
    assert P.pseudonymise(docs.limit(0), KEY).count() == 0


def test_query_counts_kinds(spark):
    r = P.op4_pii(spark, "/root/testdata/sf0.001").agg({"n_found": "sum", "n_card": "sum", "n_email": "sum"}).first()
    assert r["sum(n_card)"] > 0 and r["sum(n_email)"] > 0 and r["sum(n_found)"] >= r["sum(n_card)"] + r["sum(n_email)"]
