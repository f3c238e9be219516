import hashlib
import re

from quantloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def brute(text):
    out = []
    for o, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), o, kind, m.end()))
    return sorted(out)


def want(rows):
    out = []
    for d, t in rows:
        s = brute(t)
        out.append((d, *[sum(x[2] == k for x in s) for k in BASE], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in s).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert got(pii.find(docs)) == want([tuple(r) for r in docs.collect()])


EDGES = [
    (1, None),
    (2, ""),
    (3, "a@b.c.d@e.f_g@h.i  x@y.z."),
    (4, "é🙂 mail: a.b+c@d-e.fr, 1.2.3.4.5.6.7.8 and 256.1.1.1 0001.02.3.4"),
    (5, "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004"),
    (6, "+1 (555) 123-4567 +44 20 7946 0958 +1 2 +" + "1" * 9),
    (7, "1" * 20000),
    (8, "a" * 50000 + "@" + "b." * 5000),
    (9, "1 " * 9000),
    (10, "x@y.z" * 2000),
    (10, "x@y.z"),
    (None, "9.9.9.9+123456789@a.b"),
    (11, "+" * 500 + "(" * 20000),
    (12, "1.1.1.1@1.1.1.1"),
]


def test_edges(make):
    assert got(pii.find(make(EDGES))) == want(EDGES)
    assert got(pii.find(make([]))) == []


def test_added_kind_and_context(make):
    rows = [(1, "My IBAN is DE89 3704 0044 0532 0130 00 ok"), (2, "code DE89370400440532013001 x"), (3, "write to a@b.cd"), (4, "my mail: a@b.cd")]
    out = {r["doc_id"]: r for r in pii.find(make(rows)).collect()}
    assert out[1]["n_iban"] == 1 and "iban:11:38" in out[1]["spans"]
    assert out[2]["spans"] == "" and out[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (out[3]["scores"], out[4]["scores"]) == ("0.9", "1.0")


def test_context_decides_added_kinds(make):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'token = "{key}" x'), (2, f"sum {key} x"), (3, "SSN 078-05-1120"), (4, "part 078-05-1120"), (5, "ssn 000-12-3456"), (6, "secret " + "1" * 40), (7, f"secret {key}zz")]
    out = {r["doc_id"]: r["spans"] for r in pii.find(make(rows)).collect()}
    assert out == {1: "secret:9:49", 2: "", 3: "ssn:4:15", 4: "", 5: "", 6: "", 7: ""}


def test_stage_redacts(spark, make):
    rows = [(1, "call +1 (555) 123-4567 or a@b.cd now"), (2, "clean"), (3, None), (1, "call +1 (555) 123-4567 or a@b.cd now"), (None, "9.9.9.9")]
    out = pii.stage(spark, make(rows), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_chars"]) for r in out.collect()) == sorted([("1", "call [PHONE] or [EMAIL] now", 27)] * 2 + [("2", "clean", 5), ("3", "None", 0), ("None", "[IP]", 4)])


def test_an_iban_ends_where_its_country_says(spark, make):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000 EUR 500", "ID12 DE89 3704 0044 0532 0130 00 ok", "NO93 8601 1117 947 OSLO 12", "GB82 WEST 1234 5698 7654 32 AND MORE"]
    bad = ["DE89 3704 0044 0532 0130 01 BIC", "DE89370400440532013000X", "DE89 3704 0044 0532 0130"]
    out = {r["doc_id"]: r["n_iban"] for r in pii.find(make(list(enumerate(texts + bad)))).collect()}
    assert [out[k] for k in range(len(out))] == [1] * len(texts) + [0] * len(bad)
    assert pii.stage(spark, make([(1, texts[0])]), "").first()["text"] == "IBAN [IBAN] BIC COBADEFF"
