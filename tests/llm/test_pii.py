import hashlib
import random
import re
import time

from optara.llm import pii


def brute(text):
    """Base spans, straight from the contract."""
    t = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]

    def passes(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and passes(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


CASES = ["a@b.c", "a@b", "x..y@-.-", "1.2.3.4.5", "256.1.1.1 1.1.1.1", "0001.2.3.4", "00000000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111114111111111111111", "+1 (413) 555-2866", "+1234567", "+12 34 56 78.", "é@x.yz 日本 1.1.1.1", ".".join("9" * 5000), "4" * 5000, "", None]


def test_base_spans_match_contract(documents):
    for t in CASES + [r["text"] for r in documents.collect()]:
        assert pii.base_spans(t or "") == brute(t)


def test_digests_and_added_spans(spark, awkward, empty):
    rows = {r["doc_id"]: r for r in pii.scan(awkward, redacted=True).collect()}
    r = rows[11]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    text = "mail a.b@c.example.org ip 10.0.0.1 card 4111 1111 1111 1111 call +1 (413) 555-2866"
    assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute(text)).encode()).hexdigest()
    assert r["redacted"] == "mail <email> ip <ip> card <card> call <phone>"
    assert rows[3]["base_sha256"] == rows[4]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[3]["spans"] == ""
    assert pii.scan(empty).count() == 0 and pii.scan(awkward).count() == awkward.count()


def test_validators_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert [s.kind for s in pii.find("iban GB82 WEST 1234 5698 7654 32 end")] == ["iban"]
    assert [s.kind for s in pii.find("tel 030 123 456 78")] == ["national_phone"] and pii.find("total 030 123 456 78") == []
    assert [s.kind for s in pii.find("amex card 3782 822463 10005")] == ["short_card"] and pii.find("number 3782 822463 10005") == []
    plain, near = pii.find("x 10.0.0.1")[0].score, pii.find("server ip 10.0.0.1")[0].score
    assert near > plain


def test_iban_before_another_word():
    found = lambda t: [t[s:e] for k, s, e in pii.added_spans(t) if k == "iban"]
    for t in ("ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "DE89 3704 0044 0532 0130 00"):
        for after in ("", " BIC", " USA", " OK", " A1", " ABCD EFGH", ".", " und"):
            assert found(f"to {t}{after}") == [t]
    assert found("AT61 1904 3002 3457 3201 ES91 2100 0418 4502 0005 1332 OK") == ["AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332"]
    assert found("ES9121000418450200051333 BIC") == found("ES9121000418450200051332Q") == []


def test_added_spans_match_their_patterns(documents):
    """The linear proposals against the plain patterns."""
    national = re.compile(r"(?:\([0-9]{2,5}\)\x20?|0)[0-9]+(?:[\x20.-][0-9]+)+")

    def plain(t):
        return [("national_phone", m.start(), m.end()) for m in national.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 13 and t[max(0, m.start() - 1) : m.start()] not in tuple("0123456789+.-")]

    rng = random.Random(8)
    made = ["".join(rng.choices("0012 .-(a)+", k=rng.randint(1, 40))) for _ in range(4000)]
    made += ["(030) 123 456 78", "50123 0456 789", "(12)0345 678 90", "((030) 12 34 56 78", "00 00", "0 12 34 56 78"]
    for t in made + [r["text"] or "" for r in documents.collect()]:
        assert pii.national_spans(t) == plain(t), t
    mixed = ["".join(rng.choices("ab.@1-_ ", k=rng.randint(1, 40))) for _ in range(4000)] + ["".join(rng.choices("0125.5", k=rng.randint(1, 40))) for _ in range(4000)]
    for t in mixed:
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_take_linear_time():
    n = 1_000_000
    runs = ["a" * n + " x@b.co", "a" * n + "@", "@" * n, "a@" * (n // 2), "a@b." * (n // 4), "1." * (n // 2), "1" * n, "0" * n + ")", "(" * n + "0" * n, "(00)" * (n // 4), "0 " * (n // 2), "1 1-" * (n // 4), "+1" * (n // 2), "+" + "1(" * (n // 2), "A" * n, "AA00" * (n // 4), "ES91 " * (n // 5), "sk_live_" * (n // 8)]
    for t in runs:
        began = time.process_time()
        pii.find(t)
        assert time.process_time() - began < 5, t[:20]
    many = " ".join(f"a{i}@b.co iban GB82 WEST 1234 5698 7654 32" for i in range(20_000))
    began = time.process_time()
    assert len(pii.find(many)) == 40_000 and time.process_time() - began < 15


def test_taken_places():
    rng = random.Random(3)
    for _ in range(300):
        spans = [(s, s + rng.randint(1, 6)) for s in (rng.randint(0, 40) for _ in range(10))]
        taken, plain = pii.Taken(spans[:4]), spans[:4]
        for s, e in spans[4:]:
            free = all(b <= s or a >= e for a, b in plain)
            assert taken.add(s, e) == free
            plain += [(s, e)] * free
