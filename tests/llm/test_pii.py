import hashlib
import random
import re
import time

import pytest
from helpers import AWKWARD, docs, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from molmill.llm.pii import KINDS, base_spans, find_pii, iban_end, luhn, mask_pii, personal_spans, pii_digest, valid_date, valid_dni, valid_nir, valid_ssn, valid_tax_id

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_base(text):
    """The contract's patterns as they are written."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and plain_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def base_of(text):
    return [s[:3] for s in personal_spans(text) if s[0] in PATTERNS]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "a", "Z9", "1", "255", "256", "0", "00", "4", " ", "-", "+", "(", ")", "é", "%", "_", "\n", "4111111111111111", "1.2.3.4", "a@b.c", "+1 (555) 010-1234"]), max_size=30).map("".join))
def test_base_is_what_the_patterns_find(text):
    assert base_of(text) == plain_base(text)


def test_base_over_whole_documents(spark):
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    frame = docs(spark, given + AWKWARD).selectExpr("*", "1 as found", "2 as spans")
    want = []
    for i, text in given + AWKWARD:
        base = plain_base(text)
        want.append((i, *(sum(k == x for x, _, _ in base) for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    got = pii_digest(frame)
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    assert sum(sum(w[1:5]) for w in want) > 50
    assert rows(got, "doc_id", "spans") == sorted(((i, ",".join(f"{k}:{a}:{b}" for k, a, b, _ in personal_spans(t))) for i, t in given + AWKWARD), key=repr)
    assert pii_digest(docs(spark, [])).count() == 0


def test_checks():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and all(luhn(s) == plain_luhn(s) for s in map(str, range(10**14, 10**14 + 200)))
    assert iban_end("DE89 3704 0044 0532 0130 00 BIC", 0) == 27 and iban_end("DE88 3704 0044 0532 0130 00", 0) is None and iban_end("GB82WEST12345698765432", 0) == 22
    assert iban_end("DE89 3704 0044 0532 0130 001", 0) is None and iban_end("ZZ89 3704", 0) is None and iban_end("DE89  3704 0044 0532 0130 00", 0) is None
    assert valid_dni("12345678Z") and not valid_dni("12345678A") and valid_dni("X1234567L")
    assert valid_nir("2 55 08 14 168 025 38") and not valid_nir("2 55 08 14 168 025 39")
    assert valid_tax_id("86095742719") and valid_tax_id("47036892816") and not valid_tax_id("47036892817") and not valid_tax_id("12345678903")
    assert valid_ssn("123-45-6789") and not valid_ssn("666-45-6789") and not valid_ssn("900-45-6789")
    assert valid_date("31.12.1999") and valid_date("12/31/1999") and not valid_date("31.02.1999") and not valid_date("1.1.1800")


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 BIC", ["iban"]), ("Serial DE89 3704 0044 0532 0130 01", []), ("Her SSN is 123-45-6789.", ["ssn"]), ("order 123-45-6789", []), ("123-45-6789", []),
        ("DNI 12345678Z", ["dni"]), ("DNI 12345678A", []), ("NIR 2 69 05 49 588 157 80", ["nir"]), ("Steuer-ID 86 095 742 719", ["tax_id"]), ("86 095 742 719", []), ("call (212) 555-0123 now", ["local_phone"]),
        ("pages 212 555-0123 now", []), ("born 31.12.1999 in", ["birth_date"]), ("on 31.12.1999 in", []), ("né le 01/02/1980", ["birth_date"]), ("host 2001:db8::1 up", ["ipv6"]), ("at 12:30:45 he", []), ("std::vector", []),
        ("card 4111 1111 1111 1111, mail a.b@c.example.org, call +44 20 7946 0958, 10.0.0.1", ["card", "email", "phone", "ip"]),
    ],
)
def test_further_kinds_and_context(text, kinds):
    assert [s[0] for s in personal_spans(text)] == kinds


def test_scores_follow_context():
    one = lambda t: personal_spans(t)[0][3]
    assert one("credit card 4111111111111111") > one("xx 4111111111111111") > one("order 4111111111111111") and all(0 <= one(t) <= 1 for t in ("mail a@b.c", "order a@b.c"))


def test_spans_do_not_overlap_unless_both_are_base():
    rng = random.Random(5)
    parts = ["DE89 3704 0044 0532 0130 00", "123-45-6789", "ssn ", "iban ", "call ", "212 555-0123", "+1 212 555 0123", "4111111111111111", " ", "born ", "31.12.1999", "a@b.c", "1.2.3.4", "86095742719"]
    for _ in range(500):
        spans = personal_spans("".join(rng.choice(parts) for _ in range(12)))
        assert spans == sorted(spans, key=lambda s: (s[1], list(KINDS).index(s[0])))
        for i, a in enumerate(spans):
            for b in spans[i + 1 :]:
                assert a[2] <= b[1] or (a[0] in PATTERNS and b[0] in PATTERNS)


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1 " * 500_000, "1.1" * 300_000, "@a.b " * 200_000, "a@" * 400_000, "+1" + " " * 10**6, "+1" * 400_000, "(1" * 400_000, "A1" * 400_000, ":a" * 400_000, "12/" * 300_000, "a@" + "b-" * 400_000, "GB82 " * 200_000, "a@b.c " * 100_000], ids=lambda t: t[:6])
def test_time_follows_length(text):
    began = time.perf_counter()
    personal_spans(text)
    assert time.perf_counter() - began < 15


def test_find_and_mask(spark):
    frame = docs(spark, [(1, "é mail a@b.c or 10.0.0.1"), (2, None), (3, ""), (4, "x")])
    found = {r.doc_id: [(s.kind, s.value) for s in r.found] for r in find_pii(frame).collect()}
    assert found == {1: [("email", "a@b.c"), ("ip", "10.0.0.1")], 2: [], 3: [], 4: []}
    masked = mask_pii(frame)
    assert masked.schema == frame.schema and {r.doc_id: r.text for r in masked.collect()} == {1: "é mail <email> or <ip>", 2: None, 3: "", 4: "x"}


def test_base_spans_alone():
    assert sorted(base_spans("a@b@c.d 999.1.1.1.1.1.1")) == [("email", 2, 7)]
