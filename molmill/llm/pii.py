"""Personal data: patterns propose spans, checksums confirm them, context words move their scores.

Four base kinds count by their pattern and check alone. Six more (IBAN, identity numbers of
the United States, Spain, France and Germany, phone numbers without a country code, birth
dates, IPv6 addresses) need a score of least_score; a kind's own score is what its
pattern and checksum are worth, and words near by raise or lower it. Every pattern takes
time in proportion to the text: those that could be tried again from every character of a
long run are anchored to the run's start.
"""

import datetime
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGITS = {i: None for i in range(128) if not 48 <= i <= 57}

# Patterns of the further kinds; a character that goes on before or after a number rules it out.
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?=[ A-Z0-9])")
_SSN = re.compile(r"[0-9](?<![0-9A-Za-z.-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_DNI = re.compile(r"[0-9XYZ](?<![0-9A-Za-z][0-9XYZ])[0-9]{7}-?[A-Z](?![0-9A-Za-z])")
_NIR = re.compile(r"[12](?<![0-9A-Za-z][12]) ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9A-Za-z])")
_TAX = re.compile(r"[1-9](?<![0-9A-Za-z][1-9])[0-9] ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}(?![0-9A-Za-z])")
_LOCAL_PHONE = re.compile(r"[(0-9](?<![0-9A-Za-z+.(-][(0-9])(?:(?<=\()[0-9]{2,5}\) ?|(?<=[0-9])[0-9]{1,4}[ ./-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])")
_DATE = re.compile(r"[0-9](?<![0-9A-Za-z./-][0-9])[0-9]?([./-])[0-9]{1,2}\1[0-9]{4}(?![0-9A-Za-z]|[./-][0-9])")
_IPV6 = re.compile(r"[0-9A-Fa-f:](?<![0-9A-Za-z:.][0-9A-Fa-f:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}+(?![0-9A-Za-z:])")

# The length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # fixed values: by the number modulo 23

# Kinds in order, each with its own score and the words near by that speak for it.
KINDS = {
    "email": (0.9, "email mail e-mail contact write correo courriel kontakt"),
    "ip": (0.6, "ip address host server login client adresse dirección serveur"),
    "card": (0.8, "card visa mastercard amex credit debit payment karte kreditkarte carte tarjeta paiement pago"),
    "phone": (0.8, "phone tel call fax mobile cell whatsapp telefon handy téléphone teléfono móvil portable"),
    "iban": (0.9, "iban account bank transfer konto compte cuenta"),
    "ssn": (0.4, "ssn social security"),
    "dni": (0.6, "dni nif nie documento identidad"),
    "nir": (0.7, "nir insee sécurité sociale assuré"),
    "tax_id": (0.3, "steuer steuernummer identifikationsnummer steuer-id tin idnr"),
    "local_phone": (0.3, "phone tel call fax mobile cell whatsapp telefon handy téléphone teléfono móvil portable"),
    "birth_date": (0.2, "born birth birthday dob geboren geburtsdatum né née naissance nacido nacida nacimiento"),
    "ipv6": (0.7, "ip address host server login client adresse dirección serveur"),
}
# Words that speak for a number of another sort.
AGAINST = frozenset("order invoice isbn issn version tracking serial model sku example bestellung rechnung commande facture pedido factura".split())
FOR = {kind: frozenset(words.split()) for kind, (_, words) in KINDS.items()}
ORDER = {kind: i for i, kind in enumerate(KINDS)}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(text: str) -> int:
    """The number that letters (A is 10) and digits spell, modulo 97."""
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban_end(text: str, start: int) -> int | None:
    """Where the IBAN that starts there ends: as many letters and digits as its country has, single spaces between, no more after, and mod-97 of 1."""
    n = IBAN_LENGTHS.get(text[start : start + 2])
    got, at = [], start
    while n and len(got) < n and at < len(text):
        if "0" <= text[at] <= "9" or "A" <= text[at] <= "Z":
            got.append(text[at])
        elif text[at] != " " or text[at - 1] == " ":
            return None
        at += 1
    if not n or len(got) < n or re.match("[0-9A-Za-z]", text[at : at + 1]):
        return None
    return at if mod97("".join(got[4:] + got[:4])) == 1 else None


def valid_ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def valid_dni(found: str) -> bool:
    body, letter = found[:8], found[-1]
    return DNI_LETTERS[int(body.translate(str.maketrans("XYZ", "012"))) % 23] == letter


def valid_nir(found: str) -> bool:
    s = found.replace(" ", "")
    number = s[:13].replace("2A", "19").replace("2B", "18")
    return 97 - int(number) % 97 == int(s[13:])


def valid_tax_id(found: str) -> bool:
    """ISO 7064 modulo 11, 10; of the first ten digits exactly one occurs more than once."""
    s = found.replace(" ", "")
    repeated = [s[:10].count(d) for d in set(s[:10])]
    left = 10
    for d in s[:10]:
        left = (int(d) + left) % 10 or 10
        left = left * 2 % 11
    return (11 - left) % 10 == int(s[10]) and sum(n > 1 for n in repeated) == 1


def valid_date(found: str) -> bool:
    day, month, year = map(int, re.split("[./-]", found))
    if month > 12 >= day:
        day, month = month, day
    try:
        return 1900 <= datetime.date(year, month, day).year <= 2100
    except ValueError:
        return False


def valid_ipv6(found: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(found)) and re.search("[0-9A-Fa-f]", found) is not None
    except ValueError:
        return False


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with a domain takes all characters of a name before it, back to the last address."""
    end = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        low = max(end, text.rfind("@", end, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at:
            end = m.end()
            yield start, end


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds: leftmost matches that do not overlap, without those that fail their check."""
    yield from (("email", a, b) for a, b in emails(text))
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (part.lstrip("0") or "0" for part in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].translate(_NO_DIGITS)) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
            yield "phone", m.start(), m.end()


def further_spans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IBAN.finditer(text):
        if end := iban_end(text, m.start()):
            yield "iban", m.start(), end
    for kind, pattern, valid in (
        ("ssn", _SSN, valid_ssn), ("dni", _DNI, valid_dni), ("nir", _NIR, valid_nir), ("tax_id", _TAX, valid_tax_id), ("local_phone", _LOCAL_PHONE, None), ("birth_date", _DATE, valid_date),
        ("ipv6", _IPV6, valid_ipv6),
    ):
        for m in pattern.finditer(text):
            if valid is None or valid(m[0]):
                yield kind, m.start(), m.end()


def score(text: str, kind: str, start: int, end: int, before: int = 60, after: int = 30, step: float = 0.3) -> float:
    """The kind's own score, a step more with a word for it near by, a step less with one against it."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - before) : start]) + _WORD.findall(text[end : end + after])}
    near |= {part for w in near for part in w.split("-")}
    moved = KINDS[kind][0] + step * bool(near & FOR[kind]) - step * bool(near & AGAINST)
    return round(min(1.0, max(0.0, moved)), 3)


def personal_spans(text: str | None, least_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), sorted by start, then kind; code points, end exclusive.

    Base spans stay whatever their score. Of the further ones those below least_score go,
    as do those that overlap a base span or a further one of a higher score (of equal
    ones the first stays).
    """
    if not text:
        return []
    out = [(*s, score(text, *s)) for s in base_spans(text)]
    more = [s for s in ((*s, score(text, *s)) for s in further_spans(text)) if s[3] >= least_score]
    taken: list[tuple[int, int]] = []  # disjoint and sorted
    for a, b in sorted((a, b) for _, a, b, _ in out):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for s in sorted(more, key=lambda s: (-s[3], s[1], ORDER[s[0]])):
        i = bisect_left(taken, (s[2],))  # the first that starts at its end or later
        if i == 0 or taken[i - 1][1] <= s[1]:
            out.append(s)
            taken.insert(i, (s[1], s[2]))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def find_pii(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, found (array of kind, start, end, score, value), sorted by start, then kind.

    Offsets are code points, end exclusive. Null and empty texts have none. Texts are
    searched whole, in time in proportion to their length; repeated rows are rows of their
    own; other columns are ignored; no rows give no rows.
    """
    names = ("kind", "start", "end", "score", "value")
    kind = docs.schema["doc_id"].dataType
    list_of = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True))))

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [[dict(zip(names, (*s, t[s[1] : s[2]]), strict=True)) for s in personal_spans(t, least_score)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, list_of)], names=["doc_id", "found"])

    found = T.StructField("found", T.ArrayType(T.StructType.fromDDL("kind string, start long, end long, score double, value string")))
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), found]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, most_certain (the highest score) of every row. Same rules as find_pii."""
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_pii(docs, least_score).select(
        "doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"),
        F.array_max(F.transform("found", lambda s: s["score"])).alias("most_certain"),
    )


def mask_pii(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """docs with every personal span of text replaced by its kind in angle brackets; of overlapping ones the first, or the longer, stands. Other columns stay."""

    def mask(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for kind, start, end, _ in sorted(personal_spans(text, least_score), key=lambda s: (s[1], -s[2])):
            if end > at:
                out += [text[at:start], f"<{kind}>"] if start >= at else []
                at = end
        return "".join([*out, text[at:]])

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array([mask(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
