"""Operator 5 against a plain version of its definition, value by value, and its round trips."""

import datetime
import hashlib
import random

import pytest
import regex

from pumpline.llm import pii

D, L, U = pii.DIGITS, pii.LOWER, pii.UPPER
DAY0 = datetime.date(1, 1, 1)


def digest(kind, r, text):
    return hashlib.sha512(f"{pii.KEY}|{kind}|{r}|{text}|{pii.KEY}".encode()).hexdigest()


def moved(text, hexes, alphabets):
    out = []
    for i, c in enumerate(text):
        a = next((a for a in alphabets if c in a), None)
        out.append(a[(a.index(c) + int(hexes[(i % 32) * 4 : (i % 32) * 4 + 4], 16)) % len(a)] if a else c)
    return "".join(out)


def feistel(text, kind, alphabets):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for r in range(8):
        if r % 2 == 0:
            a = moved(a, digest(kind, r, b), alphabets)
        else:
            b = moved(b, digest(kind, r, a), alphabets)
    return a + b


def number(v, kind, size):
    a, b = divmod(v, size[1])
    for r in range(8):
        if r % 2 == 0:
            a = (a + int(digest(kind, r, b)[:8], 16)) % size[0]
        else:
            b = (b + int(digest(kind, r, a)[:8], 16)) % size[1]
    return a * size[1] + b


def walk(v, step, fits):
    v = step(v)
    while not fits(v):
        v = step(v)
    return v


def put(shape, values, chars):
    it = iter(values)
    return "".join(next(it) if c in chars else c for c in shape)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def parse(m):
    for at, order in (("-", "ymd"), (".", "dmy"), ("/", "mdy"), ("/", "dmy")):
        parts = m.split(at)
        if len(parts) == 3:
            try:
                return datetime.date(**{{"y": "year", "m": "month", "d": "day"}[k]: int(p) for k, p in zip(order, parts)}), at, order, [len(p) for p in parts]
            except ValueError:
                pass
    return None


def of_day(n):
    first, days = (datetime.date(1900, 1, 1) - DAY0).days, 17 * 4297
    if first <= n < first + days:
        return first + number(n - first, "date", pii.NEAR)
    v = number(n if n < first else n - days, "date-far", pii.FAR)
    return v if v < first else v + days


def date(m):
    day, at, order, widths = parse(m)
    narrow = {k: w == 1 for k, w in zip(order, widths)}
    back = at == "/" and order == "dmy"

    def fits(n):
        d = DAY0 + datetime.timedelta(n)
        return not (narrow["d"] and d.day > 9) and not (narrow["m"] and d.month > 9) and not (back and d.day < 13)

    d = DAY0 + datetime.timedelta(walk((day - DAY0).days, of_day, fits))
    return at.join(f"{d.year:04}" if k == "y" else str(x) if narrow[k] else f"{x:02}" for k, x in zip(order, [{"y": d.year, "m": d.month, "d": d.day}[k] for k in order]))


def ip(m):
    parts = m.split(".")
    leading = lambda ps: any(len(p) > 1 and p[0] == "0" for p in ps)
    if not leading(parts):
        v = number(int.from_bytes(bytes(map(int, parts))), "ip", (65536, 65536))
        return ".".join(map(str, v.to_bytes(4)))
    most = [{1: 10, 2: 100}.get(len(p), 256) for p in parts]

    def text(v):
        out = []
        for p, n in zip(reversed(parts), reversed(most)):
            v, x = divmod(v, n)
            out.insert(0, str(x).zfill(len(p)))
        return ".".join(out)

    v = 0
    for p, n in zip(parts, most):
        v = v * n + int(p)
    return text(walk(v, lambda x: number(x, "ip-zeros", (most[0] * most[1], most[2] * most[3])), lambda x: leading(text(x).split("."))))


def is_ssn(d):
    return not regex.match("000|666|9", d) and d[3:5] != "00" and d[5:] != "0000"


def phone(m):
    code = regex.match(r"^\+\d{1,3}(?=[ .(-])", m)
    code = code[0] if code else ""
    d = "".join(c for c in m[len(code) :] if c in D)
    amount, alphabet = int(digest("phone-first", 0, d[1:])[:4], 16), "23456789" if d[0] in "23456789" else "01"
    return code + put(m[len(code) :], alphabet[(alphabet.index(d[0]) + amount) % len(alphabet)] + feistel(d[1:], "phone", [D]), D)


def pseudonym(m):
    digits = "".join(c for c in m if c in D)
    whole = lambda kind: regex.fullmatch(pii.FORMS[kind], m)
    bare = m.replace(" ", "")
    if "@" in m:
        name, domain = m.split("@")
        return feistel(name, "email", [D, L, U]) + "@" + feistel(domain.rpartition(".")[0], "domain", [D, L, U]) + "." + domain.rpartition(".")[2]
    if whole("iban") and len(bare) <= 34 and mod97(bare[4:] + bare[:4]) == 1:
        b = feistel(bare[4:], "iban", [D, U])
        return put(m, bare[:2] + f"{98 - mod97(b + bare[:2] + '00'):02}" + b, D + U)
    if whole("ip") and all(int(p) < 256 for p in m.split(".")):
        return ip(m)
    if whole("date") and parse(m):
        return date(m)
    if whole("ssn") and is_ssn(digits):
        return put(m, walk(digits, lambda d: feistel(d, "ssn", [D]), is_ssn), D)
    if whole("card") and luhn(digits):
        body = feistel(digits[:-1], "card", [D])
        return put(m, next(body + x for x in D if luhn(body + x)), D)
    if whole("phone") and 7 <= len(digits) <= 15:
        return phone(m)
    if whole("secret"):
        prefix = regex.match(pii.PREFIX, m)
        if prefix:
            return prefix[0] + feistel(m[prefix.end() :], "secret", [D, L, U])
        if regex.search("[0-9]", m) and regex.search("[A-Fa-f]", m):
            return feistel(m, "secret", [D + ("abcdef" if regex.search("[a-f]", m) else "ABCDEF")])
    return None


def card(rng, n=16):
    body = "".join(rng.choice(D) for _ in range(n - 1))
    return next(body + x for x in D if luhn(body + x))


def iban(rng, land, n):
    b = "".join(rng.choice(D) for _ in range(n - 4))
    return f"{land}{98 - mod97(b + land + '00'):02}{b}"


def values(rng, n=12):
    """Values of every form."""
    pick = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    out = ["9999-12-31", "0001-01-01", "9990-01-01", "31.12.9999", "12/25/2024", "25/12/2024", "1.2.2024", "1/2/2024", "29/2/2024", "10.0.0.01", "0.0.0.0", "255.255.255.255", "192.168.001.010", "1.02.3.4"]
    for _ in range(n):
        d = datetime.date(rng.choice([rng.randint(1, 9999), rng.randint(1900, 2099)]), rng.randint(1, 12), rng.randint(1, 28))
        y = f"{d.year:04}"
        out += [d.isoformat(), f"{d.day}.{d.month}.{y}", f"{d.day:02}.{d.month:02}.{y}", f"{d.month}/{d.day}/{y}", f"{d.month:02}/{d.day:02}/{y}", f"{d.day}/{d.month}/{y}", f"{d.day:02}.{d.month}.{y}"]
        out += [".".join(str(rng.randint(0, 255)) for _ in range(4)), ".".join(str(rng.randint(0, 255)).zfill(rng.randint(1, 3)) for _ in range(4))]
        out += [f"{pick(L, 5)}.{pick(L + D, 4)}@{pick(L, 6)}.example.com", f"{rng.randint(100, 665):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}"]
        c = card(rng)
        out += [c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", card(rng, 13), card(rng, 19), iban(rng, "DE", 22), iban(rng, "NO", 15)]
        out += [f"({rng.randint(200, 999)}) 555-{pick(D, 4)}", f"+49 30 {pick(D, 4)} {pick(D, 3)}", f"{rng.randint(200, 999)}-555-{pick(D, 4)}"]
        out += ["a1" + pick(D + "abcdef", rng.choice([30, 38, 62, 126, 142, 1022])), "A1" + pick(D + "ABCDEF", 62), "AKIA" + pick(U + D, 16), "ghp_" + pick(L + U + D, 36), "sk_live_" + pick(L + D, 24)]
    return out


def test_values_equal_the_plain_version(spark, docs):
    given = values(random.Random(4))
    rows = {r.doc_id: r for r in pii.report(docs([f"see {v} here" for v in given])).collect()}
    for i, v in enumerate(given):
        want = pseudonym(v)
        assert want is not None and rows[i].text == f"see {want} here", v
        assert rows[i].n_replaced == 1
    there = pii.rewritten(docs([f"see {v} here" for v in given]))
    assert [r.text for r in pii.rewritten(there, inverse=True).orderBy("doc_id").collect()] == [f"see {v} here" for v in given]


def test_forms_stay(spark, docs):
    """Digits stay digits and so on, so that a pseudonym is found again as what it stands for."""
    given = values(random.Random(5), 4)
    shape = lambda t: regex.sub("[A-F]", "A", regex.sub("[a-f]", "a", regex.sub("[0-9]", "0", t)))
    rows = {r.doc_id: r for r in pii.report(docs(given)).collect()}
    for i, v in enumerate(given):
        assert len(rows[i].text) == len(v) or regex.fullmatch(pii.FORMS["ip"], v)
        if regex.fullmatch(pii.FORMS["date"], v) or regex.fullmatch(pii.FORMS["ssn"], v):
            assert shape(rows[i].text) == shape(v)
        if parse(v):
            assert parse(rows[i].text)[1:] == parse(v)[1:]


@pytest.mark.parametrize("show", [lambda d: f"{d.day}.{d.month}.{d.year:04}", lambda d: f"{d.month}/{d.day}/{d.year:04}", lambda d: f"{d.day}/{d.month}/{d.year:04}"])
def test_no_two_dates_share_a_pseudonym(spark, docs, show):
    given = [show(datetime.date(2023, 12, 1) + datetime.timedelta(i)) for i in range(500)]
    rows = [r.text for r in pii.rewritten(docs(given)).orderBy("doc_id").collect()]
    assert len(set(rows)) == len(set(given))


def test_documents_equal_the_plain_version(spark):
    """Whole texts, where no value runs into what follows it."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pattern = regex.compile(pii.PATTERN)
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for r in df.collect():
        text, n = r.text or "", 0

        def new(m):
            nonlocal n
            p = pseudonym(m[0])
            n += p is not None
            return m[0] if p is None else p

        want = pattern.sub(new, text)
        unmarked = all(pseudonym(m[0]) is not None or not regex.match(r"[A-Z]{2}\d\d|\d(?:[ -]?\d){12}", m[0]) for m in pattern.finditer(text))
        if unmarked:
            assert (got[r.doc_id].text or "") == want and got[r.doc_id].n_replaced == n
