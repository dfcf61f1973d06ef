"""Operator 5: format-preserving pseudonyms for personal data and secrets.

Method: a value that passes its format's validation is permuted within that format by a keyed Feistel
network, so equal values get equal pseudonyms in every document and different values different ones.

* Characters: the value's letters and digits fall into two halves.  In each of 8 rounds, each character
  of one half moves within its own alphabet by an amount that SHA-512 derives from the key, the kind, the
  round and the other half; then the halves change places.
* card numbers: the digits but the last, which is then the Luhn digit.  IBAN: all after the check digits,
  which are then computed.  Social security numbers: walked along the permutation's cycle to the next
  valid one.  Phone numbers: the national digits, where a first digit from 2 to 9 stays in that range.
* dates: the day's number among those of 1900 to 2099, or among all others up to 9999, by the same network over two
  digits of a mixed radix; walked on to the next day that the written form can show: as many digits for day and
  month, and day first only where it can't be read as month first.
* addresses of four numbers: their 32 bits; those with leading zeros within numbers of the same numbers of digits, walked on
  to the next with a leading zero.
* e-mail addresses: the part before the @ and the domain but its last label.  Keys of hexadecimal
  digits, of any length: within those digits.  Tokens with a known prefix: the characters behind it.

Texts are scanned by one pattern; only DataFrame functions are used, and rows don't move.  Where digits or capitals
follow a card number or an IBAN, the pattern takes them in: of what it found, the part up to a separator that is valid
counts (an IBAN of its country's length, a card in one of the usual groupings, else the longest), and the scan goes on
behind it.

Defined results: null text stays null with counts of 0; an empty text stays empty; texts are scanned
whole at any length; repeated rows each give a row; an empty table gives an empty table.  `rewritten`
keeps all the given columns.  The key is a parameter of the query and so is visible in its plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pumpline.llm.quality import let

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROUNDS = 8
#: Steps of a walk: a permutation's longest way back into the smallest form (a fifth of all days) is some fifty.
WALK = 400
#: Days of 1900 to 2099, and of the other years from 1 to 9999, as products of two factors.
NEAR, FAR = (17, 4297), (170, 21_053)
KEY = "pumpline-pseudonyms"
KINDS = ("email", "iban", "ip", "date", "ssn", "card", "phone", "secret")
#: What stands before and behind a value; a date may have a time behind it.
HEAD, TAIL = r"(?<![\p{L}\p{N}_])", r"(?:(?![\p{L}\p{N}_])|(?<=\d{4}-\d{2}-\d{2})(?=[Tt]\d{2}:?\d{2}))"
FORMS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-](?:[A-Za-z0-9.-]*[A-Za-z0-9-])?\.[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ip": r"(?<!\d\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "date": r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "card": r"\d(?:[ -]?\d){12,18}",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}[.-]\d{3}[.-]\d{4}",
    "secret": r"[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36,}+|[rs]k_live_[A-Za-z0-9]{16,}+|AIza[0-9A-Za-z]{35}",
}
#: What a token begins with.
PREFIX = r"^(?:AKIA|gh[oprsu]_|[rs]k_live_|AIza)"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20
EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21
LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24
TR26 UA29 VA22 VG24 XK20""".split()}
#: How cards are usually written: in one run, in fours (not if three digits more follow), or as 4, 6 and 4 or 5.
USUAL_CARD = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?!\1\d{3}$)|\d{4}([ -])\d{6}\2\d{4,5})(?!\d)"
#: Characters that are in no text: one that a text lacks marks where a value ends.
MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]
PATTERN = HEAD + "(?:" + "|".join(f"(?:{FORMS[k]})" for k in KINDS) + ")" + TAIL


def _digest(key: str, kind: str | Column, round_: Column, text: Column) -> Column:
    name = F.concat(F.lit(f"{key}|"), kind, F.lit("|")) if isinstance(kind, Column) else F.lit(f"{key}|{kind}|")
    return F.sha2(F.concat(name, round_.cast("string"), F.lit("|"), text, F.lit(f"|{key}")), 512)


def _moved(text: Column, digest: Column, alphabets: list[str], way: int) -> Column:
    """Each character moved within its alphabet; amounts are the digest's 4-digit groups, used again after 32."""

    def one(c: Column, i: Column) -> Column:
        amount = F.conv(F.substring(digest, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        out = None
        for a in alphabets:
            turned = _turned(a, c, amount, way)
            out = F.when(F.lit(a).contains(c), turned) if out is None else out.when(F.lit(a).contains(c), turned)
        return out.otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _turned(alphabet: str, c: Column, amount: Column, way: int) -> Column:
    place = F.instr(F.lit(alphabet), c) - 1
    return F.substring(F.lit(alphabet), F.pmod(place + amount * way, F.lit(len(alphabet))) + 1, F.lit(1))


def permuted(text: Column, kind: str, key: str, alphabets: list[str], inverse: bool = False) -> Column:
    """A bijection on the strings with the same alphabet at each place."""
    way, steps = (-1, F.sequence(F.lit(ROUNDS - 1), F.lit(0))) if inverse else (1, F.sequence(F.lit(0), F.lit(ROUNDS - 1)))

    def go(t: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.substring(t, F.lit(1), half).alias("a"), F.substring(t, half + 1, F.length(t)).alias("b"))

        def step(s: Column, r: Column) -> Column:
            even = F.struct(_moved(s["a"], _digest(key, kind, r, s["b"]), alphabets, way).alias("a"), s["b"].alias("b"))
            odd = F.struct(s["a"].alias("a"), _moved(s["b"], _digest(key, kind, r, s["a"]), alphabets, way).alias("b"))
            return F.when(r % 2 == 0, even).otherwise(odd)

        return let(F.aggregate(steps, start, step), lambda s: F.concat(s["a"], s["b"]))

    return let(text, go)


def permuted_number(value: Column, kind: str | Column, key: str, size: tuple[Column | int, Column | int], inverse: bool = False) -> Column:
    """A bijection on 0 .. a * b - 1 for size (a, b), by its two digits of that radix."""
    way, steps = (-1, F.sequence(F.lit(ROUNDS - 1), F.lit(0))) if inverse else (1, F.sequence(F.lit(0), F.lit(ROUNDS - 1)))
    a, b = (x.cast("bigint") if isinstance(x, Column) else F.lit(x).cast("bigint") for x in size)

    def turn(x: Column, other: Column, r: Column, most: Column) -> Column:
        return F.pmod(x + F.conv(F.substring(_digest(key, kind, r, other.cast("string")), 1, 8), 16, 10).cast("bigint") * way, most)

    def go(v: Column) -> Column:
        start = F.struct(F.floor(v / b).cast("bigint").alias("a"), F.pmod(v, b).alias("b"))
        step = lambda s, r: F.when(r % 2 == 0, F.struct(turn(s["a"], s["b"], r, a).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), turn(s["b"], s["a"], r, b).alias("b")))
        return let(F.aggregate(steps, start, step), lambda s: s["a"] * b + s["b"])

    return let(value.cast("bigint"), go)


def walked(value: Column, step, fits) -> Column:
    """The first of step(value), step(step(value)), ... that fits: a bijection on the values that fit, if step is one."""
    on = lambda s, _: F.when(s["done"], s).otherwise(let(step(s["v"]), lambda v: F.struct(v.alias("v"), fits(v).alias("done"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(value.alias("v"), F.lit(False).alias("done")), on)["v"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _laid_out(shape: Column, values: Column, pattern: str) -> Column:
    """shape with its characters of the pattern replaced, in order, by those of values."""
    at = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), f"[^{pattern}]", ""))
    return F.array_join(F.transform(F.filter(F.split(shape, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike(f"[{pattern}]"), F.substring(values, at(i), F.lit(1))).otherwise(c)), "")


def _remainder_97(text: Column) -> Column:
    number = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), F.pmod(r * 10 + number(c), F.lit(97))).otherwise(F.pmod(r * 100 + number(c), F.lit(97))))


def _card(m: Column, key: str, inverse: bool) -> Column:
    body = lambda d: permuted(F.substring(d, F.lit(1), F.length(d) - 1), "card", key, [DIGITS], inverse)
    full = lambda p: F.concat(p, F.get(F.filter(F.array(*[F.lit(x) for x in DIGITS]), lambda x: F.call_function("luhn_check", F.concat(p, x))), F.lit(0)))
    return let(_digits(m), lambda d: let(let(body(d), full), lambda v: _laid_out(m, v, "0-9")))


def _iban(m: Column, key: str, inverse: bool) -> Column:
    def whole(x: Column) -> Column:
        bban = permuted(F.substring(x, F.lit(5), F.length(x)), "iban", key, [DIGITS, UPPER], inverse)
        land = F.substring(x, 1, 2)
        return let(bban, lambda b: F.concat(land, F.lpad((98 - _remainder_97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))

    return let(F.replace(m, F.lit(" "), F.lit("")), lambda x: let(whole(x), lambda v: _laid_out(m, v, "0-9A-Z")))


def _is_ssn(d: Column) -> Column:
    return ~d.rlike("^(000|666|9)") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    step = lambda d: permuted(d, "ssn", key, [DIGITS], inverse)
    return let(walked(_digits(m), step, _is_ssn), lambda v: _laid_out(m, v, "0-9"))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    """The country code stays; so does whether a number's first national digit is from 2 to 9."""
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)

    def national(c: Column) -> Column:
        tail = F.substring(m, F.length(c) + 1, F.length(m))

        def new(d: Column) -> Column:
            first, rest = F.substring(d, 1, 1), F.substring(d, F.lit(2), F.length(d))
            # The first digit moves by an amount that the rest gives, and the rest is permuted by itself.
            amount = lambda r: F.conv(F.substring(_digest(key, "phone-first", F.lit(0), r), 1, 4), 16, 10).cast("int")
            turned = lambda r: F.when(first.rlike("[2-9]"), _turned("23456789", first, amount(r), -1 if inverse else 1)).otherwise(_turned("01", first, amount(r), -1 if inverse else 1))
            return let(permuted(rest, "phone", key, [DIGITS], inverse), lambda p: F.concat(turned(p if inverse else rest), p))

        return let(_digits(tail), lambda d: let(new(d), lambda v: F.concat(c, _laid_out(tail, v, "0-9"))))

    return let(code, national)


def _ip(m: Column, key: str, inverse: bool) -> Column:
    parts = F.split(m, "\\.")
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n * 256 + p.cast("bigint"))
    shown = lambda v: F.concat_ws(".", *[F.pmod(F.floor(v / (256**k)), F.lit(256)).cast("bigint").cast("string") for k in (3, 2, 1, 0)])

    def zeros(p: Column) -> Column:
        """Within numbers of as many digits."""
        at = [F.get(p, F.lit(i)) for i in range(4)]
        most = [F.when(F.length(x) == 1, 10).when(F.length(x) == 2, 100).otherwise(256).cast("bigint") for x in at]
        value = ((at[0].cast("bigint") * most[1] + at[1].cast("bigint")) * most[2] + at[2].cast("bigint")) * most[3] + at[3].cast("bigint")
        digits = lambda v: [F.floor(v / (most[1] * most[2] * most[3])), F.pmod(F.floor(v / (most[2] * most[3])), most[1]), F.pmod(F.floor(v / most[3]), most[2]), F.pmod(v, most[3])]
        text = lambda v: F.concat_ws(".", *[F.lpad(d.cast("bigint").cast("string"), F.length(x), F.lit("0")) for d, x in zip(digits(v), at)])
        step = lambda v: permuted_number(v, "ip-zeros", key, (most[0] * most[1], most[2] * most[3]), inverse)
        return let(walked(value, step, lambda v: text(v).rlike(LEADING)), text)

    return F.when(m.rlike(LEADING), let(parts, zeros)).otherwise(let(permuted_number(number, "ip", key, (1 << 16, 1 << 16), inverse), shown))


#: A number with a leading zero among those of an address.
LEADING = r"(?:^|\.)0\d"


def _day_first(m: Column) -> Column:
    """Whether a slashed date can only be read as day first."""
    return m.contains("/") & F.try_to_date(m, "M/d/yyyy").isNull()


def _day_of(m: Column) -> Column:
    return F.coalesce(
        F.when(m.contains("-"), F.try_to_date(m, "yyyy-MM-dd")),
        F.when(m.contains("."), F.try_to_date(m, "d.M.yyyy")),
        F.when(m.contains("/"), F.coalesce(F.try_to_date(m, "M/d/yyyy"), F.try_to_date(m, "d/M/yyyy"))),
    )


def _date(m: Column, key: str, inverse: bool) -> Column:
    """A slashed date is read as month first where that is a date; the new one is written as the old one was."""
    zero = F.lit("0001-01-01").cast("date")
    first, days = -zero_day("1900-01-01"), NEAR[0] * NEAR[1]

    def of_day(n: Column) -> Column:
        """n: days since the first of the year 1."""
        def moved(s: Column) -> Column:
            near = s["near"]
            size = tuple(F.when(near, F.lit(x)).otherwise(F.lit(y)) for x, y in zip(NEAR, FAR))
            new = permuted_number(s["v"], F.when(near, F.lit("date")).otherwise(F.lit("date-far")), key, size, inverse)
            return let(new, lambda v: F.when(near, v + first).when(v < first, v).otherwise(v + days))

        near = n.between(first, first + days - 1)
        return let(F.struct(near.alias("near"), F.when(near, n - first).when(n < first, n).otherwise(n - days).alias("v")), moved)

    day = lambda n: F.date_add(zero, n.cast("int"))
    narrow = lambda x, group: F.length(F.regexp_extract(m, x, group)) == 1
    dotted, slashed, back = m.contains("."), m.contains("/"), _day_first(m)
    # Whether day and month are written with one digit.
    head, next_ = narrow(r"^(\d+)\D", 1) & ~m.contains("-"), narrow(r"^\d+\D(\d+)\D", 1) & ~m.contains("-")
    short_day, short_month = F.when(dotted | back, head).otherwise(next_), F.when(dotted | back, next_).otherwise(head)

    def fits(n: Column) -> Column:
        return let(day(n), lambda d: (~short_day | (F.dayofmonth(d) < 10)) & (~short_month | (F.month(d) < 10)) & (~back | (F.dayofmonth(d) > 12)))

    def shown(d: Column) -> Column:
        number = lambda x, short: F.when(short, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))
        of_day_, of_month, year = number(F.dayofmonth(d), short_day), number(F.month(d), short_month), F.lpad(F.year(d).cast("string"), 4, "0")
        return (
            F.when(dotted, F.concat_ws(".", of_day_, of_month, year))
            .when(slashed & back, F.concat_ws("/", of_day_, of_month, year))
            .when(slashed, F.concat_ws("/", of_month, of_day_, year))
            .otherwise(F.concat_ws("-", year, of_month, of_day_))
        )

    return let(let(walked(F.datediff(_day_of(m), zero).cast("bigint"), of_day, fits), day), shown)


def zero_day(day: str) -> int:
    """Days from the given one back to the first of the year 1, as a number below 0."""
    from datetime import date

    return 1 - date.fromisoformat(day).toordinal()


def _email(m: Column, key: str, inverse: bool) -> Column:
    shift = lambda x, part: permuted(x, part, key, [DIGITS, LOWER, UPPER], inverse)
    domain = F.regexp_extract(m, r"@(.*)\.[^.]*$", 1)
    return F.concat(shift(F.substring_index(m, "@", 1), "email"), F.lit("@"), shift(domain, "domain"), F.lit("."), F.substring_index(m, ".", -1))


def _secret(m: Column, key: str, inverse: bool) -> Column:
    low, high = (permuted(m, "secret", key, [a], inverse) for a in (DIGITS + "abcdef", DIGITS + "ABCDEF"))
    prefix = F.regexp_extract(m, PREFIX, 0)
    token = F.concat(prefix, permuted(F.substring(m, F.length(prefix) + 1, F.length(m)), "secret", key, [DIGITS, LOWER, UPPER], inverse))
    return F.when(m.rlike(PREFIX), token).when(m.rlike("[a-f]"), low).otherwise(high)


def _is_iban(m: Column) -> Column:
    iban = F.replace(m, F.lit(" "), F.lit(""))
    return m.rlike("^[A-Z]{2}[0-9]{2}") & (F.length(iban) <= 34) & (_remainder_97(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))) == 1)


def _is_card(m: Column) -> Column:
    return m.rlike(f"^(?:{FORMS['card']})$") & F.call_function("luhn_check", _digits(m))


def _end(m: Column) -> Column:
    """The length of the valid card number or IBAN that a match begins with; the match's own for all others."""
    size = F.length(m)
    before = lambda i: F.substring(m, F.lit(1), i)
    ends = F.filter(F.sequence(F.lit(13), size), lambda i: before(i).rlike("[A-Z0-9]$") & ~F.substring(m, i + 1, F.lit(1)).rlike("[A-Z0-9]"))
    longest_first = F.reverse(ends)
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    known = F.coalesce(lengths[F.substring(m, 1, 2)], F.lit(0))
    long = lambda i: F.length(F.replace(before(i), F.lit(" "), F.lit("")))
    of_country = F.filter(ends, lambda i: long(i) == known)
    ibans = F.concat(of_country, F.filter(longest_first, lambda i: (i == size) | ((known == 0) & (long(i) >= 15))))
    usual = F.length(F.regexp_extract(m, USUAL_CARD, 0))
    cards = F.concat(F.filter(ends, lambda i: i == usual), longest_first)
    first = lambda found, valid: F.get(F.filter(found, lambda i: valid(before(i))), F.lit(0))
    iban, card = m.rlike(f"^(?:{FORMS['iban']})$"), m.rlike(f"^(?:{FORMS['card']})$")
    return F.when(iban & (size >= 13), F.coalesce(first(ibans, _is_iban), size)).when(card, F.coalesce(first(cards, _is_card), size)).otherwise(size)


def _matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _marked(text: Column, mark: Column) -> Column:
    """The text with a mark behind each value that its match goes beyond."""

    def round_(s: Column) -> Column:
        one = lambda m: let(_end(m), lambda e: F.when(e < F.length(m), F.concat(F.substring(m, F.lit(1), e), mark, F.substring(m, e + 1, F.length(m)))).otherwise(m))
        join = lambda t, found: F.array_join(F.zip_with(F.split(t, PATTERN, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        new = join(s["text"], F.transform(_matches(s["text"]), one))
        return let(new, lambda t: F.struct(t.alias("text"), (t == s["text"]).alias("done")))

    # What follows a value may hold others, so rounds go on until one changes nothing; a value has 13 characters at least.
    rounds = F.sequence(F.lit(0), F.floor(F.length(text) / 13).cast("int"))
    start = F.struct(text.alias("text"), F.lit(False).alias("done"))
    return F.aggregate(rounds, start, lambda s, _: F.when(s["done"], s).otherwise(round_(s)))["text"]


def _found(m: Column, key: str, inverse: bool) -> Column:
    """(kind, pseudonym) of a match; kind is null, and the match stays, where validation fails."""
    whole = lambda kind: m.rlike(f"^(?:{FORMS[kind]})$")
    cases = [
        ("email", m.contains("@"), _email),
        ("iban", _is_iban(m), _iban),
        ("ip", whole("ip") & ~F.exists(F.split(m, "\\."), lambda p: p.cast("int") > 255), _ip),
        ("date", whole("date") & _day_of(m).isNotNull(), _date),
        ("ssn", whole("ssn") & _is_ssn(_digits(m)), _ssn),
        ("card", _is_card(m), _card),
        ("phone", whole("phone") & F.length(_digits(m)).between(7, 15), _phone),
        ("secret", whole("secret") & (m.rlike(PREFIX) | (m.rlike("[0-9]") & m.rlike("[A-Fa-f]"))), _secret),
    ]
    out = None
    for kind, valid, make in cases:
        value = F.struct(F.lit(kind).alias("kind"), make(m, key, inverse).alias("new"))
        out = F.when(valid, value) if out is None else out.when(valid, value)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new")))


def _scanned(text: Column, key: str, inverse: bool) -> Column:
    """(text, kinds): the text with its pseudonyms, and the kind of each."""
    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    free = F.get(F.filter(F.array(*[F.lit(c) for c in MARKS]), lambda c: ~text.contains(c)), F.lit(0))
    beyond = F.exists(_matches(text), lambda m: _end(m) < F.length(m))

    def replaced(s: Column) -> Column:
        def join(found: Column) -> Column:
            kinds = F.filter(F.transform(found, lambda x: x["kind"]), lambda k: k.isNotNull())
            new = let(F.split(s["text"], PATTERN, -1), lambda p: F.array_join(F.zip_with(p, found, lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit("")))), ""))
            return F.struct(F.when(s["mark"].isNull(), new).otherwise(F.replace(new, s["mark"], F.lit(""))).alias("text"), kinds.alias("kinds"))

        return let(F.transform(_matches(s["text"]), lambda m: _found(m, key, inverse)), join)

    marked = let(F.when(beyond, free), lambda c: F.struct(F.when(c.isNull(), text).otherwise(_marked(text, c)).alias("text"), c.alias("mark")))
    return F.when(text.rlike("[0-9@]"), let(marked, replaced)).otherwise(none)


def _with_found(docs: DataFrame, text_col: str, key: str, inverse: bool) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("found", F.when(F.col("text").isNotNull(), _scanned(F.col("text"), key, inverse)))


def rewritten(docs: DataFrame, text_col: str = "text", key: str = KEY, inverse: bool = False) -> DataFrame:
    """The rows with all their columns, the text's values replaced by pseudonyms, or by the values again."""
    rows = _with_found(docs, text_col, key, inverse)
    return rows.select(*[F.col("found.text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """Per row: id, the new text and how many values of each kind were replaced."""
    rows = _with_found(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", key, False)
    kinds = F.coalesce(F.col("found.kinds"), F.array().cast("array<string>"))
    count = lambda kind: F.size(F.filter(kinds, lambda k: k == F.lit(kind)))
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return rows.select("row.doc_id", F.col("found.text").alias("text"), F.size(kinds).alias("n_replaced"), *counts)


def op5_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
