"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations, in DataFrame functions alone.

Numbers and dates are recognised by pattern, validated, and mapped to another valid value of the same form: a card number
keeps its length, spacing, first digit and a right check digit; an IBAN its country, spacing, letters and right check digits; a
telephone number a possible area and exchange, or behind a plus its country's code and length; a social security number a possible
area, group and serial; an address of IP version 4 four octets, one of version 6 in full eight groups; a date, year first or
last, with one-digit days or the month's English name, stays a day of the same 400 years (1800-2199, those before, and so on;
only before the year 200 and after 9799 dates stay), and a time behind it stays. Each kind is a permutation of its values under the key, so equal values stay linked
across documents and different ones apart. What only looks alike (a wrong check digit, 31 April, an octet of 300) is left as it is.

A value is a pair (a, b) of numbers below A and B; round r makes it (b, (a + f(r, b)) mod A) with the sizes exchanged, f being
48 bits of a keyed SHA-256. ``ROUNDS`` is even, so the sizes are back in place.

E-mail addresses are permuted letter by letter: the two halves of the local part, and of the host's name, shift each other's letters
and digits in turn by a keyed digest, so addresses of equal form stay apart. Secrets (access keys, values of ``password=`` or
``token =``; behind a bare colon only what has a digit or a capital inside, since words may follow a colon) have no form to keep
but their length. They become keyed digests, which link alike. Empty and null texts stay as they are; every row and column
is kept, and repeated rows give repeated results. No pattern repeats a group without bound, so a text of any length is matched
in one walk and without recursion. Addresses of version 6 with ``::`` are left as they are.

The key comes from the caller, or with ``session_key`` from the session's setting ``KEY_SETTING``. Who has it can undo the numbers;
``TEST_KEY``, which stands in where a local session sets nothing, is public, so on a cluster a secret one is drawn for the session.
"""

from __future__ import annotations

import secrets
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import free_name, quoted

KEY_SETTING = "spark.lacuna.pseudonym.key"
TEST_KEY = "pseudonym-key-1"
ROUNDS = 8

_L, _R = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: The months, and the country codes of two digits (1 and 7 have one, all others three).
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
TWO_DIGIT_CODES = (20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98)
#: (kind, pattern). The first that matches at a place counts.
PATTERNS = (
    ("secret", r"(?i:(?:password|passwd|pwd|secret|token|api_?key)\x20?)(?:=\x20?[\"']?|:\x20?(?:[\"']|(?=[A-Za-z_+/\-]*+[0-9]|[A-Z_+/\-]*+[a-z_+/\-]++[A-Z])))[0-9A-Za-z_+/\-]{8,}+"),
    ("access_key", _L + r"AKIA[0-9A-Z]{16}" + _R),
    ("email", r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]++@[0-9A-Za-z.-]*(?<=[0-9A-Za-z-])\.[A-Za-z]{2,}+"),
    ("iban", _L + r"[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}+|(?:\x20[0-9A-Z]{4}){2,7}+(?:\x20[0-9A-Z]{1,3}+)?+)" + _R),
    ("phone", r"(?:(?<![0-9A-Za-z+])\+?1[ .-]?)?(?:\([2-9][0-9]{2}\)\x20?|(?<![0-9A-Za-z])[2-9][0-9]{2}[.-])[2-9][0-9]{2}[ .-][0-9]{4}" + _R),
    ("world_phone", r"(?<![0-9A-Za-z+])\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6}+" + _R),
    ("ssn", _L + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _R),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])"),
    ("ip6", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("date", _L + r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:" + _R + r"|(?=T[0-9]{2}:[0-9]{2}))"),
    ("late_year", r"(?<![0-9A-Za-z./])[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)[0-9]{4}(?![./]?[0-9A-Za-z])"),
    ("short_date", r"(?<![0-9A-Za-z./])[0-9]{1,2}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/)[0-9]{4}(?![./]?[0-9A-Za-z])"),
    ("named_month", _L + r"(?:[0-9]{1,2}\x20(?:" + "|".join(MONTHS) + r")\x20[0-9]{4}|(?:" + "|".join(MONTHS) + r")\x20[0-9]{1,2},\x20[0-9]{4})" + _R),
    ("card", _L + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _R),
)
ANY = "|".join(p for _, p in PATTERNS)
#: What each of the patterns needs somewhere: a text without it is left alone, without a walk for each pattern.
NEEDED = "[0-9@=:]|AKIA[A-Z]"
#: The 400 years from 1800 on have 146097 = 189 * 773 days, and so have all others; days from the year 200 to 9799.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
CYCLES = (-4, 19)


def _digest(key: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def permuted(key: str, kind: str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """A struct (a, b): the pair's place under the keyed permutation of size_a * size_b pairs."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), size_a.cast("long").alias("m"), size_b.cast("long").alias("n"))

    def turn(s: Column, r: Column) -> Column:
        f = F.conv(F.substring(_digest(key, kind, r, s["b"]), 1, 12), 16, 10).cast("long")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + f, s["m"]).alias("b"), s["n"].alias("m"), s["m"].alias("n"))

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, turn)


def _number(key: str, kind: str, value: Column, size_a: Column, size_b: Column) -> Column:
    """The permuted number below size_a * size_b."""
    s = permuted(key, kind, (value - F.pmod(value, size_b)) / size_b, F.pmod(value, size_b), size_a, size_b)
    return F.transform(F.array(s), lambda x: x["a"] * size_b + x["b"])[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum; with ``doubled_last`` of digits to which a check digit is still to be added."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(F.pmod(i, F.lit(2)) == (0 if doubled_last else 1), twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i))


def _refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits, from left to right, replaced by others."""
    return F.aggregate(
        F.filter(F.split(shape, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )["out"]


def _decimal(key: str, kind: str, digits: Column) -> Column:
    """The digits permuted among all numbers of as many digits; at most 30."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
    s = permuted(key, kind, F.substr(digits, F.lit(1), n - low).cast("long"), F.coalesce(F.substr(digits, n - low + 1, low).try_cast("long"), F.lit(0)), size(n - low), size(low))
    return F.transform(F.array(s), lambda x: F.concat(F.lpad(x["a"].cast("string"), n - low, F.lit("0")), F.when(low > 0, F.lpad(x["b"].cast("string"), low, F.lit("0"))).otherwise(F.lit(""))))[0]


def _mod97(characters: Column) -> Column:
    """The number that digits, and letters from A = 10 on, make, modulo 97."""

    def add(s: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), F.pmod(s * 10 + c.try_cast("int"), F.lit(97))).otherwise(F.pmod(s * 100 + letter, F.lit(97)))

    return F.aggregate(F.filter(F.split(characters, ""), lambda c: c != ""), F.lit(0), add)


def _iban(key: str, m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, rest = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain) - 4)
    digits = _digits(rest)
    body = _refill(rest, _decimal(key, "iban", digits))
    whole = F.transform(F.array(body), lambda x: F.concat(country, F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))[0]
    # spaces back in their places, letters and digits from the new number
    spaced = F.transform(F.array(whole), lambda w: F.rtrim(F.regexp_replace(w, "(.{4})", "$1 ")))[0]
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(rest, F.substr(plain, F.lit(1), F.lit(4)))) == 1) & (F.length(digits) > 0)
    return F.when(valid, F.when(m.contains(" "), spaced).otherwise(whole)).otherwise(m)


def _world_phone(key: str, m: Column) -> Column:
    """The country's code stays, and so does a zero in brackets, which is no part of the number from abroad."""
    shape = F.replace(m, F.lit("(0)"), F.lit("(#)"))
    digits = _digits(shape)
    first = F.substr(digits, F.lit(1), F.lit(2))
    code = F.when(first.startswith("7"), 1).when(first.isin(*map(str, TWO_DIGIT_CODES)), 2).otherwise(3)
    number = F.substr(digits, code + 1, F.length(digits) - code)
    new = _refill(shape, F.concat(F.substr(digits, F.lit(1), code), _decimal(key, "world_phone", number)))
    return F.when(F.length(digits).between(9, 15), F.replace(new, F.lit("(#)"), F.lit("(0)"))).otherwise(m)


def _ip6(key: str, m: Column) -> Column:
    g = [F.conv(F.split(m, ":")[i], 16, 10).cast("long") for i in range(8)]
    parts = [F.transform(F.array(permuted(key, f"ip6-{i}", g[i], g[i + 1], F.lit(65536), F.lit(65536))), lambda x: F.concat(F.lower(F.conv(x["a"].cast("string"), 10, 16)), F.lit(":"), F.lower(F.conv(x["b"].cast("string"), 10, 16))))[0] for i in (0, 2, 4, 6)]
    return F.concat_ws(":", *parts)


def _late_year(key: str, m: Column) -> Column:
    """Day first where that is a date, else month first."""
    mark, a, b, year = F.substr(m, F.lit(3), F.lit(1)), F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(7), F.lit(4))
    day_first, month_first = F.concat_ws("-", year, b, a), F.concat_ws("-", year, a, b)
    ok = F.try_to_date(day_first, "yyyy-MM-dd").isNotNull()
    given = F.when(ok, day_first).otherwise(month_first)
    new = F.transform(F.array(_date(key, given)), lambda x: F.concat(F.when(ok, F.substr(x, F.lit(9), F.lit(2))).otherwise(F.substr(x, F.lit(6), F.lit(2))), mark, F.when(ok, F.substr(x, F.lit(6), F.lit(2))).otherwise(F.substr(x, F.lit(9), F.lit(2))), mark, F.substr(x, F.lit(1), F.lit(4))))[0]
    return F.when(F.try_to_date(given, "yyyy-MM-dd").isNotNull(), new).otherwise(m)


def _card(key: str, m: Column) -> Column:
    digits = _digits(m)
    inner = F.length(digits) - 2
    low = F.floor(inner / 2)
    ten = F.lit(10.0)
    size_b, size_a = F.pow(ten, low).cast("long"), F.pow(ten, inner - low).cast("long")
    body = F.substr(digits, F.lit(2), inner).cast("long")
    new = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lpad(_number(key, "card", body, size_a, size_b).cast("string"), inner, F.lit("0")))
    whole = F.transform(F.array(new), lambda x: F.concat(x, F.pmod(-_luhn(x, True), F.lit(10)).cast("string")))[0]
    return F.when(F.pmod(_luhn(digits, False), F.lit(10)) == 0, _refill(m, whole)).otherwise(m)


def _phone(key: str, m: Column) -> Column:
    digits = _digits(m)
    ten = F.substr(digits, F.length(digits) - 9, F.lit(10))
    area, exchange, line = (F.substr(ten, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (4, 3), (7, 4)))
    s = permuted(key, "phone", (area - 200) * 800 + (exchange - 200), line, F.lit(640000), F.lit(10000))
    new = F.transform(F.array(s), lambda x: F.concat(F.floor(x["a"] / 800) + 200, F.pmod(x["a"], F.lit(800)) + 200, F.lpad(x["b"].cast("string"), 4, "0")))[0]
    return _refill(m, F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), new))


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    s = permuted(key, "ssn", place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))
    back = lambda p: p + 1 + F.when(p >= 665, 1).otherwise(0)
    new = F.transform(F.array(s), lambda x: F.concat(F.lpad(back(F.floor(x["a"] / 99)).cast("string"), 3, "0"), F.lit("-"), F.lpad((F.pmod(x["a"], F.lit(99)) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((x["b"] + 1).cast("string"), 4, "0")))[0]
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, new).otherwise(m)


def _ip(key: str, m: Column) -> Column:
    o = [F.split(m, r"\.")[i].cast("int") for i in range(4)]
    s = permuted(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    new = F.transform(F.array(s), lambda x: F.concat_ws(".", *[(F.floor(x[h] / 256) if k == 0 else F.pmod(x[h], F.lit(256))).cast("string") for h in "ab" for k in (0, 1)]))[0]
    valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
    return F.when(valid, new).otherwise(m)


def _date(key: str, m: Column) -> Column:
    day = F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    cycle = F.floor(day / (DAYS[0] * DAYS[1]))
    moved = _number(key, "date", F.pmod(day, F.lit(DAYS[0] * DAYS[1])).cast("long"), F.lit(DAYS[0]), F.lit(DAYS[1]))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), (moved + cycle * (DAYS[0] * DAYS[1])).cast("int")).cast("string")
    return F.when(cycle.between(*CYCLES), new).otherwise(m)


def _short_date(key: str, m: Column) -> Column:
    """Like ``_late_year``, for days or months of one digit; what begins with a zero or is below ten with one digit is written so again."""
    part = lambda k: F.regexp_extract(m, r"^([0-9]+)([./])([0-9]+)[./]([0-9]+)$", k)
    two = lambda x: F.lpad(x, 2, "0")
    bare = lambda x: x.cast("int").cast("string")
    day_first, month_first = F.concat_ws("-", part(4), two(part(3)), two(part(1))), F.concat_ws("-", part(4), two(part(1)), two(part(3)))
    ok = F.try_to_date(day_first, "yyyy-MM-dd").isNotNull()
    given = F.when(ok, day_first).otherwise(month_first)
    day, month = (lambda x: bare(F.substr(x, F.lit(9), F.lit(2)))), (lambda x: bare(F.substr(x, F.lit(6), F.lit(2))))
    new = F.transform(F.array(_date(key, given)), lambda x: F.concat(F.when(ok, day(x)).otherwise(month(x)), part(2), F.when(ok, month(x)).otherwise(day(x)), part(2), F.substr(x, F.lit(1), F.lit(4))))[0]
    return F.when(F.try_to_date(given, "yyyy-MM-dd").isNotNull(), new).otherwise(m)


def _named_month(key: str, m: Column) -> Column:
    months = F.array(*map(F.lit, MONTHS))
    month = F.array_position(months, F.regexp_extract(m, "[A-Z][a-z]+", 0)).cast("string")
    day, year = F.regexp_extract(m, r"\b([0-9]{1,2})\b", 1), F.regexp_extract(m, "[0-9]{4}", 0)
    given = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    name = lambda x: F.element_at(months, F.substr(x, F.lit(6), F.lit(2)).cast("int"))
    number = lambda x: F.substr(x, F.lit(9), F.lit(2)).cast("int").cast("string")
    late = lambda x: F.substr(x, F.lit(1), F.lit(4))
    new = F.transform(F.array(_date(key, given)), lambda x: F.when(m.rlike("^[0-9]"), F.concat_ws(" ", number(x), name(x), late(x))).otherwise(F.concat(name(x), F.lit(" "), number(x), F.lit(", "), late(x))))[0]
    return F.when(F.try_to_date(given, "yyyy-MM-dd").isNotNull(), new).otherwise(m)


def _written(key: str, kind: str, value: Column) -> Column:
    """The lower-case letters and digits of ``value`` permuted, each staying a letter or a digit: two halves shift each other in turn."""
    characters = F.filter(F.split(value, ""), lambda c: c != "")
    half = lambda c: F.floor(F.size(c) / 2).cast("int")
    start = F.transform(F.array(characters), lambda c: F.struct(F.slice(c, F.lit(1), half(c)).alias("a"), F.slice(c, half(c) + 1, F.size(c) - half(c)).alias("b")))[0]

    def shifted(c: Column, by: Column) -> Column:
        turned = lambda first, n: F.char(F.pmod(F.ascii(c) - first + by, F.lit(n)) + first)
        return F.when(c.between("a", "z"), turned(97, 26)).when(c.between("0", "9"), turned(48, 10)).otherwise(c)

    def turn(s: Column, r: Column) -> Column:
        bytes_ = F.repeat(_digest(key, kind, r, F.array_join(s["b"], "")), F.ceil(F.size(s["a"]) / 32).cast("int") + 1)
        moved = F.transform(F.arrays_zip(s["a"].alias("c"), F.sequence(F.lit(0), F.size(s["a"])).alias("i")), lambda x: F.when(x["c"].isNotNull(), shifted(x["c"], F.conv(F.substr(bytes_, x["i"] * 2 + 1, F.lit(2)), 16, 10).cast("int"))))
        return F.struct(s["b"].alias("a"), F.filter(moved, lambda c: c.isNotNull()).alias("b"))

    out = F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, turn)
    return F.transform(F.array(out), lambda s: F.concat(F.array_join(s["a"], ""), F.array_join(s["b"], "")))[0]


def _alike(key: str, kind: str, value: Column) -> Column:
    """A keyed digest in hexadecimal, as long as the value."""
    base = _digest(key, kind, value)
    return F.substr(F.repeat(base, F.ceil(F.length(value) / 64).cast("int")), F.lit(1), F.length(value))


def _email(key: str, m: Column) -> Column:
    local, host = F.split(F.lower(m), "@")[0], F.split(F.lower(m), "@")[1]
    name = F.regexp_extract(host, r"^(.*)(\.[a-z]+)$", 1)
    return F.concat(_written(key, "email", local), F.lit("@"), _written(key, "host", name), F.regexp_extract(host, r"(\.[a-z]+)$", 1))


def _secret(key: str, m: Column) -> Column:
    value = F.regexp_extract(m, r"[0-9A-Za-z_+/\-]{8,}$", 0)
    return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), _alike(key, "secret", value))


def _access_key(key: str, m: Column) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(_alike(key, "access_key", F.substr(m, F.lit(5), F.lit(16)))))


_MAKERS = {"secret": _secret, "access_key": _access_key, "email": _email, "iban": _iban, "phone": _phone, "world_phone": _world_phone, "ssn": _ssn, "ip": _ip, "ip6": _ip6, "date": _date, "late_year": _late_year, "short_date": _short_date, "named_month": _named_month, "card": _card}


def _renamed(key: str, m: Column) -> Column:
    chosen = None
    for kind, pattern in PATTERNS:
        hit = m.rlike(f"^(?:{pattern})$")
        chosen = F.when(hit, _MAKERS[kind](key, m)) if chosen is None else chosen.when(hit, _MAKERS[kind](key, m))
    return chosen.otherwise(m)


def session_key(spark: SparkSession) -> str:
    """The key that the session's setting ``KEY_SETTING`` gives; without one a local session takes ``TEST_KEY``.

    A cluster's session then draws a secret key and keeps it in the setting, with a warning: its pseudonyms are linked with one
    another, but not with those of other sessions.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key and not spark.sparkContext.master.startswith("local"):
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
        warnings.warn(f"{KEY_SETTING} isn't set: this session's pseudonyms have a key of their own", stacklevel=2)
    return key or TEST_KEY


def pseudonymised(documents: DataFrame, key: str, column: str = "text", count: str | None = None) -> DataFrame:
    """``documents`` with all columns and rows, the personal data in ``column`` replaced.

    ``count`` names a further column, long: how many values were replaced.
    """
    names = documents.columns
    text, found, renamed = F.col(column).cast("string"), free_name(documents, "found"), free_name(documents, "renamed")
    rows = documents.select("*", F.when(text.rlike(NEEDED), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(found))
    rows = rows.select("*", F.transform(F.col(found), lambda m: _renamed(key, m)).alias(renamed))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col(renamed), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    done = F.when(F.size(found) > 0, joined).otherwise(text)
    changed = F.size(F.filter(F.zip_with(F.col(found), F.col(renamed), lambda a, b: a != b), lambda x: x))
    extra = [F.when(F.size(found) > 0, changed).otherwise(0).cast("long").alias(count)] if count else []
    return rows.select(*[done.alias(c) if c == column else F.col(q) for c, q in zip(names, quoted(names), strict=True)], *extra)


def pii_report(documents: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, the pseudonymised text, and n_found: how many values in it were replaced."""
    key = key or session_key(documents.sparkSession)
    return pseudonymised(documents.select("doc_id", "text"), key, count="n_found").select("doc_id", "n_found", "text")
