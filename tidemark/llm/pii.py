"""Format-preserving Feistel pseudonyms for validated numbers and dates, in SQL functions only.

A candidate must pass its kind's test: card numbers the Luhn sum, IBANs the remainder modulo 97,
IPv4 addresses four octets, social security numbers the ranges in use, telephone numbers 8 to 15
digits, dates the calendar. It is then permuted within its format by a keyed Feistel network
over two residue rings Z_a x Z_b that make up the format's values exactly: the same value has
the same pseudonym in every document and every column, two values never share one, and whoever
has the key can go back (`reveal`). Separators stay; check digits are computed anew, so
pseudonyms pass the same test.

Dates move within spans of 65,536 days counted from 1900-01-01 (the first ends in 2079), years
106 to 9973; three formats of one day stay one day (single digits without a zero come back from
`reveal` with one). With slashes the month comes first, or the
day where the first number exceeds 12. Null text stays null; text without candidates is not
touched. Other digits and words are left as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10  # even, so that both halves come back to their own ring
DAYS = 256
_EPOCH = "1900-01-01"

ISO = r"\d{4}-\d{2}-\d{2}"
DOTTED = r"\d{1,2}\.\d{1,2}\.\d{4}"
SLASHED = r"\d{1,2}/\d{1,2}/\d{4}"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"\+\d{1,3}(?:[ -]?\(?\d{2,4}\)?){2,4}|\(\d{3}\) ?\d{3}-\d{4}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?"
CARD = r"\d(?:[ -]?\d){12,18}"
_ALL = (ISO, DOTTED, SLASHED, IPV4, SSN, PHONE, IBAN, CARD)
#: A candidate touches no further letter or digit; a dot or comma may follow as punctuation.
CANDIDATE = rf"(?<![0-9A-Za-z+])(?:{'|'.join(_ALL)})(?![0-9A-Za-z])"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def feistel(x: Column, y: Column, a: Column, b: Column, tweak: Column, key: str, reveal: bool) -> Column:
    """Permute (x, y) in Z_a x Z_b; a struct with x and y. The round function is SHA-256 of key,
    tweak, round and half, cut to 60 bits."""
    long = lambda c: c.cast("long")
    start = F.struct(long(x).alias("x"), long(y).alias("y"), long(a).alias("a"), long(b).alias("b"))

    def noise(r: Column, half: Column) -> Column:
        said = F.concat_ws(":", F.lit(key), tweak, r.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")

    def onward(s: Column, r: Column) -> Column:
        moved = F.pmod(s["x"] + noise(r, s["y"]), s["a"])
        return F.struct(s["y"].alias("x"), moved.alias("y"), s["b"].alias("a"), s["a"].alias("b"))

    def back(s: Column, r: Column) -> Column:
        moved = F.pmod(s["y"] - noise(r, s["x"]), s["b"])
        return F.struct(moved.alias("x"), s["x"].alias("y"), s["b"].alias("a"), s["a"].alias("b"))

    if reveal:
        return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)), start, back)
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, onward)


def permuted_digits(value: Column, tweak: Column, key: str, reveal: bool) -> Column:
    """Another string of as many digits (2 to 36)."""
    left = F.floor(F.length(value) / 2)
    right = F.length(value) - left
    ten = lambda n: F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")
    done = feistel(
        F.substring(value, F.lit(1), left.cast("int")),
        F.substring(value, (left + 1).cast("int"), right.cast("int")),
        ten(left),
        ten(right),
        F.concat_ws("/", tweak, F.length(value).cast("string")),
        key,
        reveal,
    )
    return bound(
        done,
        lambda d: F.concat(
            F.lpad(d["x"].cast("string"), left.cast("int"), F.lit("0")),
            F.lpad(d["y"].cast("string"), right.cast("int"), F.lit("0")),
        ),
    )


def bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def poured(template: Column, filling: Column) -> Column:
    """template with its digits replaced, one after the other, by those of filling."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike(r"^\d$")
        put = F.when(digit, F.substring(filling, s["n"] + 1, F.lit(1))).otherwise(c)
        return F.struct((s["n"] + digit.cast("int")).alias("n"), F.concat(s["out"], put).alias("out"))

    return F.aggregate(F.split(template, ""), start, step, lambda s: s["out"])


def luhn(number: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    def add(s: Column, c: Column) -> Column:
        d = c.cast("int") * (1 + s["odd"])
        total = s["t"] + d - F.when(d > 9, 9).otherwise(0)
        return F.struct((1 - s["odd"]).alias("odd"), total.alias("t"))

    start = F.struct(F.lit(0).alias("odd"), F.lit(0).alias("t"))
    return F.aggregate(F.split(F.reverse(number), ""), start, add, lambda s: s["t"] % 10)


def remainder(iban: Column) -> Column:
    """IBAN (no blanks) modulo 97, its first four characters moved to the end."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(s: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike(r"^\d$"), s * 10 + c.cast("int")).otherwise(s * 100 + letter) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def card(m: Column, key: str, reveal: bool) -> Column:
    number = digits(m)
    payload = permuted_digits(
        F.substring(number, F.lit(1), F.length(number) - 1), F.lit("card"), key, reveal
    )
    full = bound(payload, lambda p: F.concat(p, ((10 - luhn(F.concat(p, F.lit("0")))) % 10).cast("string")))
    return F.when(luhn(number) == 0, bound(full, lambda f: poured(m, f)))


def iban(m: Column, key: str, reveal: bool) -> Column:
    """Only digits behind the check digits change; country and letters stay."""
    plain = F.regexp_replace(m, " ", "")
    rest = F.substring(plain, F.lit(5), F.length(plain))
    country = F.substring(plain, 1, 2)
    filled = bound(
        permuted_digits(digits(rest), F.concat(F.lit("iban"), country), key, reveal),
        lambda d: poured(rest, d),
    )
    check = lambda r: F.lpad((98 - remainder(F.concat(country, F.lit("00"), r))).cast("string"), 2, F.lit("0"))
    full = bound(filled, lambda r: F.concat(check(r), digits(r)))
    valid = (remainder(plain) == 1) & F.length(plain).between(15, 34) & (F.length(digits(rest)) >= 2)
    return F.when(valid, bound(full, lambda f: poured(m, f)))


def ipv4(m: Column, key: str, reveal: bool) -> Column:
    part = F.split(m, r"\.")
    octet = lambda i: part[i].cast("long")
    valid = reduce(lambda a, b: a & b, [octet(i) <= 255 for i in range(4)])
    ring = F.lit(65536)
    done = feistel(
        octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), ring, ring, F.lit("ip"), key, reveal
    )
    text = bound(
        done,
        lambda d: F.concat_ws(
            ".", F.shiftright(d["x"], 8), d["x"] % 256, F.shiftright(d["y"], 8), d["y"] % 256
        ),
    )
    return F.when(valid, text)


def ssn(m: Column, key: str, reveal: bool) -> Column:
    area, group, serial = (part.cast("long") for part in (F.substring(m, 1, 3), F.substring(m, 5, 2), F.substring(m, 8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - (area > 666).cast("long")
    done = feistel(
        index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key, reveal
    )

    def write(d: Column) -> Column:
        place = F.floor(d["x"] / 99)
        back = place + 1 + (place >= 665).cast("long")
        padded = lambda c, n: F.lpad(c.cast("string"), n, F.lit("0"))
        return F.concat_ws("-", padded(back, 3), padded(d["x"] % 99 + 1, 2), padded(d["y"] + 1, 4))

    return F.when(valid, bound(done, write))


def phone(m: Column, key: str, reveal: bool) -> Column:
    """The first digit of an international number (its world zone) stays."""
    number = digits(m)
    world = m.startswith("+")
    kept = F.when(world, F.substring(number, 1, 1)).otherwise("")
    moved = F.when(world, F.substring(number, F.lit(2), F.length(number))).otherwise(number)
    full = F.concat(kept, permuted_digits(moved, F.concat(F.lit("phone"), kept), key, reveal))
    return F.when(F.length(number).between(8, 15), bound(full, lambda f: poured(m, f)))


def day(year: Column, month: Column, dom: Column, key: str, reveal: bool, write) -> Column:
    """The pseudonym of a calendar day, written by `write`; null if there is no such day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(dom, 2, "0"))
    number = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(_EPOCH).cast("date"))
    span = F.floor(number / (DAYS * DAYS))
    inside = F.pmod(number, F.lit(DAYS * DAYS))
    ring = F.lit(DAYS)
    done = feistel(
        F.floor(inside / DAYS), inside % DAYS, ring, ring, F.concat(F.lit("day"), span.cast("string")), key, reveal
    )
    moved = bound(
        done,
        lambda d: F.date_add(
            F.lit(_EPOCH).cast("date"), (span * DAYS * DAYS + d["x"] * DAYS + d["y"]).cast("int")
        ),
    )
    return F.when(span.between(-10, 44), bound(moved, write))


def iso(m: Column, key: str, reveal: bool) -> Column:
    p = F.split(m, "-")
    return day(p[0], p[1], p[2], key, reveal, lambda d: F.date_format(d, "yyyy-MM-dd"))


def padded_like(number: Column, sample: Column) -> Column:
    """Two digits where the sample has two."""
    return F.when(F.length(sample) > 1, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))


def parted(m: Column, mark: str, key: str, reveal: bool) -> Column:
    """dd.mm.yyyy, or mm/dd/yyyy, or dd/mm/yyyy where the first number exceeds 12."""
    p = F.split(m, r"\." if mark == "." else mark)

    def written(month: int, dom: int) -> Column:
        def write(d: Column) -> Column:
            shown = [None, None]
            shown[month] = padded_like(F.month(d), p[month])
            shown[dom] = padded_like(F.dayofmonth(d), p[dom])
            return F.concat_ws(mark, *shown, F.date_format(d, "yyyy"))

        return day(p[2], p[month], p[dom], key, reveal, write)

    return written(1, 0) if mark == "." else F.coalesce(written(0, 1), written(1, 0))


def pseudonym(m: Column, key: str, reveal: bool = False) -> Column:
    """struct(kind, value) of a candidate; null if it passes no test."""
    is_ = lambda pattern: m.rlike(rf"^(?:{pattern})$")
    kinds = [
        ("date", ISO, iso(m, key, reveal)),
        ("date", DOTTED, parted(m, ".", key, reveal)),
        ("date", SLASHED, parted(m, "/", key, reveal)),
        ("ip", IPV4, ipv4(m, key, reveal)),
        ("ssn", SSN, ssn(m, key, reveal)),
        ("phone", PHONE, phone(m, key, reveal)),
        ("iban", IBAN, iban(m, key, reveal)),
        ("card", CARD, card(m, key, reveal)),
    ]
    value, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, made in reversed(kinds):
        value, kind = F.when(is_(pattern), made).otherwise(value), F.when(is_(pattern), name).otherwise(kind)
    return F.struct(m.alias("was"), kind.alias("kind"), value.alias("value"))


def pseudonymised(docs: DataFrame, key: str, column: str = "text", reveal: bool = False) -> DataFrame:
    """docs with `column` rewritten, and `pii_dates` and `pii_numbers`, how often it was; columns
    of these names are replaced."""
    text = docs[column]
    found = F.when(
        text.rlike(CANDIDATE),
        F.transform(
            F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda m: pseudonym(m, key, reveal)
        ),
    )
    marked = docs.withColumn("_pii_found", found)
    between = F.split(text, CANDIDATE, -1)
    values = F.transform("_pii_found", lambda s: F.coalesce(s["value"], s["was"]))
    whole = F.array_join(
        F.flatten(F.zip_with(between, values, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""
    )
    count = lambda test: F.coalesce(
        F.size(F.filter("_pii_found", lambda s: s["value"].isNotNull() & test(s["kind"]))), F.lit(0)
    )
    out = {c: marked[c] for c in docs.columns}
    out[column] = F.when(F.col("_pii_found").isNull(), text).otherwise(whole)
    out["pii_dates"] = F.when(F.col("_pii_found").isNull(), 0).otherwise(count(lambda k: k == "date"))
    out["pii_numbers"] = F.when(F.col("_pii_found").isNull(), 0).otherwise(count(lambda k: k != "date"))
    return marked.select(*(c.alias(name) for name, c in out.items()))
