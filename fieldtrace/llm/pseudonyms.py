"""Format-preserving pseudonyms for personal numbers, dates and addresses in text.

A match is replaced only where it is valid: a card number by its Luhn digit, a date by the calendar (1900 to 2099), an IP
address by octets up to 255 without leading zeros, a social security number by its area, group and serial, a telephone
number by its length.  Valid values of one kind are permuted among themselves by a keyed Feistel network: digits stay
digits, letters stay letters of the same case, separators stay, a card number stays a valid card number, a date stays a
date in the same layout, an address stays an address (its octets may take other lengths).  The permutation depends on
the key, the kind and the value alone, so equal values get equal pseudonyms in all documents, and different values of
one format get different ones.

All of it is DataFrame expressions on one row; nothing is shuffled.  Defined cases: a null text stays null, an empty one
empty; a text of any length is searched whole; invalid values stay as they are, as do dates outside 1900 to 2099;
repeated rows get equal results; other columns, whatever their names, are kept, but for those that `out` and `count`
name, which are replaced; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import free_name

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Kind -> pattern, tried in this order at each place of the text.
KINDS: dict[str, str] = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,18}",
    "date": r"(?<![\d./-])(?:(?:19|20)\d\d([-/.])\d\d\1\d\d|\d{1,2}([/.])\d{1,2}\2(?:19|20)\d\d)(?![\d/-]|\.\d)",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\dA-Za-z])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?![\dA-Za-z])",
    "phone": r"(?<![\dA-Za-z+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\dA-Za-z])|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\dA-Za-z])",
}


def _pattern() -> str:
    """One alternation; back references are renumbered by the groups before them."""
    import re

    parts, groups = [], 0
    for p in KINDS.values():
        parts.append(re.sub(r"\\([12])(?!\d)", lambda m, g=groups: f"\\{int(m[1]) + g}", p))
        groups += re.compile(p).groups
    return "|".join(f"(?:{p})" for p in parts)


PATTERN = _pattern()


def bind(value: Column, f) -> Column:
    """f(value) with `value` evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def prf(key: str, *parts: Column) -> Column:
    """64-digit hexadecimal keyed hash."""
    return F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256)


def number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("bigint")


def feistel_number(value: Column, left: int, right: int, key: str, tweak: str) -> Column:
    """Keyed permutation of 0 .. left * right - 1."""
    zero = F.struct(F.floor(value / right).cast("bigint").alias("l"), (value % right).cast("bigint").alias("r"))

    def step(s: Column, k: Column) -> Column:
        mix = lambda other: number(F.substring(prf(key, F.lit(tweak), k, other), 1, 14))
        even = k % 2 == 0
        return F.struct(F.when(even, (s["l"] + mix(s["r"])) % left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + mix(s["l"])) % right).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, step, lambda s: s["l"] * right + s["r"])


def _moved(half: Column, other: Column, k: Column, key: str, tweak: Column) -> Column:
    """`half` with each letter and digit moved within its class by what the other half and the round say."""
    by = lambda i: number(F.substr(prf(key, tweak, k, F.length(half), F.floor((i - 1) / 8), other), (((i - 1) % 8) * 8 + 1).cast("int"), F.lit(8)))

    def one(i: Column) -> Column:
        c = F.substr(half, i, F.lit(1))
        within = lambda chars: F.substr(F.lit(chars), ((F.instr(F.lit(chars), c) - 1 + by(i)) % len(chars) + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("[0-9]"), within(DIGITS)).when(c.rlike("[a-z]"), within(LOWER)).when(c.rlike("[A-Z]"), within(UPPER)).otherwise(c)

    return F.when(F.length(half) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), "")).otherwise(half)


def feistel_text(value: Column, key: str, tweak: Column) -> Column:
    """Keyed permutation of the strings of one format: same length, same class of character at each place."""
    cut = F.floor(F.length(value) / 2).cast("int")
    zero = F.struct(F.substr(value, F.lit(1), cut).alias("l"), F.substr(value, cut + 1, F.length(value)).alias("r"))

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(
            F.when(even, _moved(s["l"], s["r"], k, key, tweak)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(_moved(s["r"], s["l"], k, key, tweak)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, step, lambda s: F.concat(s["l"], s["r"]))


def luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn sum of the digits; shift 0 if the last is the check digit, 1 if it is still to come."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when((i + shift) % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, x: a + x)


def into(layout: Column, digits: Column) -> Column:
    """`layout` with its digits replaced in order by `digits`."""

    def one(i: Column) -> Column:
        c = F.substr(layout, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.length(F.regexp_replace(F.substr(layout, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(layout)), one), "")


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def new_card(m: Column, key: str) -> Column:
    """Body permuted, and the check digit that follows from it; a number that fails Luhn stays."""

    def of(d: Column) -> Column:
        def valid(body: Column) -> Column:
            return F.concat(body, ((10 - luhn_sum(body, 1) % 10) % 10).cast("string"))

        card = bind(feistel_text(F.substr(d, F.lit(1), F.length(d) - 1), key, F.lit("card")), valid)
        return F.when(luhn_sum(d, 0) % 10 == 0, into(m, card)).otherwise(m)

    return bind(only_digits(m), of)


#: Areas, groups times areas, and serials of social security numbers: areas 001 to 899 without 666, groups from 01, serials from 0001.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def new_ssn(m: Column, key: str) -> Column:
    """Permuted among the numbers that can be issued; another one stays."""
    field = lambda at, n: F.substring(m, at, n).cast("bigint")
    area, group, serial = field(1, 3), field(5, 2), field(8, 4)
    issued = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * GROUPS + group - 1) * SERIALS + serial - 1

    def out(v: Column) -> Column:
        high = F.floor(v / (GROUPS * SERIALS)).cast("bigint")
        return F.format_string("%03d-%02d-%04d", high + 1 + F.when(high >= 665, 1).otherwise(0), F.floor(v / SERIALS).cast("bigint") % GROUPS + 1, v % SERIALS + 1)

    return F.when(issued, bind(feistel_number(place, AREAS * GROUPS, SERIALS, key, "ssn"), out)).otherwise(m)


def new_ip(m: Column, key: str) -> Column:
    def of(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i)).cast("bigint")
        whole = ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3)
        dotted = lambda v: F.concat_ws(".", *((F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)))
        return F.when(F.exists(p, lambda x: (x.cast("int") > 255) | x.rlike("^0.")), m).otherwise(bind(feistel_number(whole, 1 << 16, 1 << 16, key, "ip"), dotted))

    return bind(F.split(m, r"\."), of)


#: Days from 1900-01-01 to 2099-12-31: 17 * 4297.
DAYS = (17, 4297)


def new_date(m: Column, key: str) -> Column:
    """Day first where the year is last, unless only month first gives a date; fields keep their order and width."""

    def of(p: Column) -> Column:
        f = lambda i: F.get(p, F.lit(i)).cast("int")
        iso = F.length(F.get(p, F.lit(0))) == 4
        month_first = ~iso & (f(1) > 12)
        text = F.format_string("%04d-%02d-%02d", F.when(iso, f(0)).otherwise(f(2)), F.when(month_first, f(0)).otherwise(f(1)), F.when(iso, f(2)).when(month_first, f(1)).otherwise(f(0)))
        sep = F.regexp_extract(m, "[-/.]", 0)

        def out(day: Column) -> Column:
            new = F.date_add(F.lit("1900-01-01").cast("date"), day.cast("int"))
            y, mo, d = F.date_format(new, "yyyy"), F.date_format(new, "MM"), F.date_format(new, "dd")
            return F.when(iso, F.concat(y, sep, mo, sep, d)).when(month_first, F.concat(mo, sep, d, sep, y)).otherwise(F.concat(d, sep, mo, sep, y))

        def from_day(day: Column) -> Column:
            return F.when(day.isNull(), m).otherwise(bind(feistel_number(day.cast("bigint"), *DAYS, key, "date"), out))

        return bind(F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date")), from_day)

    return bind(F.split(m, "[-/.]"), of)


def new_phone(m: Column, key: str) -> Column:
    """The country code stays; too few or too many digits are no telephone number."""
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    n = F.length(only_digits(m))
    return F.when((n < 8) | (n > 15), m).otherwise(F.concat(code, into(rest, feistel_text(only_digits(rest), key, F.lit("phone")))))


def new_email(m: Column, key: str) -> Column:
    """Local part and the names before the last are permuted, each letter within its case; the last name stays."""
    last = F.regexp_extract(m, r"\.[A-Za-z]{2,18}$", 0)
    return F.concat(feistel_text(F.substr(m, F.lit(1), F.length(m) - F.length(last)), key, F.lit("email")), last)


def pseudonym(m: Column, key: str) -> Column:
    is_a = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    return (
        F.when(is_a("email"), new_email(m, key))
        .when(is_a("date"), new_date(m, key))
        .when(is_a("ip"), new_ip(m, key))
        .when(is_a("ssn"), new_ssn(m, key))
        .when(is_a("card"), new_card(m, key))
        .when(is_a("phone"), new_phone(m, key))
        .otherwise(m)
    )


#: What every match holds: an at sign, or a digit and five more digits, separators or brackets.
HINT = r"@|[0-9][0-9./() -]{5}"


def pseudonymise(df: DataFrame, key: str, text: str = "text", out: str | None = None, count: str | None = None) -> DataFrame:
    """`df` with `text` (or a new column `out`) in which personal values are replaced; `count` names a column for how many."""
    t = F.col(text)
    gaps, hit, new, made, n = (free_name(df, c) for c in ("_gaps", "_found", "_new", "_made", "_n"))
    # Most texts hold nothing that the patterns could match: one simple search spares them the others.
    searched = F.when(t.rlike(HINT), t)
    found = df.withColumns({gaps: F.split(searched, PATTERN, -1), hit: F.regexp_extract_all(searched, F.lit(PATTERN), F.lit(0))})
    found = found.withColumn(new, F.transform(hit, lambda m: pseudonym(m, key)))
    joined = F.array_join(F.flatten(F.zip_with(gaps, new, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    # Named after the fact, so that `out` may be the text column itself.
    hits = F.size(F.filter(F.zip_with(hit, new, lambda a, b: a != b), lambda x: x)).cast("long")
    done = found.withColumns({made: F.when(F.coalesce(F.size(hit) > 0, F.lit(False)), joined).otherwise(t), n: F.when(F.coalesce(F.size(hit) > 0, F.lit(False)), hits).otherwise(F.lit(0).cast("long"))})
    done = done.withColumn(out or text, F.col(made))
    if count:
        done = done.withColumn(count, F.col(n))
    return done.drop(gaps, hit, new, made, n)
