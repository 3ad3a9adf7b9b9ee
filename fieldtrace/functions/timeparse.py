"""Times of log lines, per controller, as column expressions; a line that does not fit, or an invalid date, gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.schema import SENTINEL_DAY, effective

# Line and file name grammars.
LOGCAT = r"^(\d{2})-(\d{2})\s+(\d{2}):(\d{2}):(\d{2})\.(\d{3,6})\s+\d+\s+\d+\s+[VDIWEF]\s"
FOTA = r"^(\d{4})-(\d{2})-(\d{2})\s+(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s+"
GENERIC = r"^.{0,40}?(\d{4})-(\d{2})-(\d{2})[T\s](\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,9}))?"
DMESG = r"^\[\s*(\d+)\.(\d+)\]"
DECODED = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})\.(\d{1,9})"
IBDU = r"^\[(\d{4})\.(\d{2})\.(\d{2})\s+(\d{2}):(\d{2}):(\d{2})\.(\d{3})\](.*)$"
MCU_TICK = r"^&(\d+)\s+(?:INF|WRN|ERR|DBG)@"
MCU_SYNC = r"^&(\d+)\s+\w+@SYS\s*:\s*Set Date By Second:\s*(\d+)\s*,"
BOOT_FILE = r"^\d+_(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})\.log$"
DUMP_FILE = r"^kernel@(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})(?:\.\d+)?\.log$"
NAME_DATE = r"(?<!\d)(20\d{2})[-_]?(\d{2})[-_]?(\d{2})(?!\d)"


def part(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def at(y: Column, mo: Column, d: Column, hh: Column, mm: Column, ss: Column) -> Column:
    """Epoch seconds of a UTC date and time; null if there is no such time."""
    y, mo, d, hh, mm, ss = (x.cast("int") for x in (y, mo, d, hh, mm, ss))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    most = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    there = mo.between(1, 12) & d.between(1, most) & (hh < 24) & (mm < 60) & (ss < 60)
    days = F.unix_date(F.make_date(y, mo, d)).cast("long")
    return F.when(there, (days * 86400 + hh * 3600 + mm * 60 + ss).cast("double"))


def fraction(digits: Column) -> Column:
    """Digits after the point as a fraction; null counts as 0."""
    return F.coalesce(digits.cast("double") / F.pow(F.lit(10.0), F.length(digits)), F.lit(0.0))


#: Stands before the groups of a line that fits.
FITS = "\ufdd0"


def parsed(text: Column, pattern: str, groups: int, make: Callable[[list[Column], Column], Column]) -> Column:
    """`make` of a pattern's groups as numbers, and of the last one as text, or null where the text does not fit.

    One search finds the line's head, and its groups, which hold no comma, are cut from that.
    """
    head = F.regexp_extract(text, pattern, 0)
    row = F.regexp_replace(head, pattern, ",".join([FITS, *(f"${i}" for i in range(1, groups + 1))]))
    first = lambda a: F.get(a, F.lit(0))
    bound = lambda c, f: first(F.transform(F.array(c), f))  # noqa: E731 - a value that is used more than once is found once
    number = lambda p: F.transform(p, lambda x: x.try_cast("int"))
    made = bound(F.split(row, ","), lambda p: F.when(first(p) == FITS, bound(number(p), lambda n: make([F.get(n, F.lit(i)) for i in range(1, groups + 1)], F.nullif(F.get(p, F.lit(groups)), F.lit(""))))))
    return F.when(head != "", made)


def _dated(n: list[Column], last: Column) -> Column:
    return at(*n[:6]) + fraction(last)


def logcat(text: Column, year: Column) -> Column:
    return parsed(text, LOGCAT, 6, lambda n, last: at(year, *n[:5]) + fraction(last))


def fota(text: Column) -> Column:
    return parsed(text, FOTA, 7, _dated)


def generic(text: Column) -> Column:
    return parsed(text, GENERIC, 7, _dated)


def decoded(text: Column) -> Column:
    return parsed(text, DECODED, 7, _dated)


def ibdu(text: Column) -> Column:
    return parsed(text, IBDU, 7, _dated)


def dmesg(text: Column) -> Column:
    """Seconds since boot; the fraction counts millionths whatever its number of digits."""
    return part(text, DMESG, 1).cast("double") + part(text, DMESG, 2).cast("double") / 1e6


def mcu_tick(text: Column) -> Column:
    """Seconds since boot."""
    return part(text, MCU_TICK, 1).cast("double") / 1000


def mcu_offset(text: Column) -> Column:
    """Wall clock minus boot clock, where the line sets the clock."""
    return SENTINEL_DAY + part(text, MCU_SYNC, 2).cast("double") - part(text, MCU_SYNC, 1).cast("double") / 1000


def _six(text: Column, pattern: str) -> list[Column]:
    return [part(text, pattern, i) for i in range(1, 7)]


def boot_file(name: Column) -> Column:
    """Wall clock in the name of a boot capture, if usable."""
    ts = at(*_six(name, BOOT_FILE))
    return F.when(effective(ts), ts)


def dump_file(name: Column) -> Column:
    """Wall clock in the name of a kernel dump, if usable."""
    ts = at(*_six(name, DUMP_FILE))
    return F.when(effective(ts), ts)


def year_hint(name: Column, modified: Column) -> Column:
    """Year of a log whose lines have none: from the file's name, else from its modification time, else this year."""
    return F.coalesce(part(name, NAME_DATE, 1).cast("int"), F.year(modified), F.year(F.current_timestamp()))


def line_time(controller: Column, text: Column, year: Column, decoded_file: Column) -> Column:
    """Raw time of a line by its controller."""
    return (
        F.when((controller == "tbox") & decoded_file, decoded(text))
        .when(controller == "android", logcat(text, year))
        .when(controller == "kernel", F.coalesce(dmesg(text), logcat(text, year)))
        .when(controller == "fota", fota(text))
        .when(controller == "tbox", generic(text))
        .when(controller == "mcu", mcu_tick(text))
        .when(controller == "ibdu", F.coalesce(ibdu(text), decoded(text)))
    )


def timed(lines: DataFrame, out: str = "raw_ts") -> DataFrame:
    """Lines (controller, text, year) with their raw time, as `line_time` gives it for text files.

    The same in steps of plain columns, each computed once in compiled code: for whole files this is several times as fast
    as one expression.
    """
    kind, text = F.col("controller"), F.col("text")
    # The pattern is a column: code for each of them would be too long for the virtual machine to compile.
    plain = {"android": LOGCAT, "kernel": LOGCAT, "fota": FOTA, "tbox": GENERIC, "ibdu": DECODED}
    pattern = F.when((kind == "ibdu") & text.rlike(IBDU), IBDU)
    for name, grammar in plain.items():
        pattern = pattern.when(kind == name, grammar)
    # Logcat lines have no year: its place stays empty.
    fields = F.when(kind.isin("android", "kernel"), ",$1,$2,$3,$4,$5,$6").otherwise("$1,$2,$3,$4,$5,$6,$7")
    own = lines.columns
    headed = lines.withColumns({"_pattern": pattern, "_fields": fields}).withColumn("_head", F.call_function("regexp_extract", text, F.col("_pattern"), F.lit(0)))
    cut = headed.withColumn("_cut", F.split(F.regexp_replace("_head", F.col("_pattern"), F.col("_fields")), ","))
    numbers = cut.select(*own, *(F.get("_cut", F.lit(i)).try_cast("int").alias(f"_n{i}") for i in range(6)), F.nullif(F.get("_cut", F.lit(6)), F.lit("")).alias("_rest"))
    clock = F.when(kind == "kernel", dmesg(text)).when(kind == "mcu", mcu_tick(text))
    wall = at(F.coalesce("_n0", "year"), *(F.col(f"_n{i}") for i in range(1, 6))) + fraction(F.col("_rest"))
    return numbers.withColumn(out, F.coalesce(clock, wall)).select(*own, out)
