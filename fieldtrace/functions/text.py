"""Text functions: redaction, tokens, chunks, hashes, titles, labels, hexadecimal payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What redaction replaces, in this order, and what counts as a word, a Han run and white space at the ends.
SENSITIVE = {
    "VIN": r"[A-HJ-NPR-Z0-9]{17}",
    "PHONE": r"1[3-9]\d{9}",
    "PLATE": r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁使领][A-Z][A-HJ-NP-Z0-9]{4,5}[A-HJ-NP-Z0-9挂学警港澳试超]",
}
WORD = r"[a-z][a-z0-9_\-]*(?:\.[a-z0-9]+)*"
HAN = r"[一-鿿]+"
BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def redact(text: Column) -> Column:
    """Vehicle numbers, telephone numbers and plates by a mark each; an earlier kind takes its text first."""
    for kind, pattern in SENSITIVE.items():
        text = F.regexp_replace(text, pattern, f"[REDACTED_{kind}]")
    return text


def tokens(text: Column) -> Column:
    """Lower-case words, then the character pairs of Han runs; a run of one character is a token."""
    low = F.lower(text)
    pairs = F.transform(
        F.regexp_extract_all(low, F.lit(HAN), F.lit(0)),
        lambda s: F.when(F.length(s) == 1, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2)))),
    )
    return F.concat(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.flatten(pairs))


def query_key(scenario: Column, query: Column) -> Column:
    """Cache key of a query: blanks at its ends and case do not matter."""
    return F.sha2(F.concat(scenario, F.lit("|"), F.lower(strip(query))), 256)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty, zero or unequally long vectors."""
    p, q = a.cast("array<double>"), b.cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(p, q, lambda x, y: x * y))
    norms = F.sqrt(total(F.transform(p, lambda x: x * x))) * F.sqrt(total(F.transform(q, lambda x: x * x)))
    return F.when((F.size(p) > 0) & (F.size(p) == F.size(q)) & (norms > 0), dot / norms).otherwise(F.lit(0.0))


CHUNK = "array<struct<text:string,start:int,stop:int>>"


def _merged(chunks: Column, least: int) -> Column:
    """Strips chunks; one below `least` characters joins the one before it, and goes if there is none."""

    def step(out: Column, c: Column) -> Column:
        bare = strip(c["text"])
        last = F.element_at(out, -1)
        joined = F.struct(F.concat_ws("\n", last["text"], bare).alias("text"), last["start"].alias("start"), c["stop"].alias("stop"))
        short = F.when(F.size(out) > 0, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined))).otherwise(out)
        return F.when(F.length(bare) < least, short).otherwise(F.concat(out, F.array(F.struct(bare.alias("text"), c["start"].alias("start"), c["stop"].alias("stop"))))).cast(CHUNK)

    return F.aggregate(chunks, F.array().cast(CHUNK), step)


def _piece(text: Column, start: Column, size: int) -> Column:
    piece = F.substr(text, start + 1, F.lit(size))
    return F.struct(piece.alias("text"), start.cast("int").alias("start"), (start + F.length(piece)).cast("int").alias("stop"))


def chunk_fixed(text: Column, size: int = 500, least: int = 50) -> Column:
    """Pieces of `size` characters, one after another."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.when(F.length(text) > 0, _merged(F.transform(starts, lambda s: _piece(text, s, size)), least)).otherwise(F.array().cast(CHUNK))


def chunk_sliding(text: Column, size: int = 500, overlap: int = 50, least: int = 50) -> Column:
    """Windows that overlap; those below `least` are not made, and the first that reaches the end is the last."""
    step = size - overlap if size > overlap else max(size // 2, 1)
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    made = F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: _piece(text, i * step, size)), lambda c: F.length(c["text"]) >= least)
    return F.when(F.length(text) > 0, _merged(made, least)).otherwise(F.array().cast(CHUNK))


def chunk_paragraphs(text: Column, size: int = 500, least: int = 50) -> Column:
    """Paragraphs packed while they fit; places count each paragraph and two line ends."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: strip(p)), lambda p: p != "")
    state = f"struct<out:{CHUNK},held:string,start:int,at:int>"
    zero = F.struct(F.array().cast(CHUNK).alias("out"), F.lit("").alias("held"), F.lit(0).alias("start"), F.lit(0).alias("at")).cast(state)
    closed = lambda s: F.concat(s["out"], F.array(F.struct(s["held"].alias("text"), s["start"].alias("start"), (s["start"] + F.length(s["held"])).alias("stop"))))

    def step(s: Column, p: Column) -> Column:
        fits = (s["held"] == "") | (F.length(s["held"]) + F.length(p) + 1 <= size)
        held = F.when(s["held"] == "", p).otherwise(F.concat(s["held"], F.lit("\n\n"), p))
        after = s["at"] + F.length(p) + 2
        more = F.struct(s["out"].alias("out"), held.alias("held"), F.when(s["held"] == "", s["at"]).otherwise(s["start"]).alias("start"), after.alias("at")).cast(state)
        new = F.struct(closed(s).alias("out"), p.alias("held"), s["at"].alias("start"), after.alias("at")).cast(state)
        return F.when(fits, more).otherwise(new)

    packed = F.aggregate(paragraphs, zero, step, lambda s: F.when(s["held"] != "", closed(s)).otherwise(s["out"]))
    return _merged(packed, least)


def ticket_ids(task: Column) -> Column:
    return F.regexp_extract_all(F.upper(task), F.lit(r"[A-Z]+-\d+"), F.lit(0))


def title_of(message: Column, most: int = 18) -> Column:
    """Blanks collapsed, cut to `most` characters with dots after them."""
    bare = strip(F.regexp_replace(message, r"(?U)\s+", " "))
    return F.when(F.length(bare) > most, F.concat(F.left(bare, F.lit(most)), F.lit("..."))).otherwise(bare)


def duration_label(seconds: Column) -> Column:
    """Hours and minutes, minutes, or seconds below a minute; empty for null and negative values."""
    s = F.floor(seconds + 0.5).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    long_ = F.when(h == 0, F.format_string("%dm", m)).when(m == 0, F.format_string("%dh", h)).otherwise(F.format_string("%dh %dm", h, m))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), "").when(s < 60, F.format_string("%ds", s)).otherwise(long_)


def delta_label(seconds: Column) -> Column:
    """The two largest units of a difference, which is at least 0; dashes without one."""
    s = F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    some = F.when(h > 0, F.format_string("Δ%dh %dm", h, m)).when(m > 0, F.format_string("Δ%dm %ds", m, s % 60)).otherwise(F.format_string("Δ%ds", s))
    return F.when(seconds.isNull() | F.isnan(seconds), "Δ--").otherwise(some)


def cut_bytes(text: Column, most: int) -> Column:
    """At most `most` bytes of UTF-8; a character that is cut in two goes."""
    raw = F.encode(text, "UTF-8")
    cut = F.make_valid_utf8(F.substring(raw, 1, most).cast("string"))
    return F.when(F.length(raw) <= most, text).otherwise(F.rtrim(cut, F.lit("�")))


def hex_text(payload: Column) -> Column:
    """Hexadecimal runs of four or more characters, even in number, as text with dots for unprintable bytes."""
    runs = r"[0-9A-Fa-f]+"
    gaps, found = F.split(payload, runs, -1), F.regexp_extract_all(payload, F.lit(runs), F.lit(0))
    code = lambda h: F.conv(h, 16, 10).cast("int")
    shown = lambda h: F.when(code(h).between(32, 126), F.char(code(h))).otherwise(F.lit("."))
    ascii_ = lambda r: F.array_join(F.transform(F.sequence(F.lit(1), F.length(r) - 1, F.lit(2)), lambda i: shown(F.substr(r, i, F.lit(2)))), "")
    new = F.transform(found, lambda r: F.when((F.length(r) >= 4) & (F.length(r) % 2 == 0), ascii_(r)).otherwise(r))
    return F.array_join(F.flatten(F.zip_with(gaps, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def printable(payload: Column) -> Column:
    """Printable runs of three or more bytes, joined by blanks; hexadecimal where there is none."""
    runs = F.regexp_extract_all(F.decode(payload, "ISO-8859-1"), F.lit(r"[\x20-\x7e\t]{3,}"), F.lit(0))
    joined = F.array_join(F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: r != ""), " ")
    return F.when(joined != "", joined).otherwise(F.lower(F.hex(payload)))
