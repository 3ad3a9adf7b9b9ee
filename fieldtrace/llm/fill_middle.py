"""Fill-in-middle: a text is cut into prefix, middle and suffix at unit boundaries and rearranged around sentinels.

One Aho-Corasick automaton holds the ASCII characters at which the class of a character changes a unit's course (the line
feed for lines, white space for words, none for single characters) and the sentinels.  Its single scan over a text gives a
sparse list of events; a text in which a sentinel occurs stays plain.  Between two events all characters are of one
class, so the units of a gap follow by arithmetic: none complete in lines, one in words, one for each character.  A
boundary's position is then looked up by rank among the events, and no list of all units is ever made.

Only texts go to Python, and three integers for each come back; drawing, cutting, rearranging and restoring are
expressions.  Positions are code points.

Defined cases: a null text counts as empty; an empty text has 0 units and is plain; a null id draws as an empty one; rows
that are equal get equal results, as ties do; texts of any length are scanned whole; where a column has the name of a new
one, the new one gets underscores before it, and the names are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations_with_replacement

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import free_name

#: Unit kinds and the ASCII characters whose class differs from that of all others.
EVENTS = {"line": "\n", "word": " \t\n\x0b\x0c\r", "char": ""}
SENTINELS = ("<P>", "<S>", "<M>")
PLACES = "n int, a int, b int, plain boolean"


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if an end of one is never a start of one: else joined pieces could read as a sentinel."""
    for x, y in [*combinations_with_replacement(sentinels, 2), *combinations_with_replacement(sentinels[::-1], 2)]:
        if not x or any(x.endswith(y[:k]) for k in range(1, len(y) + (x != y))) or (x != y and y in x):
            raise ValueError(f"sentinels overlap: {x!r}, {y!r}")
    if len(set(sentinels)) < 3:
        raise ValueError("sentinels are not distinct")
    return sentinels


@lru_cache(maxsize=8)
def automaton(kind: str, sentinels: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in EVENTS[kind]:
        out.add_word(c, False)
    for s in sentinels:
        out.add_word(s, True)
    out.make_automaton()
    return out


class Scan:
    """Events of one text: how many units it has, and where each boundary lies."""

    def __init__(self, text: str, kind: str, sentinels: tuple[str, ...] = SENTINELS):
        self.arithmetic, self.length, self.marked = not EVENTS[kind], len(text), False
        found: list[int] = []
        for at, sentinel in automaton(kind, sentinels).iter(text):
            if sentinel:
                self.marked = True
            else:
                found.append(at)
        if kind == "word":
            # A gap with characters in it is a word, white space before it included, and ends where the next event is.
            self.ends = [at for before, at in zip([-1, *found], found, strict=False) if at - before > 1]
        else:
            self.ends = [at + 1 for at in found]  # an event ends a unit, itself included
        # What is left after the last end is one more unit, or one for each character.
        left = self.length - (self.ends[-1] if self.ends else 0)
        self.n = len(self.ends) + (left if self.arithmetic else min(left, 1))

    def position(self, rank: int) -> int:
        """Code points in the first `rank` units."""
        if 0 < rank < self.n:
            return rank if self.arithmetic else self.ends[rank - 1]
        return self.length if rank > 0 else 0


def places(kind: str, sentinels: tuple[str, str, str]):
    """UDF of text and two draws: units, the positions of the two boundaries, and whether a sentinel occurs."""

    @F.pandas_udf(PLACES)
    def cut(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        rows = []
        for t, x, y in zip(text, first, second, strict=True):
            got = Scan(t, kind, sentinels)
            ranks = sorted((int(x) % (got.n + 1), int(y) % (got.n + 1)))
            rows.append((got.n, *map(got.position, ranks), got.marked))
        return pd.DataFrame(rows, columns=["n", "a", "b", "plain"])

    return cut


def draw(key: Column, seed: int, group: int) -> Column:
    """The numbered 8-digit group of the hex sha256 of seed, colon and key, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def transform(df: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id", text: str = "text", sentinels: tuple[str, str, str] = SENTINELS) -> tuple[DataFrame, list[str]]:
    """`df` with units, form, lengths of prefix and middle (null if plain) and the rearranged text, and the names of these five columns.

    `rate` of 100 texts are rearranged, `spm_rate` of 100 of these with the suffix first; `sentinels` stand before prefix,
    suffix and middle.
    """
    p, s, m = checked(sentinels)
    if unit not in EVENTS:
        raise ValueError(f"unit is none of {', '.join(EVENTS)}: {unit}")
    names = [free_name(df, x) for x in ("n_units", "form", "prefix_chars", "middle_chars", "output", "whole", "cut")]
    n, form, prefix, middle, output, t, cut = names
    key = F.col(id_col)
    whole = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn(t, whole).withColumn(cut, places(unit, sentinels)(F.col(t), draw(key, seed, 1), draw(key, seed, 2)))
    plain = (F.col(t) == "") | F.col(f"{cut}.plain") | (F.pmod(draw(key, seed, 3), F.lit(100)) >= rate)
    named = F.when(plain, "plain").when(F.pmod(draw(key, seed, 4), F.lit(100)) < spm_rate, "spm").otherwise("psm")
    a, b = F.col(f"{cut}.a"), F.col(f"{cut}.b")
    out = out.withColumn(form, named).withColumns({n: F.col(f"{cut}.n").cast("long"), prefix: F.when(F.col(form) != "plain", a.cast("long")), middle: F.when(F.col(form) != "plain", (b - a).cast("long"))})
    first, mid, last = F.substring(t, F.lit(1), a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, F.length(t) - b)
    made = (
        F.when(F.col(form) == "psm", F.concat(F.lit(p), first, F.lit(s), last, F.lit(m), mid))
        .when(F.col(form) == "spm", F.concat(F.lit(s), last, F.lit(p), first, F.lit(m), mid))
        .otherwise(F.col(t))
    )
    return out.withColumn(output, made).select(*df.columns, n, form, prefix, middle, output), names[:5]


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from: the pieces between sentinels, put in order."""
    parts = F.split(output, "|".join(map(re.escape, checked(sentinels))), -1)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def digests(df: DataFrame, **options) -> DataFrame:
    """The digest of `transform` for each row: id, units, form, lengths, and hashes of output and restored text."""
    done, (n, form, prefix, middle, output) = transform(df, **options)
    key = options.get("id_col", "doc_id")
    return done.select(
        F.col(key),
        F.col(n).alias("n"),
        F.col(form).alias("form"),
        F.col(prefix).alias("prefix_chars"),
        F.col(middle).alias("middle_chars"),
        F.sha2(F.col(output), 256).alias("output_sha256"),
        F.sha2(restore(F.col(output), F.col(form), options.get("sentinels", SENTINELS)), 256).alias("restored_sha256"),
    )
