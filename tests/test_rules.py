"""Rules in one search against a search for each, literals that patterns need, and the limit by prefix sums."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fieldtrace.functions import rules as R
from fieldtrace.operators import range_query as Q


def plain_hits(rules, controller, text):
    tried = R.alternatives(rules, controller)
    found = []
    starts, at = [], 1
    for i, p in tried:
        starts.append((i, at))
        at += 1 + re.compile(p).groups
    for m in re.finditer("|".join(f"({p})" for _, p in tried), text, re.ASCII) if tried else ():
        found += [next(i for i, g in starts if m[g] is not None)] if m[0] else []
    return found + [i for i, r in enumerate(rules) if controller in r.controllers and r.all_words and all(w in text.lower() for w in r.all_words)]


SETS = {
    "events": R.EVENT_RULES,
    "anchors": R.ANCHOR_RULES,
    # A later alternative matches where an earlier one would match the same text alone; more than nine groups.
    "odd": (
        R.Rule("word", ("android",), (r"\bfoo\b",)),
        R.Rule("any", ("android",), (r"foo",)),
        *(R.Rule(f"g{i}", ("android",), (rf"(k){{1}}{i}(e)?",)) for i in range(12)),
        R.Rule("end", ("android",), (r"(?i)call\s+trace:\s*$",), any_words=("a|b", "($1)")),
    ),
    "nothing": (R.Rule("other", ("mcu",), ("x",)),),
}


@pytest.mark.parametrize("name", list(SETS))
def test_hits_equal_a_plain_search(spark, name):
    rnd = random.Random(1)
    words = "foo foobar barfoo xx k3 k11e k7 call Call trace: reboot RESTART rebooting reason=ota boot completed install start fail fota download start GEAR -> P DOOR_FL_OPEN LOCK_OK unlock UNLOCK_OK watchdog BUG: kernel panic a|b ($1) ﷐ ﷑k3 Oops: time sync".split(" ")
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 9))) for _ in range(600)] + ["", "foo", "﷐", "fo﷒o"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for controller in ("android", "kernel", "mcu"):
        got = df.select("text", R.hits(SETS[name], controller, F.col("text")).alias("h")).collect()
        for r in got:
            assert r.h == plain_hits(SETS[name], controller, r.text.translate(dict.fromkeys(map(ord, R.MARKS), "�"))), (controller, r.text)


@pytest.mark.parametrize(("pattern", "want"), [(r"(?i)\b(reboot|restart)\b", {"boot", "start"}), (r"GEAR\s*->\s*([PRND])\b", {"gear"}), (r"\d+", None), (r"(a|\d)bc", {"bc"}), (r"(?:ab)?cde+", {"cd"}), (r"x(?:long word)+y", {"long word"}), (r"é\d", None)])
def test_literals_that_a_pattern_needs(pattern, want):
    assert R.needed(pattern) == want


def test_a_tree_of_prefixes_finds_what_holds_a_word():
    rnd = random.Random(2)
    words = {"".join(rnd.choices("ab.c|", k=rnd.randint(1, 5))) for _ in range(30)}
    tree = re.compile(R.any_of(words))
    for _ in range(2000):
        text = "".join(rnd.choices("ab.c|x", k=rnd.randint(0, 8)))
        assert bool(tree.search(text)) == any(w in text for w in words)


def test_time_hardly_grows_with_the_number_of_rules(spark):
    rnd = random.Random(3)
    lines = spark.range(60000).select(F.concat(F.lit("03-01 09:59:50.000 1 2 I ActivityManager: process number "), F.col("id").cast("string"), F.lit(" was displayed in front of others")).alias("text")).cache()
    lines.count()

    def seconds(n):
        rules = tuple(R.Rule(f"r{i}", ("android",), (rf"(?i)\b{''.join(rnd.choices('abcdefghij', k=8))}\b",)) for i in range(n))
        once = lambda: lines.select(F.sum(F.size(R.hits(rules, "android", F.col("text"))))).collect()
        once()
        begun = time.time()
        once()
        return time.time() - begun

    few, many = seconds(10), seconds(200)
    lines.unpersist()
    assert many < 6 * few + 1  # twenty times the rules; a search for each would take twenty times as long


@pytest.mark.parametrize("limit", [1, 499, 500, 5000])
def test_limit_by_prefix_sums_equals_the_first_rows(spark, limit):
    rnd = random.Random(limit)
    rows = [(rnd.choice("abc"), i, rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(7)
    for top in (0, 10_000):
        got = Q.limited(df, ["k", "i"], limit, top)
        assert [(r.k, r.i, r.v) for r in got.collect()] == sorted(rows)[:limit]
        assert {r.truncated for r in got.collect()} == {limit < 500}
    assert Q.limited(df.filter("false"), ["k"], limit, 0).collect() == []
