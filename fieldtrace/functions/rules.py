"""Declarative rules compiled to column expressions: events and anchors, line filter, file classification.

Per controller all patterns of a kind become one alternation.  Matches are leftmost and do not overlap, and the first
alternative that matches takes the text; each match is a hit.  `all_words` patterns add one hit for a line that holds
every word.  One column per kind and controller, `hits(...)`, yields an array of rule numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    controllers: tuple[str, ...]
    regexes: tuple[str, ...] = ()
    any_words: tuple[str, ...] = ()
    all_words: tuple[str, ...] = ()
    fields: dict[str, str] = field(default_factory=dict)  # name -> pattern; its group 1, else the match
    confidence: float = 1.0


ALL = ("android", "mcu", "kernel", "tbox", "fota")

# Event types and their patterns.
EVENT_RULES = (
    Rule("system_reboot", ALL, (r"(?i)\b(reboot|restart|rebooting)\b",), fields={"reason": r"reason=([\w-]+)"}),
    Rule("system_boot", ALL, (r"(?i)\b(boot completed|system started|init done|booting linux)\b",)),
    Rule("fota_notify", ("android", "fota", "tbox"), (r"(?i)\bota\b.{0,20}\bavailable\b",), ("FOTA notify", "fota_notify", "ota notification")),
    Rule("fota_download_start", ("android", "fota", "tbox"), any_words=("start downloading", "start to download"), all_words=("fota", "download", "start")),
    Rule("fota_install_start", ("android", "fota", "mcu", "tbox"), any_words=("install start", "begin install", "start install", "start flashing")),
    Rule("fota_install_success", ("android", "fota", "mcu", "tbox"), any_words=("install success", "install complete", "flash done", "fota success")),
    Rule("fota_install_failure", ("android", "fota", "mcu", "tbox"), (r"(?i)\b(?:fota|install)\b.{0,40}\b(?:fail|failed|abort)\b",)),
    Rule("gear_shift", ("mcu",), (r"GEAR\s*->\s*([PRND])\b",), fields={"gear": r"GEAR\s*->\s*([PRND])\b"}),
    Rule("door_open", ("mcu",), (r"DOOR_(FL|FR|RL|RR|TRUNK)_OPEN",), fields={"door": r"DOOR_(FL|FR|RL|RR|TRUNK)_OPEN"}),
    Rule("door_close", ("mcu",), (r"DOOR_(FL|FR|RL|RR|TRUNK)_CLOSE",), fields={"door": r"DOOR_(FL|FR|RL|RR|TRUNK)_CLOSE"}),
    Rule("charging_start", ("mcu", "tbox"), any_words=("charging started", "CHG_START", "charge_begin")),
    Rule("charging_end", ("mcu", "tbox"), any_words=("charging stopped", "CHG_END", "charge_complete")),
    Rule("brake_event", ("mcu",), (r"(?i)brake.{0,10}\bpressed\b|EBS\s+active",)),
    Rule("vehicle_unlock", ("tbox", "mcu"), any_words=("UNLOCK_OK", "vehicle unlock")),
    Rule("vehicle_lock", ("tbox", "mcu"), any_words=("LOCK_OK", "vehicle locked")),
    Rule("panic_or_fatal", ALL, (r"(?i)\b(?:kernel\s+panic|fatal\s+exception|oom-killer\s+invoked|kernel\s+bug)\b",)),
    Rule("kernel_call_trace", ("kernel",), (r"(?i)\bCall\s+trace:\s*$",)),
    Rule("kernel_oops_or_bug", ("kernel",), (r"(?i)\b(?:Oops|BUG|Internal\s+error)\s*[: ]",)),
    Rule("kernel_watchdog", ("kernel",), any_words=("watchdog", "WDOG", "wdt:")),
    Rule("kernel_warning", ("kernel",), (r"\bWARNING:\s+CPU:\s*\d+\s+PID:\s*\d+\s+at\s+",)),
)
# Anchor types and their confidence.
ANCHOR_RULES = (
    Rule("system_boot", ALL, (r"(?i)\b(boot completed|system started|init done|booting linux)\b",), confidence=0.90),
    Rule("network_connected", ("android", "fota", "tbox"), any_words=("network connected", "wifi connected", "network is connected"), confidence=0.85),
    Rule("fota_download_start", ("android", "fota", "mcu", "tbox"), any_words=("start downloading", "start to download"), all_words=("fota", "download", "start"), confidence=0.95),
    Rule("fota_install_start", ("android", "fota", "mcu", "tbox"), any_words=("install start", "begin install", "start install", "start flashing"), confidence=0.95),
    Rule("system_reboot", ALL, (r"(?i)\b(reboot|restart|rebooting)\b",), confidence=0.90),
    Rule("tbox_clock_sync", ("tbox", "mcu", "kernel"), any_words=("rtc set hw", "time sync", "gps time", "ntp sync", "clock sync"), confidence=0.98),
)
# Lines that the slim format drops, and keeps in any case.
SLIM_DROP = {
    "android": (r"(?i)I/ActivityManager.*Displayed", r"^\s*V/", r"I/chatty.*identical.*lines", r"^\s*\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3,6}\s+\d+\s+\d+\s+D\s"),
    "kernel": (r"(?i)\baudit:", r"(?i)wlan: rate", r"(?i)\bnomatch\b"),
    "tbox": (r"(?i)\bheartbeat\b", r"(?i)\bkeepalive\b", r"(?i)\bping\b.{0,40}\bok\b"),
    "fota": (r"(?i)\bping\b.{0,40}\bok\b",),
}
SLIM_KEEP = (r"(?i)\bpanic\b", r"(?i)\bfatal\b", r"(?i)\bexception\b", r"(?i)\bBUG:\s", r"(?i)\boom-killer\b", r"(?i)\babort\b", r"(?i)\bsegfault\b")


@dataclass(frozen=True)
class FileRule:
    controller: str
    paths: tuple[str, ...]
    names: tuple[str, ...]
    content: tuple[str, ...]


# Where files of a controller lie, what they are called and how they begin; in order of priority.
# File names that carry a maker's brand are left to `extra_names`.
FILE_RULES = (
    FileRule("ibdu", ("**/iBDU/**", "**/ibdu/**"), ("iBDU_[0-9]*_[0-9]*.txt", "ibdu_*.log"), (r"^\[\d{4}\.\d{2}\.\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}\]",)),
    FileRule("mcu", ("**/mcu/**", "**/MCU/**", "**/整车控制器/**"), ("mcu*.log", "mcu*.txt", "MCU_[0-9]*_[0-9]*.txt"), (r"^&\d+\s+(?:INF|WRN|ERR|DBG)@",)),
    FileRule("tbox", ("**/网关&Tbox日志/**", "**/tbox/**", "**/TBOX/**"), ("*.dlt", "dlt_offlinetrace.*", "activelog_*", "tbox*.log", "tbox*.txt"), (r"\ADLT\x01", r"^\[TBOX\]")),
    FileRule("fota", ("**/娱乐系统日志/fota/**", "**/fota/**", "**/FOTA/**"), ("fotaHMI_*.log", "fota*.log", "fotapackage.db", "flash_id.txt"), (r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}.*\[FOTA",)),
    FileRule("kernel", ("**/娱乐系统日志/kernel/**", "**/娱乐系统日志/kernel_logs/**", "**/kernel/**", "**/kernel_logs/**"), ("kernel*.log", "kernel_*.zip", "dmesg*", "[0-9]*_[0-9]*-*-*_*-*-*.log"), (r"^\[\s*\d+\.\d+\]",)),
    FileRule("android", ("**/娱乐系统日志/android/**", "**/android/**", "**/sys_log/**"), ("logcat*", "main*.log", "event-log-tags"), (r"^\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3,6}\s+\d+\s+\d+\s+[VDIWEF]\s+",)),
)
SNIFF_BYTES = 8192


def load_rules(path: str, kind: str) -> tuple[Rule, ...]:
    """A user's rules of a kind (`events` or `anchors`) from a YAML or JSON file.

    An entry has `type`, `applies_to`, `patterns` (each with `regex`, `keyword_any` or `keyword_all`), and may have
    `fields` (name to pattern) and `confidence`.
    """
    out = []
    for entry in _read(path).get(kind) or []:
        if not isinstance(entry, dict) or not entry.get("type") or not entry.get("applies_to"):
            raise ValueError(f"{path}: a rule needs `type` and `applies_to`: {entry!r}")
        pick = lambda name, e=entry: [p[name] for p in e.get("patterns") or () if p.get(name)]
        words = lambda name, pick=pick: tuple(w for ws in pick(name) for w in ws)
        fields = {k: v if isinstance(v, str) else v["regex"] for k, v in (entry.get("fields") or {}).items()}
        for pattern in (*pick("regex"), *fields.values()):
            re.compile(pattern)
        confidence = entry.get("confidence")
        out.append(Rule(entry["type"], tuple(entry["applies_to"]), tuple(pick("regex")), words("keyword_any"), words("keyword_all"), fields, 1.0 if confidence is None else float(confidence)))
    return tuple(out)


def load_slim(path: str) -> tuple[dict[str, tuple[str, ...]], tuple[str, ...]]:
    """(drop by controller, keep) of a user's line filter from a YAML or JSON file, as `slim_keeps` takes them."""
    spec, drop = _read(path).get("slim") or {}, {}
    for group in spec.get("drop") or []:
        drop[group["controller"]] = (*drop.get(group["controller"], ()), *group["patterns"])
    return drop, tuple(spec.get("keep_always") or ())


def load_files(path: str) -> tuple[FileRule, ...]:
    """A user's rules for files from a YAML or JSON file.

    An entry below `controllers` has a `type`, and may have `path_patterns`, `name_patterns` and `content_signatures`, each
    with `magic_bytes`, which begin a file, or a `regex`.  `priority_order` lists types; those not listed come last, as they
    stand.
    """
    spec, out = _read(path), []
    for entry in spec.get("controllers") or []:
        if not isinstance(entry, dict) or not entry.get("type"):
            raise ValueError(f"{path}: a rule for files needs `type`: {entry!r}")
        content = []
        for sign in entry.get("content_signatures") or ():
            pattern = r"\A" + re.escape(sign["magic_bytes"]) if sign.get("magic_bytes") else sign["regex"]
            re.compile(pattern)
            content.append(pattern)
        out.append(FileRule(entry["type"], tuple(entry.get("path_patterns") or ()), tuple(entry.get("name_patterns") or ()), tuple(content)))
    order = {name: i for i, name in enumerate(spec.get("priority_order") or ())}
    return tuple(sorted(out, key=lambda r: order.get(r.controller, len(order))))


def _read(path: str) -> dict:
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def scoped(pattern: str) -> str:
    """The pattern as a group of its own: leading flags hold within it, and named groups become plain ones."""
    plain = re.sub(r"\(\?P<[A-Za-z_]\w*>", "(", pattern)
    flags = re.match(r"\(\?([a-zA-Z]+)\)", plain)
    return f"(?{flags[1]}:{plain[flags.end() :]})" if flags else f"(?:{plain})"


def alternatives(rules: tuple[Rule, ...], controller: str) -> list[tuple[int, str]]:
    """(rule number, pattern) in the order in which they are tried."""
    out = []
    for i, rule in enumerate(rules):
        if controller in rule.controllers:
            out += [(i, scoped(p)) for p in rule.regexes]
            if rule.any_words:
                out.append((i, "(?i:" + "|".join(map(re.escape, rule.any_words)) + ")"))
    return out


def needed(pattern: str) -> set[str] | None:
    """Literals, lower-cased, of which every match of the pattern holds one; None where none can be told."""

    def best(found: list[set[str]]) -> set[str] | None:
        return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)

    def of(parts) -> set[str] | None:
        found, run = [], ""
        for op, arg in [*parts, (None, None)]:
            name = str(op)
            if name == "LITERAL" and arg < 128:
                run += chr(arg).lower()
                continue
            if run:
                found.append({run})
                run = ""
            if name == "SUBPATTERN":
                found += [x for x in [of(arg[3])] if x]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                found += [x for x in [of(arg[2])] if x]
            elif name == "ATOMIC_GROUP":
                found += [x for x in [of(arg)] if x]
            elif name == "BRANCH":
                each = [of(x) for x in arg[1]]
                found += [set().union(*each)] if all(each) else []
        return best(found)

    return of(list(re._parser.parse(pattern)))


def any_of(words: set[str]) -> str:
    """A pattern of any of the words that looks at each character of a text a few times, however many words there are: a tree of prefixes."""
    tree: dict = {}
    for w in sorted(words):
        at = tree
        for c in w:
            if "" in at:
                break  # a shorter word is found first
            at = at.setdefault(c, {})
        else:
            at.clear()
            at[""] = {}

    def written(at: dict) -> str:
        branches = [re.escape(c) + written(rest) for c, rest in at.items() if c]
        return "" if "" in at else branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"

    return written(tree)


#: What stands between groups of a marked match: characters that no text holds, as they are set aside for programs.
MARKS = "\ufdd0\ufdd1\ufdd2"


def hits(rules: tuple[Rule, ...], controller: str, text: Column) -> Column:
    """Array of rule numbers that a line of this controller hits, in order of place, then of `all_words` rules.

    A line is looked at once for literals that some pattern needs; few lines have one.  These are searched once: each match
    is replaced by its groups between marks, and the first group that is not empty names the rule.
    """
    tried = alternatives(rules, controller)
    words = [(i, r.all_words) for i, r in enumerate(rules) if controller in r.controllers and r.all_words]
    none = F.array().cast("array<int>")
    found = none
    if tried:
        combined, groups, at = "|".join(f"({p})" for _, p in tried), [], 1
        for _, p in tried:
            groups.append(at)
            at += 1 + re.compile(p).groups
        begin, between, end = MARKS
        # Java reads as many digits of a group's number as there are groups: a mark ends each number.
        marked = F.regexp_replace(F.translate(text, MARKS, "\ufffd" * 3), F.lit(combined), F.lit(begin + "".join(f"${g}{between}" for g in groups) + end))
        each = F.slice(F.split(marked, begin), 2, F.size(F.split(marked, begin)))
        number = F.array(*(F.lit(i) for i, _ in tried))

        def named(piece: Column) -> Column:
            got = F.split(F.substring_index(piece, end, 1), between)
            first = F.array_position(F.transform(got, lambda g: g != ""), F.lit(True))
            return F.when(first > 0, F.get(number, (first - 1).cast("int")))

        matches = F.filter(F.transform(each, named), lambda x: x.isNotNull())
        literals = [needed(p) for _, p in tried]
        likely = text.rlike("(?i)" + any_of(set().union(*literals))) if all(literals) else text.rlike(combined)
        found = F.when(likely, matches).otherwise(none)
    low = F.lower(text)
    for i, ws in words:
        every = F.lit(True)
        for w in ws:
            every = every & low.contains(w.lower())
        found = F.concat(found, F.when(every, F.array(F.lit(i))).otherwise(none))
    return found


def line_hits(rules: tuple[Rule, ...], controller: Column, text: Column) -> Column:
    """`hits` by the controller of each line."""
    out = F.array().cast("array<int>")
    for name in sorted({c for r in rules for c in r.controllers}, reverse=True):
        out = F.when(controller == name, hits(rules, name, text)).otherwise(out)
    return out


def rule_names(rules: tuple[Rule, ...], number: Column) -> Column:
    return F.get(F.array(*(F.lit(r.name) for r in rules)), number)


def rule_confidence(rules: tuple[Rule, ...], number: Column) -> Column:
    return F.get(F.array(*(F.lit(r.confidence) for r in rules)), number)


def rule_fields(rules: tuple[Rule, ...], number: Column, text: Column) -> Column:
    """Fields of the rule, searched in the whole line; a field without match is null."""
    out = F.create_map().cast("map<string,string>")
    for i, rule in enumerate(rules):
        if rule.fields:
            pairs = []
            for name, pattern in rule.fields.items():
                group = 1 if re.compile(pattern).groups else 0
                pairs += [F.lit(name), F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))]
            out = F.when(number == i, F.create_map(*pairs)).otherwise(out)
    return out


def slim_keeps(controller: Column, text: Column, drop: dict[str, tuple[str, ...]] = SLIM_DROP, keep: tuple[str, ...] = SLIM_KEEP) -> Column:
    """Whether the slim format shows a line: kept in any case, or not dropped for its controller."""
    always = text.rlike("|".join(map(scoped, keep))) if keep else F.lit(False)
    dropped = F.lit(False)
    for name, patterns in drop.items():
        dropped = dropped | ((controller == name) & text.rlike("|".join(map(scoped, patterns))))
    return always | ~dropped


def glob(pattern: str) -> str:
    """A path glob as an anchored regex: ** any depth with its slash, * and ? within a name, [...] as it is."""
    out, rest = "", pattern
    while rest:
        if m := re.match(r"\*\*/?", rest):
            out += ".*"
        elif m := re.match(r"\*", rest):
            out += "[^/]*"
        elif m := re.match(r"\?", rest):
            out += "[^/]"
        elif m := re.match(r"\[[^\]]*\]", rest):
            out += m[0]
        else:
            m = re.match(r".", rest, re.S)
            out += re.escape(m[0])
        rest = rest[m.end() :]
    return f"^{out}$"


def classify(path: Column, name: Column, head: Column, rules: tuple[FileRule, ...] = FILE_RULES, extra_names: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Controller of a file: all path rules by priority, then all name rules, then what its first bytes look like."""
    out = F.lit("unknown")
    sniffed = F.decode(F.substring(head, 1, SNIFF_BYTES), "ISO-8859-1")
    for rule in reversed(rules):
        if rule.content:
            out = F.when(sniffed.rlike("(?m)" + "|".join(map(scoped, rule.content))), rule.controller).otherwise(out)
    for rule in reversed(rules):
        names = (*rule.names, *(extra_names or {}).get(rule.controller, ()))
        if names:
            out = F.when(name.rlike("|".join(map(glob, names))), rule.controller).otherwise(out)
    for rule in reversed(rules):
        if rule.paths:
            within = "|".join(map(glob, rule.paths))
            out = F.when(F.concat(F.lit("/"), path).rlike(within) | path.rlike(within), rule.controller).otherwise(out)
    return out
