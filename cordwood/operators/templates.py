"""Semi-structured log lines into entries and fields (problem 2).

The heads of all lines are turned into short sequences of token classes; iterative partitioning (by token count, by
the position with the fewest distinct tokens, by the mapping between two positions) splits the distinct sequences
into leaf templates with fixed tokens and variable slots. A template whose slots hold a time and a level from its
first token on is a layout: it says where time, level, component and message stand, and is compiled into the pattern
by which its lines are read. Lines of all other templates continue the entry above them. Only distinct class
sequences with their counts reach the partitioning, grouped by token count; their number is bounded by the alphabet
of classes and the head's length, not by the lines. A head is as long as it must be to reach the message.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cordwood.constants import LEVEL_SPELLINGS
from cordwood.formats.parsers import NDJSON_KEYS
from cordwood.functions.levels import normalize_level_text
from cordwood.session import cut

HEAD_TOKENS = 12
LEVEL_WITHIN = 8  # tokens outside brackets, from the first on, among which the level of a layout stands
CHUNK_LINES = 4096
_SPELLINGS = {s for names in LEVEL_SPELLINGS.values() for s in names} | {"CRT", "ERRO", "WAR"}
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_LETTER = {"V": "Verbose", "T": "Verbose", "D": "Debug", "I": "Information", "W": "Warning", "E": "Error", "F": "Fatal", "C": "Fatal"}

# Member names that hold time, level, message and exception of an event, beyond those of the formats; in lower case.
TIME_KEYS = ("@t", *NDJSON_KEYS["ts"], "datetime", "t", "when")
LEVEL_KEYS = ("@l", *NDJSON_KEYS["level"])
TEXT_KEYS = ("@m", "renderedmessage", *(k for k in NDJSON_KEYS["message"] if k != "messagetemplate"))
EXC_KEYS = ("@x", *NDJSON_KEYS["exception"])
# Member names that hold the component of an event, in lower case.
PART_KEYS = ("sourcecontext", "logger", "component", "name", "module", "application", "app", "tag", "logger_name", "appname", "category", "unit")

_TOKENS = {
    "STAMP": r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\s?(?:Z|[+-]\d{2}:?\d{2})?(?![\w:])",
    "MDAY": r"(?:" + "|".join(_MONTHS) + r")\s+\d{1,2}\s\d{2}:\d{2}:\d{2}(?:\.\d+)?",
    "GLOG": r"[VTDIWEFC]\d{4}\s\d{2}:\d{2}:\d{2}(?:\.\d+)?",
    "CLOCK": r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?![\w:])",
    "PRI": r"<\d{1,3}>",
    "PAIR": r"[A-Za-z_@][\w.@-]*=(?:\"(?:[^\"\\]|\\.)*\"|\S*)",
    "WORD": r"[^\s\[\](){}<>|:,;\"'=]+",
}
_SCAN = re.compile(r"\s*(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _TOKENS.items()) + r"|(?P<MARK>.))", re.S)
_PAIR = re.compile(r"\s*([A-Za-z_@][\w.@-]*)=(?:\"((?:[^\"\\]|\\.)*)\"|(\S*))")


def head_classes(text: str | None) -> tuple[str, ...]:
    """Classes of the first tokens of a line; () for blank lines and lines that begin with white space.

    Words become W, but levels LEVEL and numbers N; punctuation stays. Objects and key=value lines are classed by
    which of time and level their members hold. HEAD_TOKENS tokens are taken; where an entry may begin whose message
    they do not reach, twice as many, and so on, until they do.
    """
    text = (text or "").rstrip("\r\n")
    if not text.strip() or text[0].isspace():
        return ()
    if text[0] == "{":
        event = read_object(text)
        if event is None:
            return ("{",)
        return ("OBJECT", *_held(event))
    out: list[str] = []
    at, most = 0, HEAD_TOKENS
    while at < len(text):
        if len(out) == most:
            if not _goes_on(tuple(out)):
                break
            most *= 2
        m = _SCAN.match(text, at)
        if not m or m.end() == at:
            break
        kind, token = m.lastgroup, m[m.lastgroup]
        if kind == "WORD":
            kind = "LEVEL" if token.upper() in _SPELLINGS else "N" if token.isdigit() else "-" if token == "-" else "W"
        elif kind == "MARK":
            kind = token
        if kind == "PAIR" and out and out[0] != "PAIR":
            kind = "W"
        if kind == "PAIR" and len(out) == 0:
            return ("PAIR", *_held(k for k, _, _ in _PAIR.findall(text)))
        out.append(kind)
        at = m.end()
    if len(out) > HEAD_TOKENS and layout_of(tuple(out)) is None:
        out = out[:HEAD_TOKENS]
    return tuple(out)


def _held(names) -> Iterator[str]:
    """Which of time and level stand among names of members."""
    names = {k.lower() for k in names}
    return (c for c, keys in (("TIME", TIME_KEYS), ("LEVEL", LEVEL_KEYS)) if not names.isdisjoint(keys))


@functools.lru_cache(10_000)
def _goes_on(head: tuple[str, ...]) -> bool:
    """Whether an entry may begin with head whose message begins behind it, or in its last two tokens, where the mark
    may be cut off."""
    when = next((i for i, x in enumerate(head) if x not in _AHEAD), None)
    if when is None or head[when] not in _TIMES or layout_of(head[:-2]) is not None:
        return False
    t = [{x} for x in head]
    return head[when] == "GLOG" or _level_at(t) is not None or _outside(t, True) < LEVEL_WITHIN


def read_object(text: str) -> dict | None:
    try:
        event = json.loads(text, parse_float=str)  # numbers keep their digits as written
    except ValueError:
        return None
    return event if isinstance(event, dict) else None


# ---- iterative partitioning -------------------------------------------------------------------------------------


def partition(sequences: dict[tuple[str, ...], int]) -> list[tuple[tuple[str | None, ...], list[tuple[str, ...]]]]:
    """Leaf templates of token sequences with counts: (template with None for variable slots, its sequences).

    Steps: token count; the position with the fewest distinct tokens; the mapping between the two positions whose
    numbers of distinct tokens are most common (one-to-one pairs split; else the side with the fewest values splits).
    A partition is a leaf as soon as its template alone says how all its sequences are read: what still varies stands
    behind the mark of the message, or is a value ahead of it.
    """
    by_count: dict[int, dict] = {}
    for s, n in sequences.items():
        by_count.setdefault(len(s), {})[s] = n
    leaves = []
    for part in by_count.values():
        for step1 in [part] if _settled(part) else _by_position(part):
            leaves += _by_bijection(step1)
    out = [(tuple(min(c) if len(c) == 1 else None for c in _slots(leaf)), sorted(leaf)) for leaf in leaves]
    return sorted(out, key=lambda x: tuple(t or "" for t in x[0]))


def _slots(part) -> list[set[str]]:
    """The distinct tokens of each position."""
    return [set(c) for c in zip(*part)]


def _settled(part: dict) -> bool:
    slots = _slots(part)
    try:
        layout_of(tuple(min(c) if len(c) == 1 else None for c in slots), slots)
    except Unsettled:
        return False
    return True


def _cardinality(part: dict) -> list[int]:
    return [len(c) for c in _slots(part)]


def _by_position(part: dict) -> list[dict]:
    distinct = [(n, i) for i, n in enumerate(_cardinality(part)) if n > 1]
    if not distinct:
        return [part]
    position = min(distinct)[1]
    split: dict[str, dict] = {}
    for s, n in part.items():
        split.setdefault(s[position], {})[s] = n
    return list(split.values())


def _by_bijection(part: dict) -> list[dict]:
    cards = [(n, i) for i, n in enumerate(_cardinality(part)) if n > 1]
    if not cards or _settled(part):
        return [part]
    if len(cards) < 2:
        return _by_position(part)
    common = Counter(n for n, _ in cards).most_common(1)[0][0]
    at = [i for n, i in cards if n == common]
    a, b = (at + [i for _, i in cards if i not in at])[:2]
    forward, backward = {}, {}
    for s in part:
        forward.setdefault(s[a], set()).add(s[b])
        backward.setdefault(s[b], set()).add(s[a])
    split: dict[tuple, dict] = {}
    for s, n in part.items():
        one = len(forward[s[a]]) == 1 and len(backward[s[b]]) == 1
        key = (s[a], s[b]) if one else (s[a],) if len(forward) <= len(backward) else (None, s[b])
        split.setdefault(key, {})[s] = n
    return [leaf for sub in split.values() for leaf in _by_bijection(sub)]


# ---- layouts ----------------------------------------------------------------------------------------------------

_END = {":", "|", ">", "-", "]"}
_TIMES = {"STAMP", "CLOCK", "GLOG", "MDAY"}
_AHEAD = {"LEVEL", "[", "|", "<", "(", "-"}  # what may stand ahead of the time
_SOURCE = {**_TOKENS, "LEVEL": r"[A-Za-z]+", "N": r"\d+", "W": r"[^\s\[\](){}<>|:,;\"'=]+", "-": "-"}
_CLOSE = {"[": "]", "(": ")", "{": "}"}


class Unsettled(Exception):
    """A variable slot stands where the layout depends on its token."""


def _all(*answers: bool | None) -> bool:
    """Whether all hold; None is an answer that depends on a slot, and matters only if no other is False."""
    if any(x is False for x in answers):
        return False
    if any(x is None for x in answers):
        raise Unsettled
    return True


def _outside(t: list[set[str]], cut: bool = False) -> int:
    """The number of tokens outside brackets; brackets that stay open count as none, or as closed where t is cut."""
    n = i = 0
    while i < len(t):
        close = next((_CLOSE[x] for x in t[i] if x in _CLOSE), None)
        end = next((j for j in range(i + 1, len(t)) if close in t[j]), len(t) if cut else None) if close else None
        n, i = (n, end + 1) if end is not None else (n + 1, i + 1)
    return n


def _level_at(t: list[set[str]]) -> int | None:
    """The position of the level: the first one with fewer than LEVEL_WITHIN tokens outside brackets ahead of it."""
    first = next((i for i, x in enumerate(t) if "LEVEL" in x), None)
    if first is None:
        return None
    if first >= LEVEL_WITHIN:
        if any(len(x) > 1 and x & {*_CLOSE, *_CLOSE.values()} for x in t[:first]):
            raise Unsettled
        if _outside(t[:first]) >= LEVEL_WITHIN:
            return None
    if len(t[first]) > 1:
        raise Unsettled
    return first


def layout_of(template: tuple[str | None, ...], slots: list[set[str]] | None = None) -> str | None:
    """The layout of a leaf template: object, pairs, rfc5424, rfc3164, or the pattern that reads its lines; None if
    it does not begin an entry.

    Constants of the template are fixed tokens. slots has the tokens that the leaf's sequences have at each position;
    a variable slot ahead of the message is read as any of them. Unsettled is raised where the role of a slot, or of
    what follows it, is not the same for all.

    Beyond the standard ones, a layout has a time among its first three tokens, with nothing but level and brackets
    before it, and a level after (or before) it; the component is the last word ahead of the mark behind which the
    message begins.
    """
    if not template:
        return None
    t = [{x} if x is not None else slots[i] if slots else set() for i, x in enumerate(template)]

    def among(i: int, tokens: set[str]) -> bool | None:
        """Whether position i holds one of tokens; None if it depends on the sequence."""
        if not 0 <= i < len(t):
            return False
        return True if t[i] and t[i] <= tokens else None if t[i] & tokens or not t[i] else False

    for kind, name, need in (("OBJECT", "object", {"TIME"}), ("PAIR", "pairs", {"TIME", "LEVEL"})):
        if _all(among(0, {kind})):
            if need <= set(template):
                return name
            if need <= set().union(*t):
                raise Unsettled
            return None
    if _all(among(0, {"PRI"})):
        if _all(among(1, {"N"}), among(2, {"STAMP"})):
            return "rfc5424"
        return "rfc3164" if _all(among(1, {"MDAY"})) else None
    when = 0
    while not _all(among(when, _TIMES)):
        if not _all(among(when, _AHEAD)):
            return None
        when += 1
    glog = _all(among(when, {"GLOG"}))
    level = when if glog else _level_at(t)
    if level is None:
        return None
    pattern, i, dashed, seen_part = "^", 0, False, False
    while i < len(t):
        name = ""
        if i == when:
            name = "time"
        elif i == level:
            name = "level"
        elif not seen_part and i > max(when, level):
            # a word in brackets that open behind time and level is no component
            bracket = next((j for j in range(i - 1, max(when, level), -1) if t[j] & {"[", "]"}), -1)
            if _all(among(i, {"W"}), among(i + 1, _END), bracket < 0 or (t[bracket] == {"]"} if len(t[bracket]) == 1 else None)):
                name, seen_part = "part", True
        elif not seen_part and when < i < level:
            if _all(among(i, {"W"}), among(i - 1, {"-"}), among(i + 1, {"-"})):
                name, seen_part, dashed = "part", True, True
        source = _source(t[i])
        pattern += (f"(?P<{name}>{source})" if name else source) + r"\s*"
        i += 1
        if seen_part and i > level:
            if dashed and _all(among(i, {"-"})):
                return pattern + r"-\s?"
            if not dashed and name == "part":
                if _all(among(i, {":"}), among(i + 1, {"N"}), among(i + 2, {"]"})):
                    return pattern + r":\d+\]\s?"
                return pattern + _source(t[i]) + r"\s?"
    return None


def _source(tokens: set[str]) -> str:
    """The pattern of a token, or of a slot that holds any of tokens."""
    found = [_SOURCE.get(x, re.escape(x)) for x in sorted(tokens)]
    return found[0] if len(found) == 1 else "(?:" + "|".join(found) + ")"


# ---- fields -----------------------------------------------------------------------------------------------------

_STAMP = re.compile(r"^(\d{4})[-/](\d{2})[-/](\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?\s?(Z|z|[+-]\d{2}(?::?\d{2})?)?$")
_EPOCH = dt.datetime(1970, 1, 1)
_5424 = re.compile(r"^<(\d{1,3})>\d+ (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: (.*))?$", re.S)
_3164 = re.compile(r"^<(\d{1,3})>((?:" + "|".join(_MONTHS) + r")\s+\d{1,2} \d{2}:\d{2}:\d{2}(?:\.\d+)?) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?: ?(.*)$", re.S)
_HOLE = re.compile(r"\{[@$]?([0-9A-Za-z_]+)(?:[,:][^}]*)?\}")
_SYSLOG = ("Fatal", "Fatal", "Fatal", "Error", "Warning", "Information", "Information", "Debug")


def _micros(y: int, mo: int, d: int, h: int, mi: int, s: int, fraction: str | None, zone: str | None) -> int | None:
    try:
        at = dt.datetime(y, mo, d, h, mi, s)
    except ValueError:
        return None
    us = ((at - _EPOCH) // dt.timedelta(seconds=1)) * 1_000_000 + int(((fraction or "") + "000000")[:6])
    if zone and zone not in "Zz":
        sign = -1 if zone[0] == "-" else 1
        digits = zone[1:].replace(":", "")
        us -= sign * (int(digits[:2]) * 60 + int(digits[2:] or 0)) * 60_000_000
    return us


def read_time(raw, read_at: dt.datetime | None) -> int | None:
    """Microseconds of a stamp in any layout's notation; a missing year or date is that of read_at."""
    if isinstance(raw, bool) or raw is None:
        return None
    text = str(raw).strip()
    m = _STAMP.match(text)
    if m:
        return _micros(*map(int, m.groups()[:6]), m[7], m[8])
    if re.fullmatch(r"\d{1,19}(?:\.\d+)?", text):
        whole, _, fraction = text.partition(".")
        n = int(whole)
        if n < 100_000_000_000:
            return n * 1_000_000 + int((fraction + "000000")[:6])
        return n * 1000 if n < 100_000_000_000_000 else n if n < 100_000_000_000_000_000 else n // 1000
    day = read_at or _EPOCH
    m = re.match(r"^(\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?$", text)
    if m:
        return _micros(day.year, day.month, day.day, int(m[1]), int(m[2]), int(m[3]), m[4], None)
    m = re.match(r"^[A-Z](\d{2})(\d{2})\s(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?$", text)
    if m:
        return _micros(day.year, *map(int, m.groups()[:5]), m[6], None)
    m = re.match(r"^([A-Z][a-z]{2})\s+(\d{1,2})\s(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?$", text)
    if m and m[1] in _MONTHS:
        return _micros(day.year, _MONTHS.index(m[1]) + 1, *map(int, m.groups()[1:5]), m[6], None)
    return None


def _text(v) -> str:
    return v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _first(event: dict, keys: tuple[str, ...]):
    lower: dict = {}
    for k, v in event.items():
        lower.setdefault(k.lower(), v)
    return next((lower[k] for k in keys if lower.get(k) is not None), None)


def _fill(template: str, properties: dict) -> str:
    return _HOLE.sub(lambda m: _text(properties[m[1]]) if m[1] in properties else m[0], template)


def _unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text, flags=re.S)


def read_head(text: str, layout: str, read_at: dt.datetime | None):
    """(utc_us, level, component, message, exception) of an entry's first line, or None if it does not fit."""
    text = text.rstrip("\r\n")
    if layout == "object":
        event = read_object(text)
        if event is None:
            return None
        when = read_time(_first(event, TIME_KEYS), read_at)
        inner = event.get("Properties") if isinstance(event.get("Properties"), dict) else {}
        message = _first(event, TEXT_KEYS)
        template = event.get("@mt") if "@mt" in event else event.get("MessageTemplate")
        if message is None and template is not None:
            message = _fill(_text(template), {**event, **inner})
        part = _first(inner, PART_KEYS)
        part = part if part is not None else _first(event, PART_KEYS)
        level = _first(event, LEVEL_KEYS)
        return (when, normalize_level_text(_text(level)), _text(part), _text(message), _text(_first(event, EXC_KEYS)))
    if layout == "pairs":
        event = {}
        for k, quoted, bare in _PAIR.findall(text):
            event.setdefault(k, bare if bare else _unescape(quoted))
        return (
            read_time(_first(event, TIME_KEYS), read_at), normalize_level_text(_first(event, LEVEL_KEYS)), _first(event, PART_KEYS) or "",
            _first(event, TEXT_KEYS) or "", _first(event, EXC_KEYS) or "",
        )
    if layout == "rfc5424":
        m = _5424.match(text)
        return m and (read_time(m[2], read_at), _SYSLOG[int(m[1]) % 8], "" if m[4] == "-" else m[4], (m[8] or "").removeprefix("﻿"), "")
    if layout == "rfc3164":
        m = _3164.match(text)
        return m and (read_time(m[2], read_at), _SYSLOG[int(m[1]) % 8], m[4], m[6], "")
    m = _compiled(layout).match(text)
    if not m:
        return None
    found = m.groupdict()
    level = _LETTER.get(found["time"][0]) if "level" not in found else normalize_level_text(found["level"])
    return (read_time(found["time"], read_at), level, found.get("part") or "", text[m.end() :], "")


_PATTERNS: dict[str, re.Pattern] = {}


def _compiled(pattern: str) -> re.Pattern:
    if pattern not in _PATTERNS:
        _PATTERNS[pattern] = re.compile(pattern)
    return _PATTERNS[pattern]


# ---- the operator -----------------------------------------------------------------------------------------------

_FRAME = re.compile(r"^\s+at\s+\S.*\(.*\)?")
_EXCEPTION = re.compile(r"^([A-Za-z_$][\w$`]*(?:[.+][A-Za-z_$][\w$`]*)*)(?::(?:\s|$)|\s*$)")


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen = Counter("\x1f".join(head_classes(t)) for t in pdf["text"])
        yield pd.DataFrame({"head": list(seen), "n": list(seen.values())})


def leaf_templates(lines: DataFrame) -> DataFrame:
    """template (classes by blank, * for variable slots), layout (null: no entry begins so), head, n: every distinct
    head of all lines with its leaf. Null texts count as blank lines."""
    heads = lines.select("text").mapInPandas(_classes, "head string, n long").groupBy("head").agg(F.sum("n").alias("n"))
    heads = heads.withColumn("tokens", F.size(F.split("head", "\x1f")))

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {tuple(h.split("\x1f")) if h else (): int(n) for h, n in zip(pdf["head"], pdf["n"])}
        rows = []
        for template, members in partition(counts):
            layout = layout_of(template, _slots(members))
            rows += [(" ".join(x or "*" for x in template), layout, "\x1f".join(m), counts[m]) for m in members]
        return pd.DataFrame(rows, columns=["template", "layout", "head", "n"])

    return heads.groupBy("tokens").applyInPandas(leaves, "template string, layout string, head string, n long")


def layouts(lines: DataFrame, most: int = 1_000_000) -> dict[str, str]:
    """Layout of every head that begins an entry. Heads are sequences of at most HEAD_TOKENS classes; beyond most of
    them this raises, as the lines then have no layouts worth the name."""
    rows = leaf_templates(lines).where("layout is not null").select("head", "layout").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct heads")
    return {r.head: r.layout for r in rows}


def parse_lines(lines: DataFrame, message: bool = True) -> DataFrame:
    """source, line_number, blank, is_head, utc_us, level, component, msg_chars, message (null without message), member
    (exception type of the head's exception member), frame, trace (a Python traceback begins), raised (type named by
    the line)."""
    known = lines.sparkSession.sparkContext.broadcast(layouts(lines))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = known.value
        for pdf in batches:
            rows = []
            for source, number, text, at in zip(pdf["source"], pdf["line_number"], pdf["text"], pdf["read_at"]):
                text = (text or "").rstrip("\r\n")
                layout = mine.get("\x1f".join(head_classes(text)))
                got = read_head(text, layout, None if pd.isna(at) else at.to_pydatetime()) if layout else None
                if got and got[0] is not None:
                    when, level, part, said, exc = got
                    m = _EXCEPTION.match(exc.lstrip().split("\n", 1)[0]) if exc else None
                    rows.append((source, number, False, True, when, level, part, len(said), said if message else None, m[1] if m else None, False, False, None))
                else:
                    m = _EXCEPTION.match(text)
                    rows.append((source, number, not text.strip(), False, None, None, None, None, None, None, bool(_FRAME.match(text)), text.startswith("Traceback (most recent call last)"), m[1] if m else None))
            yield pd.DataFrame(rows, columns=_NAMES)

    return lines.select("source", "line_number", "text", "read_at").mapInPandas(read, _SCHEMA)


_SCHEMA = (
    "source string, line_number long, blank boolean, is_head boolean, utc_us long, level string, component string, "
    "msg_chars long, message string, member string, frame boolean, trace boolean, raised string"
)
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def entries(lines: DataFrame, message: bool = True) -> DataFrame:
    """source, line_number, n_lines, utc_us, level, component, msg_chars, exc_type, message: one row per entry.

    An entry begins at a line in some layout and holds all lines up to the next such line of its source; n_lines
    counts to its last non-blank line. Lines above the first entry of a source belong to none. Rows with null source
    or line_number are dropped; copies of a line count once. exc_type is the type in the head's exception member,
    else that of the entry's first stack trace: the type named last above the first frame, or below a Python
    traceback; '' without any. Sources are worked on in chunks of CHUNK_LINES lines, and what a chunk hands on to the
    next (last head, last type named, last traceback) is carried over chunk summaries, so a large source is spread
    over many tasks. The lines as read are exchanged once and kept, since both the summaries and the rows need them.
    """
    rows = parse_lines(lines, message).where("source is not null and line_number is not null")
    rows = rows.withColumn("chunk", F.floor(F.col("line_number") / CHUNK_LINES)).repartition("source", "chunk")
    order = W.partitionBy("source", "chunk").orderBy("line_number")
    again = F.lag("line_number").over(order).eqNullSafe(F.col("line_number"))
    rows = rows.withColumn("_again", again).where("not _again").drop("_again")
    upto, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    head = F.when(F.col("is_head"), F.col("line_number"))
    named = F.when(F.col("raised").isNotNull(), F.struct("line_number", "raised"))
    trace = F.when(F.col("trace"), F.col("line_number"))
    rows = rows.withColumns({
        "_head": F.last(head, True).over(upto), "_named": F.last(named, True).over(before), "_trace": F.last(trace, True).over(before),
    })
    rows = cut(rows)
    sums = rows.groupBy("source", "chunk").agg(F.max(head).alias("_h"), F.max(named).alias("_n"), F.max(trace).alias("_t"))
    past = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "chunk", F.max("_h").over(past).alias("_h"), F.max("_n").over(past).alias("_n"), F.max("_t").over(past).alias("_t"))
    rows = rows.join(sums, ["source", "chunk"]).withColumns({
        "_head": F.coalesce("_head", "_h"), "_named": F.coalesce("_named", "_n"), "_trace": F.coalesce("_trace", "_t"),
    }).where("_head is not null")
    inside = F.col("_named.line_number") > F.col("_head")
    framed = F.when(F.col("frame") & inside, F.struct(F.col("line_number").alias("at"), F.col("_named.raised").alias("type")))
    closing = F.col("raised").isNotNull() & (F.col("_trace") > F.col("_head")) & (~F.coalesce(inside, F.lit(False)) | (F.col("_named.line_number") < F.col("_trace")))
    closed = F.when(closing, F.struct(F.col("_trace").alias("at"), F.col("raised").alias("type")))
    fields = ("utc_us", "level", "component", "msg_chars", "message", "member")
    done = rows.groupBy("source", F.col("_head").alias("line_number")).agg(
        (F.max(F.when(~F.col("blank"), F.col("line_number")))).alias("_last"),
        F.max(F.when(F.col("is_head"), F.struct(*fields))).alias("_f"),
        F.min(F.coalesce(framed, closed)).alias("_exc"),
    )
    return done.select(
        "source", "line_number", (F.col("_last") - F.col("line_number") + 1).alias("n_lines"), *[F.col(f"_f.{c}").alias(c) for c in fields[:4]],
        F.coalesce("_f.member", "_exc.type", F.lit("")).alias("exc_type"), "_f.message",
    )


def found(lines: DataFrame) -> DataFrame:
    return entries(lines, False).drop("message")


# ---- messages ---------------------------------------------------------------------------------------------------

VALUES = 0.25  # share of a partition's lines from which on the distinct tokens of a position are values


def message_templates(rows: DataFrame, message: str = "message") -> DataFrame:
    """rows with template (tokens joined by blanks, * for a variable slot) and slots (the tokens at its variable
    slots, in order).

    Iterative partitioning over all messages, each step one aggregation that is combined before the shuffle and sends
    back one row per partition: by token count; by the token at the position with the fewest distinct ones; by the
    mapping between the two positions that most often have the same number of distinct tokens - pairs that map one to
    one split by both, else the side with fewer tokens splits. Positions whose distinct tokens number more than VALUES
    of a partition's lines hold values and split nothing. Null and blank messages have no tokens and an empty
    template. Partitions are known by hashes of what they were split by.
    """
    rows = rows.withColumns({"_tokens": F.filter(F.split(F.trim(F.coalesce(F.col(message), F.lit(""))), r"\s+"), lambda x: x != "")})
    rows = rows.withColumn("_p", F.xxhash64(F.size("_tokens")))
    token = lambda i: F.coalesce(F.get("_tokens", F.col(i)), F.lit(""))

    def positions(rows: DataFrame) -> DataFrame:
        """_p, _n (lines), _d (distinct tokens of each position)."""
        each = rows.select("_p", F.posexplode("_tokens").alias("_i", "_t")).groupBy("_p", "_i").agg(F.approx_count_distinct("_t", 0.02).alias("_c"), F.count("*").alias("_m"))
        return each.groupBy("_p").agg(F.max("_m").alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_c"))), lambda x: x["_c"]).alias("_d"))

    def splits(d: Column, n: Column) -> Column:
        """(distinct tokens, position) of the positions that may split a partition."""
        both = F.transform(d, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        return F.filter(both, lambda x: (x["c"] > 1) & (x["c"] <= F.greatest(n * VALUES, F.lit(1))))

    by = positions(rows).select("_p", F.array_min(splits(F.col("_d"), F.col("_n")))["i"].alias("_at"))
    rows = rows.join(by, "_p", "left").withColumn("_p", F.when(F.col("_at").isNotNull(), F.xxhash64("_p", token("_at"))).otherwise(F.col("_p"))).drop("_at")

    able = splits(F.col("_d"), F.col("_n"))
    often = lambda x: F.size(F.filter("_able", lambda y: y["c"] == x["c"]))
    ranked = F.array_sort(F.transform("_able", lambda x: F.struct((-often(x)).alias("o"), x["c"].alias("c"), x["i"].alias("i"))))
    pair = positions(rows).withColumn("_able", able).withColumn("_r", ranked).where(F.size("_r") >= 2)
    pair = pair.select("_p", F.get("_r", F.lit(0))["i"].alias("_a"), F.get("_r", F.lit(1))["i"].alias("_b"), F.get("_r", F.lit(0))["c"].alias("_ca"), F.get("_r", F.lit(1))["c"].alias("_cb"))
    rows = rows.join(pair, "_p", "left")
    seen = rows.where("_a is not null").select("_p", token("_a").alias("_ta"), token("_b").alias("_tb")).distinct()
    ones = seen.groupBy("_p", "_ta").agg(F.count("*").alias("_fa"), F.min("_tb").alias("_one")).where("_fa = 1")
    twos = seen.groupBy("_p", "_tb").agg(F.count("*").alias("_fb")).where("_fb = 1")
    single = ones.join(twos.select("_p", F.col("_tb").alias("_one")), ["_p", "_one"]).select("_p", "_ta", F.lit(True).alias("_single"))
    rows = rows.withColumn("_ta", token("_a")).join(single, ["_p", "_ta"], "left")
    split = F.when(F.col("_a").isNull(), F.col("_p")).when(F.col("_single"), F.xxhash64("_p", token("_a"), token("_b")))
    rows = rows.withColumn("_p", split.when(F.col("_ca") <= F.col("_cb"), F.xxhash64("_p", token("_a"))).otherwise(F.xxhash64("_p", F.lit("b"), token("_b")))).drop("_a", "_b", "_ca", "_cb", "_ta", "_single")

    each = rows.select("_p", F.posexplode("_tokens").alias("_i", "_t")).groupBy("_p", "_i").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    leaf = each.groupBy("_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("t")))), lambda x: x["t"]).alias("_leaf"))
    rows = rows.join(leaf, "_p", "left")
    fixed = F.coalesce("_leaf", F.array().cast("array<string>"))
    slots = F.transform(F.filter(F.transform("_tokens", lambda t, i: F.struct(t.alias("t"), F.get("_leaf", i).alias("f"))), lambda x: x["f"].isNull()), lambda x: x["t"])
    return rows.withColumns({"template": F.array_join(F.transform(fixed, lambda t: F.coalesce(t, F.lit("*"))), " "), "slots": slots}).drop("_p", "_tokens", "_leaf")


def messages(lines: DataFrame) -> DataFrame:
    """source, line_number, template, slots of the message of every entry."""
    kept = cut(entries(lines).select("source", "line_number", "message"))
    return message_templates(kept).select("source", "line_number", "template", "slots")
