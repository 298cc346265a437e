"""Layouts of log lines: literal anchors, anchored expressions, field decoding.

A line is routed by the literals that occur in it (one Aho-Corasick pass over
the line), the candidate layouts are verified by an anchored expression in a
fixed order, and the first that fits gives the fields. A line that no layout
fits is no head of an entry.
"""

from __future__ import annotations

import calendar
import json
import re
from collections.abc import Callable
from typing import NamedTuple

import ahocorasick

# Spellings of levels, and what they stand for.
LEVELS = {
    "trace": "trace", "trc": "trace", "verbose": "trace", "finest": "trace",
    "debug": "debug", "dbg": "debug", "fine": "debug",
    "info": "info", "inf": "info", "information": "info", "informational": "info", "notice": "info",
    "warn": "warn", "warning": "warn", "wrn": "warn",
    "error": "error", "err": "error", "severe": "error",
    "fatal": "fatal", "critical": "fatal", "crit": "fatal", "ftl": "fatal", "alert": "fatal", "emerg": "fatal",
    "emergency": "fatal", "panic": "fatal",
    "t": "trace", "d": "debug", "i": "info", "n": "info", "w": "warn", "e": "error", "f": "fatal", "c": "fatal",
}
# Syslog severities 0 to 7.
SYSLOG = ("fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug")
# Month names.
MONTHS = {m: i for i, m in enumerate(("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), 1)}
# Keys of structured lines.
TIME_KEYS = ("time", "@timestamp", "timestamp", "ts", "t", "date")
LEVEL_KEYS = ("level", "severity", "lvl", "loglevel", "levelname")
NAME_KEYS = ("logger", "component", "mod", "module", "name", "program", "caller", "source", "file")
TEXT_KEYS = ("msg", "message", "text")

COLOUR = re.compile(r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07]*\x07")
_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d{1,9}))?\s?(Z|[+-]\d\d:?\d\d|UTC)?")
_LINE_NO = re.compile(r"^(.*\D)?:\d+(?::\d+)?$")


class Fields(NamedTuple):
    """Fields of a head line; level and component are None where the line prints none."""

    ts_us: int
    level: str | None
    component: str | None
    message: str


def level_of(word: str | None) -> str | None:
    """The level that a word or letter stands for, or None."""
    return LEVELS.get(word.strip().lower()) if word else None


_days: dict[tuple[int, int, int], int] = {}


def _epoch_us(year: int, month: int, day: int, h: int, m: int, s: int, fraction: str | None = None, zone: str | None = None) -> int:
    """Epoch microseconds; ValueError where there is no such time."""
    key = (year, month, day)
    base = _days.get(key)
    if base is None:
        if not (1 <= month <= 12 and year >= 1 and 1 <= day <= calendar.monthrange(year, month)[1]):
            raise ValueError("no such day")
        base = calendar.timegm((year, month, day, 0, 0, 0))
        if len(_days) > 100_000:
            _days.clear()
        _days[key] = base
    if h > 23 or m > 59 or s > 60:
        raise ValueError("no such time")
    us = (base + h * 3600 + m * 60 + s) * 1_000_000
    if fraction:
        us += int(fraction[:6].ljust(6, "0"))
    if zone and zone[0] in "+-":
        digits = zone[1:].replace(":", "")
        off = (int(digits[:2]) * 60 + int(digits[2:4])) * 60_000_000
        us += -off if zone[0] == "+" else off
    return us


def iso_us(text: str) -> int:
    """Epoch microseconds of an ISO time (UTC where it names no offset); ValueError if it is none."""
    m = _ISO.fullmatch(text.strip())
    if not m:
        raise ValueError("no ISO time")
    y, mo, d, h, mi, s, f, z = m.groups()
    return _epoch_us(int(y), int(mo), int(d), int(h), int(mi), int(s), f, z)


def _any_time_us(value: object) -> int:
    """A time as an ISO string or as epoch seconds, milliseconds, microseconds or nanoseconds."""
    if isinstance(value, bool) or value is None:
        raise ValueError("no time")
    text = str(value).strip()
    if _ISO.match(text):
        return iso_us(text)
    m = re.fullmatch(r"(\d{9,19})(?:\.(\d+))?", text)
    if not m:
        raise ValueError("no time")
    return _epoch_number_us(m[1], m[2])


def _epoch_number_us(whole: str, fraction: str | None = None) -> int:
    n, f = len(whole), (fraction or "")
    if n <= 11:
        return int(whole) * 1_000_000 + int(f[:6].ljust(6, "0"))
    if n <= 14:
        return int(whole) * 1_000 + int(f[:3].ljust(3, "0"))
    return int(whole) if n <= 17 else int(whole) // 1000


def _source(name: str | None) -> str | None:
    """A source file without its line number."""
    if name:
        m = _LINE_NO.match(name)
        if m and m[1]:
            return m[1]
    return name or None


def _need(word: str) -> str:
    level = level_of(word)
    if level is None:
        raise ValueError("no level")
    return level


ISO_T = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?:Z|[+-]\d\d:?\d\d)?"
NAME = r"[^\s\[\]:]+(?:::?[^\s\[\]:]+)*"


def _iso_name(m: re.Match, year: int) -> Fields:  # TIME LEVEL module::path: message
    return Fields(iso_us(m[1]), _need(m[2]), m[3], m[4])


def _iso_bracket(m: re.Match, year: int) -> Fields:  # TIME LEVEL [name] message
    return Fields(iso_us(m[1]), _need(m[2]), m[3].strip(), m[4])


def _brackets(m: re.Match, year: int) -> Fields:  # [TIME] [level] [name] message
    return Fields(iso_us(m[1]), _need(m[2]), m[3].strip(), m[4])


def _thread(m: re.Match, year: int) -> Fields:  # DATE TIME,ms LEVEL [thread] logger - message
    return Fields(iso_us(m[1]), _need(m[2]), m[3], m[4])


def _slash(m: re.Match, year: int) -> Fields:  # Y/M/D h:m:s [level] pid#tid: message
    y, mo, d, h, mi, s, level, text = m.groups()
    return Fields(_epoch_us(int(y), int(mo), int(d), int(h), int(mi), int(s)), _need(level), None, text)


def _letter(m: re.Match, year: int) -> Fields:  # Lmmdd h:m:s.us thread file:line] message
    level, mo, d, h, mi, s, f, name, text = m.groups()
    return Fields(_epoch_us(year, int(mo), int(d), int(h), int(mi), int(s), f), _need(level), name, text)


def _epoch(m: re.Match, year: int) -> Fields:  # 1767610213980 [I] name: message
    return Fields(_epoch_number_us(m[1]), _need(m[2]), m[3], m[4])


def _access(m: re.Match, year: int) -> Fields:  # [d/Mon/Y:h:m:s +zone] name LEVEL: message
    d, mo, y, h, mi, s, z, name, level, text = m.groups()
    return Fields(_epoch_us(int(y), MONTHS[mo], int(d), int(h), int(mi), int(s), None, z), _need(level), name, text)


def _syslog(m: re.Match, year: int) -> Fields:  # <pri>Mon d h:m:s host program[pid]: message
    pri, mo, d, h, mi, s, name, text = m.groups()
    return Fields(_epoch_us(year, MONTHS[mo], int(d), int(h), int(mi), int(s)), SYSLOG[int(pri) & 7] if pri else None, name, text)


_PAIR = re.compile(r'([A-Za-z_@][\w.@-]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)(?:\s+|$)')
_json = json.JSONDecoder(strict=False)


def _unquote(value: str) -> str:
    if value[:1] != '"':
        return value
    try:
        return _json.decode(value)
    except ValueError:
        return re.sub(r"\\(.)", r"\1", value[1:-1])


def _first(row: dict, keys: tuple[str, ...]) -> object:
    for k in keys:
        if row.get(k) is not None:
            return row[k]
    return None


def _structured(row: dict) -> Fields:
    text = _first(row, TEXT_KEYS)
    if text is None:
        raise ValueError("no message")
    level, name = _first(row, LEVEL_KEYS), _first(row, NAME_KEYS)
    return Fields(_any_time_us(_first(row, TIME_KEYS)), level_of(str(level)) if level is not None else None, _source(str(name)) if name is not None else None, text if isinstance(text, str) else json.dumps(text))


def _pairs(m: re.Match, year: int) -> Fields:  # ts=... level=... logger=... msg="..."
    row: dict = {}
    for k, v in _PAIR.findall(m.string):
        row.setdefault(k, _unquote(v))
    return _structured(row)


def _object(m: re.Match, year: int) -> Fields:  # {"time": ..., "level": ..., "logger": ..., "msg": ...}
    row = _json.decode(m.string)
    if not isinstance(row, dict):
        raise ValueError("no object")
    return _structured(row)


class Layout(NamedTuple):
    name: str
    anchors: tuple[str, ...]
    pattern: re.Pattern
    fields: Callable[[re.Match, int], Fields]


def _layout(name: str, anchors: tuple[str, ...], pattern: str, fields: Callable) -> Layout:
    return Layout(name, anchors, re.compile(pattern, re.DOTALL), fields)


#: In the order in which candidates are verified. Each anchor is a literal that every head of the layout holds.
LAYOUTS: tuple[Layout, ...] = (
    _layout("object", ('"msg"', '"message"', '"text"'), r"\{", _object),
    _layout("pairs", (" msg=", " message="), r"(?:ts|time|timestamp|t)=\S", _pairs),
    _layout("slash", ("#",), r"(\d{4})/(\d\d)/(\d\d) (\d\d):(\d\d):(\d\d)(?:\.\d+)? \[(\w+)\] \d+#\d+: ?(.*)", _slash),
    _layout("letter", ("] ", "]"), r"([A-Z])(\d\d)(\d\d) (\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))? +\d+ ([^\s\]]+?):\d+\] ?(.*)", _letter),
    _layout("brackets", ("] [",), rf"\[({ISO_T})\] \[\s*(\w+)\s*\] \[([^\]]*)\] ?(.*)", _brackets),
    _layout("access", tuple(f"/{m}/" for m in MONTHS), r"\[(\d\d)/([A-Z][a-z]{2})/(\d{4}):(\d\d):(\d\d):(\d\d) ([+-]\d{4})\] (\S+) (\w+): ?(.*)", _access),
    _layout("epoch", tuple(f" [{c}] " for c in "TDINWEFC"), r"(\d{13}|\d{16}|\d{10}) \[([A-Z])\] ([^\s:]+(?::+[^\s:]+)*): ?(.*)", _epoch),
    _layout("thread", (" - ",), r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:[.,]\d{1,9})?) (\w+) +\[[^\]]*\] (\S+) - ?(.*)", _thread),
    _layout("iso_bracket", (" [",), rf"({ISO_T}) +(\w+) +\[([^\]]*)\] ?(.*)", _iso_bracket),
    _layout("iso_name", (": ", ":"), rf"({ISO_T}) +(\w+) +({NAME}): ?(.*)", _iso_name),
    _layout("syslog", tuple(f"{m} " for m in MONTHS), r"(?:<(\d{1,3})>)?([A-Z][a-z]{2}) ([ \d]\d) (\d\d):(\d\d):(\d\d) \S+ ([^\s\[\]:]+)(?:\[\d+\])?: ?(.*)", _syslog),
)


def _automaton(layouts: tuple[Layout, ...]) -> ahocorasick.Automaton:
    masks: dict[str, int] = {}
    for i, x in enumerate(layouts):
        for a in x.anchors:
            masks[a] = masks.get(a, 0) | 1 << i
    made = ahocorasick.Automaton()
    for a, mask in masks.items():
        made.add_word(a, mask)
    made.make_automaton()
    return made


class Router:
    """Finds the layout of a line: literals first, then anchored expressions."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.layouts, self.automaton = layouts, _automaton(layouts)
        self._orders: dict[int, list[Layout]] = {}

    def clean(self, line: str | None) -> str:
        """The line without colour codes and trailing carriage returns."""
        if not line:
            return ""
        if "\x1b" in line:
            line = COLOUR.sub("", line)
        return line.rstrip("\r\n")

    def fields(self, line: str, year: int) -> Fields | None:
        """Fields of a cleaned line, or None if it is no head."""
        if not line or line[0] in " \t|}":
            return None
        mask = 0
        for _, m in self.automaton.iter(line):
            mask |= m
        order = self._orders.get(mask)
        if order is None:
            order = self._orders[mask] = [x for i, x in enumerate(self.layouts) if mask >> i & 1]
        for x in order:
            m = x.pattern.match(line)
            if m:
                try:
                    return x.fields(m, year)
                except (ValueError, KeyError, OverflowError, RecursionError):
                    continue
        return None
