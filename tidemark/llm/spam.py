"""Pages of repeated keywords, links or tags instead of sentences.

A text is cut into units (sentences of lines). Units are told apart by link
text, tags, separators, repeated word pairs, repeated lines and words, and missing
function words; how few function words are too few is calibrated per language
over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.overlap import words

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an of to in on at for from with by as and or but that which this these those it its they we he she you i was were is are be been had has have not no only then than when while since because if so there their our your about after before between during into over under until without yet already first same both each any some could would should can may did do does who what where how again also very",
    "de": "der die das den dem des ein eine einer einem einen und oder aber nicht mit von für auf bei nach vor aus zu zum zur im in am an als wie wird wurde war ist sind sich durch während danach bevor um es sie wir ich bitte zuerst",
    "fr": "le la les un une des du de et ou mais ne pas avec pour par sur dans en au aux ce cette ces qui que est a été était alors il elle nous vous avant d l",
    "es": "el la los las un una de del y o pero no con por para en se que es fue era antes mientras sin su al lo",
    "pt": "o os a as um uma de do da dos das no na nos nas em e ou mas não com por para que foi era antes se ao à após",
}
# Japanese particles and endings.
JAPANESE = ("を", "は", "が", "に", "の", "で", "と", "へ", "から", "まで", "した", "する", "ます", "です")

#: Share of the language's usual share of function words below which a unit is no sentence, and bounds of the result.
CALIBRATION = 0.45
FLOOR, CEILING = 0.08, 0.2
#: Times from which a line, and a word that is neither function word nor number, counts as repeated; and the share of such words that makes a unit one of keywords.
REPEATED_LINE, REPEATED_WORD, REPEATED_COVER = 3, 3, 0.6

_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_PARTICLE = re.compile("|".join(sorted(JAPANESE, key=len, reverse=True)))
_LANGUAGES: dict[str, tuple[str, ...]] = {w: tuple(k for k in _FUNCTION if w in _FUNCTION[k]) for v in _FUNCTION.values() for w in v}
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_KANA = re.compile(r"[぀-ヿ]")
# Letters beyond the Latin blocks.
_OTHER = re.compile(r"[^\W\d_\u0000-\u024f\u1e00-\u1eff\uff21-\uff5a]")
_LINE = re.compile(r"[\r\n\v\f  ]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_ENDED = re.compile(r"[.!?…。！？][\"'”’)\]]*$")
_URL = re.compile(r"(?:https?|ftp)://[^\s<>\"')\]]+|\bwww\.[^\s<>\"')\]]+", re.IGNORECASE)
_ANCHOR = re.compile(r"<a\s[^<>]*>(?:(?!<a\s).)*?</a\s*>", re.IGNORECASE | re.DOTALL)
_MARKDOWN = re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]*\)")
_TAG = re.compile(r"<[^<>]+>")
_HASH = re.compile(r"(?:^|\s)#\w+")
_TIMED = re.compile(r"^[\[(<]?(?:\d{4}[-/.]\d\d[-/.]\d\d|\d{1,2}:\d\d(?::\d\d)?(?!\])|[A-Z][a-z]{2} [ \d]\d \d\d:|\d{10,13}\b|[TDIWEF]\d{4} \d\d:)")
_FRAME = re.compile(r"^(?:at \S+\(|File \"|Caused by\b|\.\.\. \d+ more|Traceback \(|goroutine \d|[\w.$]*(?:Error|Exception|Fault|Failure)\b:?)")
_NUMBER = re.compile(r"[-+~<>=:.,%\s\d]*|-+")
_PARTS = re.compile(r"[,;|/•·»>\t]|\s[-–—*]\s")


class Shares(NamedTuple):
    """Words of a text by the kind of unit that holds them, and shares over the whole text."""

    language: str
    n_words: int
    link_words: int
    tag_words: int
    keyword_words: int
    machine_words: int
    function_share: float
    top_word_share: float
    top_pair_share: float
    duplicate_line_share: float
    separator_density: float


def _function_counts(ws: list[str], text: str) -> dict[str, int]:
    """Function words by language, of the languages that have any."""
    out: dict[str, int] = {}
    for names in [_LANGUAGES[w] for w in ws if w in _LANGUAGES]:
        for k in names:
            out[k] = out.get(k, 0) + 1
    if not text.isascii() and _KANA.search(text):
        out["ja"] = 3 * len(_PARTICLE.findall(text))
    return out


def language_of(ws: list[str], text: str) -> str:
    """The language whose function words are most frequent; Japanese by its script."""
    if not text.isascii() and len(_KANA.findall(text)) * 4 > sum(map(len, ws)):
        return "ja"
    counts = _function_counts(ws, text)
    counts.pop("ja", None)
    return max(counts, key=lambda k: (counts[k], k == "en", k)) if counts else "en"


def weight(ws: list[str]) -> int:
    """Number of words; a run in a script without spaces counts as one for every two characters."""
    return len(ws) + sum((len(_WIDE.findall(w)) - 1) // 2 for w in ws if not w.isascii() and _WIDE.search(w))


def _machine(line: str) -> bool:
    """Whether a line is one of a log, a stack trace or a table of numbers."""
    if _TIMED.match(line) or _FRAME.match(line):
        return True
    if "|" in line:
        cells = [x.strip() for x in line.strip("|").split("|")]
        return len(cells) > 1 and 2 * sum(bool(_NUMBER.fullmatch(x)) for x in cells) >= len(cells)
    return False


def usual(text: str | None) -> tuple[str, float] | None:
    """Language and share of function words of a text; None if it has fewer than 20 words."""
    ws = words(text.lower()) if text else []
    if len(ws) < 20:
        return None
    language = language_of(ws, text)
    return language, _function_counts(ws, text).get(language, 0) / weight(ws)


def unlisted(text: str) -> bool:
    """Whether most letters belong to a script whose function words aren't known (neither Latin nor Japanese)."""
    if text.isascii() or _KANA.search(text):
        return False
    other = len(_OTHER.findall(text))
    return other > 0 and 2 * other > sum(map(str.isalpha, text))


def shares(text: str | None, thresholds: dict[str, float], above: float | None = None) -> Shares | None:
    """Kinds of units of a text. Null, empty and blank texts have no words.

    Where `above` is given, the answer is None as soon as it is certain that
    links, tags and keywords don't make up more than that share of the words:
    what was seen to be none of them, less the words that links and tags may
    have cut in two, is then too much.
    """
    lower = text.lower() if text else ""
    ws = words(lower)
    n = weight(ws)
    if not n:
        return Shares("en", 0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
    told: list[str] = []

    def language() -> str:
        """The text's language, looked at where a unit doesn't tell its own."""
        if not told:
            told.append(language_of(ws, lower))
        return told[0]

    pairs = Counter(zip(ws, ws[1:], strict=False))
    stuffed = {p for p, c in pairs.items() if c >= 5 and c >= 0.08 * n}
    lines = [x for x in (line.strip() for line in _LINE.split(text)) if x]
    repeated, singles = Counter(lines), Counter(ws)
    link = tag = keyword = machine = other = 0
    if above is not None:
        cuts = 2 * (text.count("://") + lower.count("www.") + text.count("#") + text.count("<") + text.count("]("))
        enough = (1 - above) * n + cuts
    few_known = not unlisted(text)
    machines = {line: words(line.lower()) for line in repeated if _machine(line)}
    frequent: list[set[str]] = []

    def often() -> set[str]:
        """Words that repeat as keywords: outside the lines of logs, traces and tables, no function words."""
        if not frequent:
            count = dict(singles)
            for line, us in machines.items():
                for w in us:
                    count[w] = count.get(w, 0) - repeated[line]
            frequent.append({w for w, c in count.items() if c >= REPEATED_WORD and w not in _LANGUAGES and not w.isdecimal()})
        return frequent[0]

    for line in lines:
        if above is not None and other + machine >= enough:
            return None
        if line in machines:
            machine += weight(machines[line])
            continue
        # Links first: their text and address are no sentence.
        rest = line
        for pattern in (_ANCHOR, _MARKDOWN, _URL):
            for m in pattern.findall(rest) if ("://" in rest or "www." in rest.lower() or "<a" in rest.lower() or "](" in rest) else ():
                link += weight(words(m))
            rest = pattern.sub(" ", rest)
        linked = rest != line
        rest = _TAG.sub(" ", rest) if "<" in rest else rest
        hashes = _HASH.findall(rest)
        if len(hashes) > 1 or hashes and len(hashes[0].strip()) == len(rest.strip()):
            tag += sum(weight(words(h)) for h in hashes)
            rest = _HASH.sub(" ", rest)
        for unit in _SENTENCE.split(rest):
            us = words(unit.lower())
            if not us:
                continue
            ended = bool(_ENDED.search(unit.strip()))
            size = len(us) if unit.isascii() else weight(us)
            counts = _function_counts(us, unit)
            top = max(counts.values(), default=0)
            most = [k for k, c in counts.items() if c == top]
            spoken = most[0] if len(most) == 1 else language() if not most or language() in most else max(most)
            # In a script without a list nothing is told from missing function words, only from repetition.
            share, few = counts.get(spoken, 0) / size, thresholds.get(spoken, FLOOR) if few_known else -1.0
            other += size
            if ended and share >= few and (not stuffed or share >= 0.5):
                continue  # a sentence
            twos = list(zip(us, us[1:], strict=False))
            if stuffed and (share < 0.5 or not ended) and not stuffed.isdisjoint(twos):
                keyword, other = keyword + size, other - size
                continue
            if ended and share >= few:
                continue
            if linked and share < few:
                keyword, other = keyword + size, other - size
                continue
            repeats = [pairs[p] >= 3 for p in twos]
            cover = (sum(a or b for a, b in zip(repeats, repeats[1:], strict=False)) + repeats[0] + repeats[-1]) / len(us) if repeats else 0.0
            parts = sum(1 for p in _PARTS.split(unit) if p and not p.isspace())
            listed = parts >= 3 and len(us) / parts <= 5
            if share < few and (cover >= 0.5 or listed and parts >= 5) or not ended and (cover >= 0.6 or listed and (cover >= 0.4 or share < few)):
                keyword, other = keyword + size, other - size
            elif (share < few or not few_known and not ended) and (repeated[line] >= REPEATED_LINE or sum(u in often() for u in us) >= REPEATED_COVER * len(us)):
                keyword, other = keyword + size, other - size
    duplicate = sum(c for c in repeated.values() if c > 1) / len(lines) if lines else 0.0
    return Shares(language(), n, link, tag, keyword, machine, _function_counts(ws, lower).get(language(), 0) / n, max(singles.values()) / n, max(pairs.values()) / n if pairs else 0.0, duplicate, len(_PARTS.findall(text)) / n)


def _usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [u for u in map(usual, batch.column("text").to_pylist()) if u]
        yield pa.RecordBatch.from_arrays([pa.array([u[0] for u in found], pa.string()), pa.array([u[1] for u in found], pa.float64())], names=["language", "share"])


def calibrate(texts: DataFrame) -> dict[str, float]:
    """Per language, the share of function words below which a unit is no sentence: from the median over all texts."""
    rows = texts.select("text").mapInArrow(_usual, "language string, share double").groupBy("language").agg(F.percentile_approx("share", 0.5, 1000).alias("m"))
    return {r["language"]: min(CEILING, max(FLOOR, CALIBRATION * r["m"])) for r in rows.collect()}


_SCHEMA = "language string, n_words bigint, link_words bigint, tag_words bigint, keyword_words bigint, machine_words bigint, function_share double, top_word_share double, top_pair_share double, duplicate_line_share double, separator_density double"


def _shares(batches: Iterator[pa.RecordBatch], thresholds: dict[str, float]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] + [pa.int64()] * 5 + [pa.float64()] * 5
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            rows = [shares(t, thresholds) for t in part.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([part.column("key"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["key", *Shares._fields])


def page_shares(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per row of `texts`: key, the shares of its text, and spam_share.

    spam_share is the share of words in links, tags and keyword units; lines of
    logs, traces and tables of numbers are never among them. It is null for a
    text without words (null, empty, blank). Repeated rows give repeated rows;
    an empty table gives none; further columns are ignored.
    """
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    thresholds = calibrate(rows)
    out = rows.mapInArrow(lambda b: _shares(b, thresholds), f"key {kind}, {_SCHEMA}")
    spam = (F.col("link_words") + F.col("tag_words") + F.col("keyword_words")) / F.when(F.col("n_words") > 0, F.col("n_words"))
    return out.withColumn("spam_share", spam).withColumnRenamed("key", key)


def _found(batches: Iterator[pa.RecordBatch], thresholds: dict[str, float], share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            x = shares(text, thresholds, share)
            if x and x.n_words and x.link_words + x.tag_words + x.keyword_words > share * x.n_words:
                at.append(i)
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64()))], names=["key"])


def stuffed_pages(texts: DataFrame, key: str, text: str = "text", share: float = 0.5) -> DataFrame:
    """(key) of the rows whose spam_share by `page_shares` exceeds `share`, whatever their length.

    A text is read only as far as its answer needs, which is the same as that of
    the whole text. Rows with null, empty or blank texts are not found; repeated
    rows give repeated rows.
    """
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    thresholds = calibrate(rows)
    return rows.mapInArrow(lambda b: _found(b, thresholds, share), f"key {kind}").withColumnRenamed("key", key)
