"""Documents that hold passages of evaluation items.

Winnowing: of every window of consecutive k-gram hashes the smallest is kept,
so two texts that share a run of k + window - 1 words share a kept hash.
Evaluation items and documents are joined on kept hashes, and each hit is
extended over the words themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.overlap import Vector, WordHashes, gathered, ngrams, packed, words
from tidemark.session import cut

#: Rows up to which a counted list is broadcast; beyond it the join shuffles.
MAX_BROADCAST = 500_000
#: Characters of passages up to which they are sent to the tasks; beyond it documents and passages are joined.
MAX_PASSAGE_CHARS = 16_000_000
#: Bits of the filter of the items' hashes: a fixed size, 4 MB. What it can't exclude is only work.
PRINT_BITS = 1 << 25
_CHUNK = 1 << 17

_TAG = re.compile(r"<!--(?:(?!<!--).)*?-->|</?[a-z][^<>]*>|<![a-z][^<>]*>", re.DOTALL)
_FORMAT: re.Pattern | None = None


def _format_characters() -> re.Pattern:
    """Invisible format characters (category Cf)."""
    global _FORMAT
    if _FORMAT is None:
        _FORMAT = re.compile("[" + "".join(re.escape(chr(i)) for i in range(0x110000) if unicodedata.category(chr(i)) == "Cf") + "]")
    return _FORMAT


def plain_words(text: str | None) -> list[str]:
    """Words of a text: without format characters, NFKC, lower-cased, markup tags as spaces, runs of letters and digits."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _format_characters().sub("", text))
    text = text.lower()
    if "<" in text:
        text = _TAG.sub(" ", text)
    return words(text)


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Distinct minima of all windows of consecutive hashes; all of them where there are fewer than a window."""
    if len(h) <= window:
        return np.unique(h[h == h.min()]) if len(h) else h
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1))


def _print_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which places of the fixed-size filter the items' hashes fall on."""
    cells = np.zeros(PRINT_BITS // 8, dtype=np.uint8)
    for batch in batches:
        at = _places(batch.column("print").to_numpy())
        np.bitwise_or.at(cells, at >> 3, (1 << (at & 7)).astype(np.uint8))
    chunks, cells = packed(cells, _CHUNK)
    if chunks:
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunks, pa.int32()), "cells": pa.array(cells, pa.binary())})


def _places(prints: np.ndarray) -> np.ndarray:
    return (prints.view(np.uint64) >> np.uint64(13)).astype(np.int64) & (PRINT_BITS - 1)


def _prints(batches: Iterator[pa.RecordBatch], k: int, window: int, held: Vector | None) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            at, ends, flat = [], [0], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ws = plain_words(text)
                if len(ws) >= k + window - 1:
                    at.append(i)
                    flat.extend(hashes.list(ws))
                    ends.append(len(flat))
            if not at:
                continue
            # Hashes of all texts in a row; those that reach into the next text belong to none.
            grams = ngrams(np.array(flat, dtype=np.uint64), k)
            ends = np.array(ends)
            texts = range(len(at))
            if held is not None:
                known = _held(grams.view(np.int64), held)
                before = np.concatenate(([0], np.cumsum(known)))
                texts = np.flatnonzero(before[ends[1:] - k + 1] > before[ends[:-1]])
            ids, kept = [], []
            for i in texts:
                found = winnow(grams[ends[i] : ends[i + 1] - k + 1], window).view(np.int64)
                found = found if held is None else found[_held(found, held)]
                ids.extend([at[i]] * len(found))
                kept.append(found)
            if ids:
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(ids)), pa.array(np.concatenate(kept))], names=["id", "print"])


def _held(prints: np.ndarray, held: Vector) -> np.ndarray:
    at = _places(prints)
    return (held.cells[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def fingerprints(texts: DataFrame, k: int, window: int, held: Broadcast | None = None) -> DataFrame:
    """(id, print) of (id bigint, text): the kept hashes of every text, each once; of those only the ones in `held`, where it is given. Shorter texts have none."""
    return texts.select("id", "text").mapInArrow(lambda b: _prints(b, k, window, held.value if held else None), "id bigint, print bigint")


class _Passage:
    """An item's words and where each occurs."""

    def __init__(self, text: str):
        ws = plain_words(text)
        self.n, self.places = len(ws), {}
        for j, w in enumerate(ws):
            self.places.setdefault(w, []).append(j)

    def longest(self, ws: list[str]) -> int:
        """Length of the longest run of consecutive words that the two share."""
        best, ending = 0, {}
        for w in ws:
            here = {j: ending.get(j - 1, 0) + 1 for j in self.places.get(w, ())}
            if here:
                best = max(best, max(here.values()))
            ending = here
        return best


_RUNS = "doc_id bigint, item_id bigint, longest int, item_words int"


def _table(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "longest", "item_words"])


def _extend_known(batches: Iterator[pa.RecordBatch], passages: dict[int, list[str]], least: int) -> Iterator[pa.RecordBatch]:
    """Each document once, with the list of items it may hold."""
    known: dict[int, list[_Passage]] = {}
    for batch in batches:
        out = []
        for doc, text, items in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "items")], strict=True):
            ws = plain_words(text)
            for item in items:
                if item not in known:
                    known[item] = [_Passage(p) for p in passages[item]]
                for p in known[item]:
                    n = p.longest(ws)
                    if n >= least:
                        out.append((doc, item, n, p.n))
        yield _table(out)


def _extend(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Documents beside the passages they may hold, in the order of documents."""
    last, ws = None, []
    for batch in batches:
        out = []
        for doc, text, item, passage in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "passage")], strict=True):
            if (doc, text) != last:
                last, ws = (doc, text), plain_words(text)
            p = _Passage(passage)
            n = p.longest(ws)
            if n >= least:
                out.append((doc, item, n, p.n))
        yield _table(out)


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = 12, k: int = 10) -> DataFrame:
    """(doc_id, item_id, longest, item_words): documents that hold `least` or more consecutive words of an item.

    `documents` is (doc_id bigint, text), `items` is (item_id bigint, text).
    `longest` is the longest common run in words. The window of the winnowing is
    least - k + 1, so every run of `least` words shares a kept hash; the longer
    the hashes, the fewer hits on common phrases. Hits are extended on the
    words, so there are no false ones. Null and shorter texts have no row, a
    repeated doc id counts once (its longest run), an item id may have several
    passages, rows with null ids are left out, an empty side gives no rows.

    A filter of fixed size (PRINT_BITS) keeps hashes that no item has in their
    task. What is left meets the items' hashes by a join, which broadcasts them
    only up to a counted number; the same holds for hits, and for passages,
    whose characters are counted. Only passages that have a hash are ever sent.
    """
    window = least - k + 1
    spark = documents.sparkSession
    docs = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("passage")).distinct()
    wanted = cut(fingerprints(asked.select(F.col("item_id").alias("id"), F.col("passage").alias("text")), k, window).select(F.col("id").alias("item_id"), "print").distinct())
    few = wanted.count() <= MAX_BROADCAST
    held = spark.sparkContext.broadcast(Vector(gathered(wanted.select("print").mapInArrow(_print_bits, "chunk int, cells binary"), PRINT_BITS // 8, _CHUNK, "uint8", False)))
    found = fingerprints(docs.select(F.col("doc_id").alias("id"), "text"), k, window, held).select(F.col("id").alias("doc_id"), "print")
    hits = cut(found.join(F.broadcast(wanted) if few else wanted, "print").select("doc_id", "item_id").distinct())
    asked = asked.join(hits.select("item_id").distinct(), "item_id", "left_semi")
    size = asked.agg(F.sum(F.length("passage") + 16)).first()[0] or 0
    few_hits = hits.count() <= MAX_BROADCAST
    if size <= MAX_PASSAGE_CHARS:
        passages: dict[int, list[str]] = {}
        for r in asked.collect():
            passages.setdefault(r["item_id"], []).append(r["passage"])
        sent = spark.sparkContext.broadcast(passages)
        listed = hits.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
        runs = docs.join(F.broadcast(listed) if few_hits else listed, "doc_id").select("doc_id", "text", "items").mapInArrow(lambda b: _extend_known(b, sent.value, least), _RUNS)
    else:
        rows = docs.join(F.broadcast(hits) if few_hits else hits, "doc_id").join(asked, "item_id").sortWithinPartitions("doc_id", "text")
        runs = rows.select("doc_id", "text", "item_id", "passage").mapInArrow(lambda b: _extend(b, least), _RUNS)
    return runs.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("item_words").alias("item_words"))
