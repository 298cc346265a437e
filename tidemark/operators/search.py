"""The n best matches of every query: sparse (words, entities) and dense (vectors), without joining all pairs.

The searched side is indexed. A side whose counted postings (or bytes) stay
within a limit is sent to the tasks once, and queries stream past it without a
shuffle; a larger one is cut into blocks of that size, and each chunk of queries
meets each block in one task. Either way a task returns n rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.relations import top_rows
from tidemark.session import keep

#: Postings of the searched side that one task holds (16 bytes each), and up to which it is broadcast.
MAX_POSTINGS = 8_000_000
#: Postings that are added up first, before the bound of what is left is looked at.
FIRST_POSTINGS = 4_096
#: Bytes of query vectors that are broadcast at once.
MAX_QUERY_BYTES = 64 << 20
#: Vectors that the centroids of `dense_cells` are fitted on (the smallest hashes), and their greatest number.
CELL_SAMPLE, MAX_CELLS = 20_000, 1_024
#: Vectors of a cell that one task compares at a time; a cell with more is cut into parts.
CELL_ROWS = 20_000

_FIELDS = "id string, t bigint, severity bigint, family bigint, items array<bigint>, weights array<double>"


class Index:
    """Postings of records by item, and what a score adds for equal attributes."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pc.sort_indices(rows.column("id"))).combine_chunks()
        self.ids = rows.column("id").to_pylist()
        self.place = {k: i for i, k in enumerate(self.ids)}
        number = lambda c, none: rows.column(c).fill_null(none).to_numpy()
        self.t, self.severity, self.family = number("t", np.iinfo(np.int64).max), number("severity", 0), number("family", 0)
        lists = rows.column("items").combine_chunks()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.size = sizes
        items, weights = lists.flatten().to_numpy(zero_copy_only=False), rows.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(items, kind="stable")
        self.doc, self.w, items = np.repeat(np.arange(len(self.ids)), sizes)[order], weights[order], items[order]
        new = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1]))) if len(items) else np.empty(0, dtype=np.int64)
        self.vocabulary, self.begin = items[new], np.append(new, len(items))
        self.most, self.least = (f.reduceat(self.w, new) if len(items) else self.w for f in (np.maximum, np.minimum))

    def best(self, items: np.ndarray, weights: np.ndarray, own: str, t: int | None, severity: int | None, family: int | None, n: int, places: int, plus: tuple[float, float], earlier: bool, with_self: bool, jaccard: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of records, rounded scores, numbers of shared items) of the n best, by score, then id.

        Short lists are added up first. Where the n-th best so far beats all that
        the other lists could give, only its candidates are searched in them. With
        `jaccard` the score is shared / all items, where it is that great or more.
        """
        asked = len(items)
        none = np.empty(0, dtype=np.int64)
        if not len(self.vocabulary) or not len(items):
            return none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, items), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == items
        at, weights = at[hit], weights[hit]
        if not len(at):
            return none, none, none
        begin, end = self.begin[at], self.begin[at + 1]
        order = np.argsort(end - begin, kind="stable")
        ends = np.stack((weights * self.most[at], weights * self.least[at]))
        begin, end, weights = begin[order], end[order], weights[order]
        # What each list can add at most and take at most.
        adds, takes = np.maximum(ends.max(axis=0), 0.0)[order], np.maximum(-ends.min(axis=0), 0.0)[order]
        total = np.cumsum(end - begin)
        first = max(1, int(np.searchsorted(total, FIRST_POSTINGS, side="right")))
        skip = None if with_self else self.place.get(own)

        def added(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            doc = np.concatenate([self.doc[begin[i] : end[i]] for i in range(a, b)])
            s = np.concatenate([self.w[begin[i] : end[i]] * weights[i] for i in range(a, b)])
            if len(doc) * 4 > len(self.ids):
                count = np.bincount(doc, minlength=len(self.ids))
                some = np.flatnonzero(count)
                return some, np.bincount(doc, weights=s, minlength=len(self.ids))[some], count[some]
            some, where = np.unique(doc, return_inverse=True)
            return some, np.bincount(where, weights=s), np.bincount(where)

        def kept(doc: np.ndarray) -> np.ndarray:
            ok = np.ones(len(doc), dtype=bool)
            if earlier:
                ok &= self.t[doc] < (t if t is not None else np.iinfo(np.int64).min)
            if skip is not None:
                ok &= doc != skip
            return ok

        def bonus(doc: np.ndarray) -> np.ndarray | float:
            out = 0.0
            if plus[0] and severity:
                out = out + plus[0] * (self.severity[doc] == severity)
            if plus[1] and family:
                out = out + plus[1] * (self.family[doc] == family)
            return out

        def measured(doc: np.ndarray, s: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if jaccard is None:
                return self._first(doc, s + bonus(doc), count, n, places)
            s = np.round(count / (asked + self.size[doc] - count), places)
            ok = s >= jaccard
            return self._first(doc[ok], s[ok], count[ok], n, places)

        lists = len(begin)
        if first < lists:
            doc, s, count = added(0, first)
            ok = kept(doc)
            doc, s, count = doc[ok], s[ok], count[ok]
            if jaccard is not None:
                # What shares only the other lists' items shares no more than their number.
                s, adds, takes, plus = count / (asked + self.size[doc] - count), np.array([0.0] * first + [(lists - first) / asked]), np.zeros(first), (0.0, 0.0)
            rest = adds[first:].sum() + takes[first:].sum() + (plus[0] if severity else 0.0) + (plus[1] if family else 0.0)
            if len(doc) >= n and np.partition(s, len(s) - n)[len(s) - n] > rest + 10.0**-places:
                for i in range(first, lists):
                    held = self.doc[begin[i] : end[i]]
                    p = np.minimum(np.searchsorted(held, doc), len(held) - 1)
                    found = held[p] == doc
                    s = s + np.where(found, self.w[begin[i] : end[i]][p] * weights[i], 0.0)
                    count = count + found
                return measured(doc, s, count)
        doc, s, count = added(0, lists)
        ok = kept(doc)
        doc, s, count = doc[ok], s[ok], count[ok]
        return measured(doc, s, count) if len(doc) else (none, none, none)

    @staticmethod
    def _first(doc: np.ndarray, s: np.ndarray, count: np.ndarray, n: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.round(s, places)
        if len(doc) > n:
            some = np.flatnonzero(s >= np.partition(s, len(s) - n)[len(s) - n])
            doc, s, count = doc[some], s[some], count[some]
        order = np.lexsort((doc, -s))[:n]
        return doc[order], s[order], count[order]


class _Sent:
    """A table that travels as it is and is indexed once in each process."""

    def __init__(self, rows: pa.Table):
        self.rows = rows

    @property
    def index(self) -> Index:
        if "_index" not in self.__dict__:
            self._index = Index(self.rows)
        return self._index

    def __getstate__(self) -> dict:
        return {"rows": self.rows}


_NAMES = ["left_id", "right_id", "score", "n_shared"]
_OUT = "left_id string, right_id string, score double, n_shared bigint"


def _table(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=_NAMES)


def _answers(batch: pa.RecordBatch, index: Index, args: tuple) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[], [], [], []]
    cols = [batch.column(c).to_pylist() for c in ("id", "t", "severity", "family")]
    items, weights = (batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c) for c in ("items", "weights"))
    for i, (own, t, sev, fam) in enumerate(zip(*cols, strict=True)):
        if not items[i].is_valid:
            continue
        x, w = items[i].values.to_numpy(), weights[i].values.to_numpy(zero_copy_only=False)
        doc, s, count = index.best(x, w, own, t, sev, fam, *args)
        out[0].extend([own] * len(doc))
        out[1].extend(index.ids[d] for d in doc)
        out[2].extend(s.tolist())
        out[3].extend(count.tolist())
        if len(out[0]) > 20_000:
            yield _table(out)
            out = [[], [], [], []]
    if out[0]:
        yield _table(out)


def _streamed(batches: Iterator[pa.RecordBatch], sent: _Sent, args: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _answers(batch, sent.index, args)


def _grouped(batches: Iterator[pa.RecordBatch], args: tuple) -> Iterator[pa.RecordBatch]:
    """Blocks of the searched side, each followed by its chunk of queries."""
    key, held, index = None, [], None
    for batch in batches:
        cell = np.stack([batch.column(c).to_numpy() for c in ("block", "chunk", "side")])
        starts = np.flatnonzero(np.concatenate(([True], (cell[:, 1:] != cell[:, :-1]).any(axis=0))))
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            here, side = (int(cell[0, a]), int(cell[1, a])), int(cell[2, a])
            if here != key:
                key, held, index = here, [], None
            part = batch.slice(a, b - a)
            if side == 0:
                held.append(part)
            elif held or index:
                if index is None:
                    index, held = Index(pa.Table.from_batches(held)), []
                yield from _answers(part, index, args)


def sparse_top(left: DataFrame, right: DataFrame, n: int, places: int = 6, severity: float = 0.0, family: float = 0.0, earlier: bool = False, with_self: bool = True, jaccard: float | None = None) -> DataFrame:
    """(left_id, right_id, score, n_shared, rank_no): the n right records with the greatest score for each left record.

    Both sides are (id string, severity string, family string, t bigint, items
    array<struct<item string, w double>>); missing columns count as null, an
    item may occur once in a record. The score is the
    sum of the products of the weights of shared items; `severity` and `family`
    are added where the known values are equal; with `earlier` only right
    records with a smaller t count, and a null time on either side matches
    nothing. Without `with_self` a record is no match of its own id. Records
    that share nothing have no row. Scores are rounded to `places`, ties go to
    the smaller id. With `jaccard` the score is the share of common items among
    all items of the two instead, `jaccard` or more. Null ids and empty sides give
    no rows. Exact: an item that a
    fifth of both sides hold is a long list, which is searched only where the
    shorter lists leave a doubt.
    """

    def plain(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        known = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
        code = lambda c: F.when(F.coalesce(known(c, "string"), F.lit("")) != "", F.xxhash64(known(c, "string")))
        return df.filter("id is not null").select(F.col("id").cast("string").alias("id"), known("t", "bigint").alias("t"), code("severity").alias("severity"), code("family").alias("family"), F.transform("items", lambda x: F.xxhash64(x["item"])).alias("items"), F.transform("items", lambda x: x["w"].cast("double")).alias("weights"))

    a, b = plain(left), keep(plain(right).filter("size(items) > 0"))
    spark = left.sparkSession
    args = (n, places, (severity, family), earlier, with_self, jaccard)
    n_post = b.agg(F.sum(F.size("items"))).first()[0] or 0
    if n_post <= MAX_POSTINGS:
        sent = spark.sparkContext.broadcast(_Sent(b.toArrow()))
        best = a.mapInArrow(lambda x: _streamed(x, sent.value, args), _OUT)
    else:
        blocks = -(-n_post // MAX_POSTINGS)
        chunks = max(1, -(-(a.agg(F.sum(F.size("items"))).first()[0] or 0) // (4 * MAX_POSTINGS)))
        spread = lambda df, side, own, other, own_n, other_n: df.withColumn(own, F.pmod(F.xxhash64("id", F.lit(3)), F.lit(own_n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(other_n - 1).cast("bigint")))).withColumn("side", F.lit(side))
        both = spread(b, 0, "block", "chunk", blocks, chunks).unionByName(spread(a, 1, "chunk", "block", chunks, blocks))
        both = both.repartition(int(blocks * chunks), "block", "chunk").sortWithinPartitions("block", "chunk", "side")
        best = both.mapInArrow(lambda x: _grouped(x, args), _OUT)
    return top_rows(best, ["left_id"], [F.col("score").desc(), F.col("right_id").asc()], n)


def entity_top(left: DataFrame, right: DataFrame, n: int, places: int = 6, severity: float = 0.0, family: float = 0.0, earlier: bool = False) -> DataFrame:
    """`sparse_top` with the right side's weights alone: the n right records that share entities of most weight."""
    ones = left.withColumn("items", F.transform("items", lambda x: F.struct(x["item"].alias("item"), F.lit(1.0).alias("w"))))
    return sparse_top(ones, right, n, places, severity, family, earlier)


def jaccard_top(left: DataFrame, right: DataFrame, left_words: Column, right_words: Column, n: int, least: float, within: str | None = None, earlier: bool = False, places: int = 6) -> DataFrame:
    """(left_id, right_id, score, n_shared, rank_no): the n right records with the greatest Jaccard similarity of words, `least` or more.

    Both sides have id, t where `earlier`, and where `within` names a column,
    only records with equal (known) values of it match. Repeated words count once.
    """

    def items(df: DataFrame, words: Column) -> DataFrame:
        part = F.concat(F.col(within), F.lit("|")) if within else F.lit("")
        rows = df.filter(F.col(within).isNotNull()) if within else df
        item = F.transform(F.array_distinct(F.coalesce(words, F.array().cast("array<string>"))), lambda x: F.struct(F.concat(part, x).alias("item"), F.lit(1.0).alias("w")))
        return rows.select("id", *(["t"] if earlier else []), item.alias("items"))

    return sparse_top(items(left, left_words), items(right, right_words), n, places, earlier=earlier, with_self=True, jaccard=least)


def word_counts(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, word, tf, len): how often each word occurs in a document, and the document's number of words; texts are shuffled once."""
    w = docs.select(key, words.alias("_ws")).withColumn("len", F.size("_ws"))
    return w.select(key, "len", F.explode("_ws").alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len"))


def _vectors(rows: DataFrame, key: str, weight: Column, extra: Sequence[str] = ()) -> DataFrame:
    item = F.struct(F.col("word").alias("item"), weight.alias("w"))
    return rows.groupBy(F.col(key).alias("id")).agg(*[F.max(c).alias(c) for c in extra], F.collect_list(item).alias("items"))


def bm25_top(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, query_words: Column, doc_words: Column, n: int, places: int = 6, query_time: str | None = None, doc_time: str | None = None, with_self: bool = False, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(left_id, right_id, score, n_shared, rank_no): the n best documents of each query by BM25.

    idf ln((N - df + 0.5) / (df + 0.5) + 1) over all documents; a word that a
    query repeats counts each time; documents without a shared word have no row.
    With times only documents before the query's time count (before the cut).
    """
    p = word_counts(docs, doc_key, doc_words)
    state = F.broadcast(docs.select(F.size(doc_words).alias("_l")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("_l").alias("avg_len")))
    df = p.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    q = word_counts(queries, query_key, query_words).join(df, "word").crossJoin(state)
    left = _vectors(q, query_key, F.col("tf") * idf)
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    right = _vectors(p.crossJoin(state), doc_key, impact)
    if query_time:
        left = left.join(queries.select(F.col(query_key).alias("id"), F.col(query_time).alias("t")), "id")
        right = right.join(docs.select(F.col(doc_key).alias("id"), F.col(doc_time).alias("t")), "id")
    return sparse_top(left, right, n, places, earlier=bool(query_time), with_self=with_self)


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows cut where the key changes: a key's rows come in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        if held and held[-1].column(key)[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        new = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False))
        if len(new):
            last = int(new[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _own_scores(batches: Iterator[pa.RecordBatch], key: str, out: Sequence[str], n_texts: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """Scores of each query's candidates, all queries of a table at once."""
    for rows in _whole(batches, key):
        keys = rows.column(key).combine_chunks()
        new = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        group = np.concatenate(([0], np.cumsum(new)))

        def entries(name: str) -> tuple[np.ndarray, np.ndarray]:
            lists = rows.column(name).combine_chunks()  # noqa: B023
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(zero_copy_only=False)

        owner, words = entries("words")
        asked = [entries(f"asked_{i}") for i in range(n_texts)]
        vocabulary, code = np.unique(np.concatenate([words, *[w for _, w in asked]]), return_inverse=True)
        v, parts = len(vocabulary), np.split(code, np.cumsum([len(words), *[len(w) for _, w in asked]])[:-1])
        pair, tf = np.unique(owner * v + parts[0], return_counts=True)
        row = pair // v
        g = group[row]
        at = g * v + pair % v
        _, where, df = np.unique(at, return_inverse=True, return_counts=True)
        df = df[where]
        length = np.bincount(owner, minlength=rows.num_rows)
        n_docs = np.bincount(group)
        idf = np.log((n_docs[g] - df + 0.5) / (df + 0.5) + 1)
        weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / (np.bincount(group, weights=length) / n_docs)[g]))
        some, scores = np.zeros(rows.num_rows, dtype=bool), []
        for (whose, _), q in zip(asked, parts[1:], strict=True):
            q, qtf = np.unique(group[whose] * v + q, return_counts=True)
            p = np.minimum(np.searchsorted(q, at), max(len(q) - 1, 0))
            hit = q[p] == at if len(q) else np.zeros(len(at), dtype=bool)
            found = np.bincount(row[hit], minlength=rows.num_rows) > 0
            scores.append(pa.array(np.bincount(row[hit], weights=qtf[p[hit]] * weight[hit], minlength=rows.num_rows), pa.float64(), mask=~found))
            some |= found
        table = pa.table([*[rows.column(c) for c in out], *scores], names=[*out, *[f"score_{i}" for i in range(n_texts)]])
        yield from table.filter(pa.array(some)).combine_chunks().to_batches()


def own_candidates(pairs: DataFrame, queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, query_words: Sequence[Column], doc_words: Column, carried: Sequence[str] = (), k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_key, doc_key, carried, score_0, score_1, ...): BM25 of the documents that each query is paired with, for each of `query_words`.

    Numbers of documents, lengths and document frequencies are those of the
    query's own documents that have words; a word that a query repeats counts
    each time. A score is null where no word is shared, and a pair without any
    score has no row. Keys are strings and unique in `queries`, `docs` and (as a
    pair) in `pairs`; `carried` names columns of `queries`.

    Documents are read into lists of hashed words once, and the pairs bring
    these lists to their query, whose own words come with its first pair only. No
    pair is taken apart into rows of words. A query's documents meet in one task.
    """
    hashed = lambda ws: F.transform(ws, lambda x: F.xxhash64(x))
    bags = docs.select(doc_key, hashed(doc_words).alias("words")).filter(F.size("words") > 0)
    # Both sides grow with the input: merged, so that none of them passes through the driver.
    rows = pairs.select(query_key, doc_key).join(bags.hint("merge"), doc_key).join(queries.hint("merge"), query_key)
    first = F.row_number().over(Window.partitionBy(query_key).orderBy(doc_key)) == 1
    out = [query_key, doc_key, *carried]
    rows = rows.withColumn("_first", first).select(*out, "words", *[F.when(F.col("_first"), hashed(w)).alias(f"asked_{i}") for i, w in enumerate(query_words)])
    kinds = dict(queries.dtypes)
    schema = ", ".join([f"{query_key} string", f"{doc_key} string", *[f"{c} {kinds[c]}" for c in carried], *[f"score_{i} double" for i in range(len(query_words))]])
    n = len(query_words)
    return rows.mapInArrow(lambda x: _own_scores(x, query_key, out, n, k1, b), schema)


def tfidf_top(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, query_words: Column, doc_words: Column, n: int, places: int = 6, least_df: int = 1, with_self: bool = False) -> DataFrame:
    """(left_id, right_id, score, n_shared, rank_no): the n best documents of each query by the cosine of (1 + ln tf) (ln((1 + N) / (1 + df)) + 1) weights.

    idf over the documents, words with fewer than `least_df` documents left out.
    """
    p = word_counts(docs, doc_key, doc_words)
    total = F.broadcast(docs.select(F.count(F.lit(1)).alias("n_docs")))
    idf = p.groupBy("word").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least_df).crossJoin(total).select("word", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))

    def unit(rows: DataFrame, key: str) -> DataFrame:
        v = _vectors(rows.join(idf, "word"), key, (1 + F.log("tf")) * F.col("idf"))
        norm = F.sqrt(F.aggregate("items", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
        return v.withColumn("_n", norm).select("id", F.transform("items", lambda x: F.struct(x["item"].alias("item"), (x["w"] / F.col("_n")).alias("w"))).alias("items"))

    return sparse_top(unit(word_counts(queries, query_key, query_words), query_key), unit(p, doc_key), n, places, with_self=with_self)


def _units(keys: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by length, each of length 1 (or zero): {dimensions: (keys, matrix)}."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat, begin = np.nan_to_num(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), np.concatenate(([0], np.cumsum(size)))
    names = keys.to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        m = flat[(begin[at][:, None] + np.arange(d))] if d else np.zeros((len(at), 0))
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        out[int(d)] = names[at], np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    return out


class _Best:
    """The n best documents of each query so far: by score, then by the smaller id."""

    def __init__(self, keys: np.ndarray, n: int):
        self.keys, self.n = keys, n
        self.q, self.d, self.s = (np.empty(0, dtype=k) for k in (np.int64, np.int64, np.float64))
        self.least = np.full(len(keys), -np.inf)

    def add(self, first: int, docs: np.ndarray, scores: np.ndarray) -> None:
        """Scores of consecutive queries against documents."""
        rows = np.arange(first, first + len(scores))
        scores = np.where(docs[None, :] == self.keys[rows][:, None], -np.inf, scores)
        cut = np.maximum(self.least[rows], np.partition(scores, -min(self.n, scores.shape[1]), axis=1)[:, -min(self.n, scores.shape[1])])
        q, d = np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))
        q, s, d = np.concatenate((self.q, q + first)), np.concatenate((self.s, scores[q, d])), np.concatenate((self.d, docs[d]))
        order = np.lexsort((d, -s, q))
        q, s, d = q[order], s[order], d[order]
        begin = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.empty(0, dtype=bool)
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(begin, np.arange(len(q)), 0)) if len(q) else q
        keep = place < self.n
        self.q, self.s, self.d = q[keep], s[keep], d[keep]
        full = place[keep] == self.n - 1
        self.least[self.q[full]] = self.s[full]

    def table(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.keys[self.q].astype(np.int64)), pa.array(self.d), pa.array(self.s)], names=["query_id", "doc_id", "score"])


def _compare(best: dict[int, _Best], asked: dict, docs: dict, places: int) -> None:
    for width, (keys, q) in asked.items():
        for other, (names, m) in docs.items():
            for a in range(0, len(q), 1024):
                for b in range(0, len(m), 4096):
                    part = q[a : a + 1024]
                    s = np.round(part @ m[b : b + 4096].T, places) if other == width else np.zeros((len(part), len(m[b : b + 4096])))
                    best[width].add(a, names[b : b + 4096], s)


def _against(batches: Iterator[pa.RecordBatch], queries: pa.Table, n: int, places: int) -> Iterator[pa.RecordBatch]:
    queries = queries.combine_chunks()
    if not queries.num_rows:
        return
    asked = _units(queries.column("k").chunk(0), queries.column("v").chunk(0))
    best = {w: _Best(keys, n) for w, (keys, _) in asked.items()}
    for batch in batches:
        if batch.num_rows:
            _compare(best, asked, _units(batch.column("k"), batch.column("v")), places)
    yield from (b.table() for b in best.values() if len(b.q))


def _named(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"))


_DENSE = "query_id bigint, doc_id bigint, score double"


def dense_top(queries: DataFrame, docs: DataFrame, key: str, vector: str, n: int, places: int = 9) -> DataFrame:
    """(query_id, doc_id, score, rank_no): the n documents with the greatest cosine for each query, itself left out.

    Exact. Queries are sent to the tasks in blocks of MAX_QUERY_BYTES (counted),
    documents stay where they are and are multiplied with them batch by batch; a
    task returns n rows a query. Null vectors are left out; zero vectors, and
    pairs of vectors of different lengths, score 0; a null element counts as 0.
    Ties go to the smaller id. `dense_cells` is the form for large query sets.
    """
    q, d = _named(queries, key, vector), _named(docs, key, vector)
    size = q.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = max(1, -(-(size * 8) // MAX_QUERY_BYTES))
    send, parts = q.sparkSession.sparkContext.broadcast, None
    for i in range(blocks):
        sent = send(q.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == i).toArrow())
        part = d.mapInArrow(lambda b, sent=sent: _against(b, sent.value, n, places), _DENSE)
        parts = part if parts is None else parts.unionByName(part)
    return top_rows(parts, ["query_id"], [F.col("score").desc(), F.col("doc_id").asc()], n)


def _centroids(m: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spread rows; no random numbers."""
    c = m[np.linspace(0, len(m) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(m @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, m)
        length = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(length > 0, total / np.where(length > 0, length, 1), c)
    return c


def _probes(m: np.ndarray, centroids: np.ndarray, n: int, recall: float, asked: int = 256) -> int:
    """The fewest cells a query must ask so that this share of its n nearest neighbours lies in them; over evenly spread rows of the sample against the whole sample."""
    at = np.unique(np.linspace(0, len(m) - 1, asked).astype(int))
    s = m[at] @ m.T
    s[np.arange(len(at)), at] = -np.inf
    n = min(n, len(m) - 1)
    if n < 1:
        return 1
    near = np.argpartition(-s, n - 1, axis=1)[:, :n]
    cell = np.argmax(m @ centroids.T, axis=1)
    order = np.argsort(np.argsort(-(m[at] @ centroids.T), axis=1), axis=1)
    depth = np.sort(order[np.arange(len(at))[:, None], cell[near]].ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, probes: int, side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, m in ((k, m) for w, (k, m) in _units(batch.column("k"), batch.column("v")).items() if w == centroids.shape[1]):
            s = m @ centroids.T
            near = np.argpartition(-s, min(probes, s.shape[1]) - 1, axis=1)[:, :probes]
            rows = np.repeat(np.arange(len(keys)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(np.full(len(rows), side, dtype=np.int32)), pa.array(keys[rows].astype(np.int64)), pa.array(list(m[rows]), pa.list_(pa.float64()))], names=["cell", "side", "k", "v"])


def _in_cells(batches: Iterator[pa.RecordBatch], n: int, places: int) -> Iterator[pa.RecordBatch]:
    """Cells in order, documents before queries: each query against the documents of its cell's part."""
    key, held, docs = None, [], None
    for batch in batches:
        cell = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "side")])
        starts = np.flatnonzero(np.concatenate(([True], (cell[:, 1:] != cell[:, :-1]).any(axis=0))))
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            here, rows = (int(cell[0, a]), int(cell[1, a])), batch.slice(a, b - a)
            if here != key:
                key, held, docs = here, [], None
            if cell[2, a] == 0:
                held.append(rows)
            elif held or docs:
                if docs is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    docs, held = _units(t.column("k").chunk(0), t.column("v").chunk(0)), []
                asked = _units(rows.column("k"), rows.column("v"))
                best = {w: _Best(keys, n) for w, (keys, _) in asked.items()}
                _compare(best, asked, docs, places)
                yield from (x.table() for x in best.values() if len(x.q))


def dense_cells(queries: DataFrame, docs: DataFrame, key: str, vector: str, n: int, cells: int | None = None, recall: float = 0.95, places: int = 9) -> DataFrame:
    """(query_id, doc_id, score, rank_no): the n nearest documents among those of the query's nearest cells.

    Approximate. Centroids (about the root of the number of documents, at most
    MAX_CELLS) are fitted on the CELL_SAMPLE documents with the smallest hashes;
    every document is put into its nearest cell, and a query asks as many cells as
    the sample needs to find `recall` of its neighbours (`_probes`).
    A cell of more than CELL_ROWS documents is cut into parts, which all its
    queries visit. Only vectors of the sample's most frequent length take part.
    Recall against `dense_top` is measured in the tests.
    """
    q, d = _named(queries, key, vector), _named(docs, key, vector)
    total = d.count()
    if not total:
        return dense_top(queries, docs, key, vector, n, places)
    few = d.withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(CELL_SAMPLE).select("k", "v").toArrow().combine_chunks()
    units = _units(few.column("k").chunk(0), few.column("v").chunk(0))
    m = max(units.values(), key=lambda x: len(x[0]))[1]
    count = min(cells or max(1, int(total**0.5)), MAX_CELLS, len(m))
    fitted = _centroids(m, count)
    probes = _probes(m, fitted, n, recall)
    c = q.sparkSession.sparkContext.broadcast(fitted)
    schema = "cell int, side int, k bigint, v array<double>"
    put = d.mapInArrow(lambda b: _assigned(b, c.value, 1, 0), schema)
    ask = q.mapInArrow(lambda b: _assigned(b, c.value, probes, 1), schema)
    parts = F.broadcast(put.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL_ROWS)).cast("int").alias("parts")))
    put = put.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("k", F.lit(5)), F.col("parts")).cast("int"))
    ask = ask.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = put.unionByName(ask).select("cell", "part", "side", "k", "v").repartition("cell", "part").sortWithinPartitions("cell", "part", "side")
    best = both.mapInArrow(lambda b: _in_cells(b, n, places), _DENSE).distinct()
    return top_rows(best, ["query_id"], [F.col("score").desc(), F.col("doc_id").asc()], n)
