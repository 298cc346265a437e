"""Physical log lines to log entries.

Each line is parsed on its own (Aho-Corasick routing in an Arrow batch), so a
line never waits for its stream. Only two small facts travel between blocks of
a stream: the next head after a block and the last head before it. A stream is
cut into blocks of line numbers, and every sort sees at most one block, so one
stream may hold any share of the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import keep

BLOCK = 4096

_DIGIT = re.compile(r"[0-9]")

_HEAD_FIELDS = "stream_id string, line_no bigint, ts_us bigint, level string, component string, message_len int, seen timestamp"
_TEXT_FIELDS = "stream_id string, line_no bigint, is_head boolean, ts_us bigint, level string, component string, message_len int, body string, seen timestamp"


def template(text: str) -> str:
    """Lower-cased text with each run that holds a digit as '#', and runs of white space as one space."""
    parts = text.lower().split()
    return " ".join(["#" if _DIGIT.search(x) else x for x in parts] if _DIGIT.search(text) else parts)


def _parse(batches: Iterator[pa.RecordBatch], heads_only: bool, templated: bool) -> Iterator[pa.RecordBatch]:
    from tidemark.functions.loglayouts import Router, level_of

    router = Router()
    for batch in batches:
        lines, services, severities = (batch.column(k).to_pylist() for k in ("line", "service", "severity"))
        years = batch.column("year").to_pylist()
        keep: list[int] = []
        ts, levels, names, lengths, bodies, flags = [], [], [], [], [], []
        for i, raw in enumerate(lines):
            line = router.clean(raw)
            f = router.fields(line, years[i] or 1970)
            if f is None:
                if heads_only:
                    continue
                bodies.append(template(line) if templated else line)
                for column in (ts, levels, names, lengths):
                    column.append(None)
            else:
                ts.append(f.ts_us)
                levels.append(f.level or level_of(severities[i]))
                names.append(f.component or services[i])
                lengths.append(len(f.message.split("\n", 1)[0].strip()))
                if not heads_only:
                    bodies.append(template(f.message) if templated else f.message)
            flags.append(f is not None)
            keep.append(i)
        if not keep:
            continue
        at = pa.array(keep, pa.int64())
        columns = {"stream_id": batch.column("stream_id").take(at), "line_no": batch.column("line_no").take(at)}
        if not heads_only:
            columns["is_head"] = pa.array(flags, pa.bool_())
        columns |= {"ts_us": pa.array(ts, pa.int64()), "level": pa.array(levels, pa.string()), "component": pa.array(names, pa.string()), "message_len": pa.array(lengths, pa.int32())}
        if not heads_only:
            columns["body"] = pa.array(bodies, pa.string())
        columns["seen"] = batch.column("seen").take(at)
        yield pa.RecordBatch.from_pydict(columns)


def _input(lines: DataFrame) -> DataFrame:
    seen = F.col("received_at").cast("timestamp")
    return lines.filter("stream_id is not null and line_no is not null").select(
        F.col("stream_id").cast("string").alias("stream_id"),
        F.col("line_no").cast("bigint").alias("line_no"),
        F.col("line").cast("string").alias("line"),
        F.col("service").cast("string").alias("service"),
        F.col("severity").cast("string").alias("severity"),
        F.year(seen).alias("year"),
        seen.alias("seen"),
    )


def _block(column: str = "line_no"):
    return F.floor(F.col(column) / F.lit(BLOCK)).alias("block")


def _one_row(parsed: DataFrame) -> DataFrame:
    """Repeated rows of a line count once: the row received first, then the smallest one."""
    rest = [c for c in parsed.columns if c not in ("stream_id", "block", "line_no", "seen")]
    first = F.min(F.struct("seen", *rest)).alias("row")
    return parsed.groupBy("stream_id", "block", "line_no").agg(first).select("stream_id", "block", "line_no", *[f"row.{c}" for c in rest])


def parse_heads(lines: DataFrame) -> DataFrame:
    """One row per delivered head line: stream_id, block, line_no and the decoded fields."""
    parsed = _input(lines).mapInArrow(lambda b: _parse(b, True, False), _HEAD_FIELDS)
    return parsed.select("*", _block())


def log_entries(lines: DataFrame) -> DataFrame:
    """Log entries of physical lines (stream_id, line_no, line, service, severity, received_at).

    One row per entry: stream_id, first_line, last_line, ts_us, level,
    component, message_len. Repeated rows of a line count once (the row that
    was received first). Rows without stream_id or line_no are left out, null
    and empty lines belong to the entry before them, and lines before the first
    head of a stream belong to no entry. Other columns of the input are ignored.
    An empty table gives no rows.
    """
    block = Window.partitionBy("stream_id", "block").orderBy("line_no")
    heads = _one_row(parse_heads(lines).repartition("stream_id", "block"))
    # Each line is parsed once; all but the last head of a block know their next one in the same stage.
    heads = keep(heads.withColumn("next", F.lead("line_no").over(block)))
    firsts = heads.groupBy("stream_id", "block").agg(F.min("line_no").alias("first_head"))
    # Per block of lines: its last line and its first head; then the next head after the block. A row per block, not per line.
    ends = lines.filter("stream_id is not null and line_no is not null").groupBy(F.col("stream_id").cast("string").alias("stream_id"), _block()).agg(F.max("line_no").cast("bigint").alias("end"))
    after = Window.partitionBy("stream_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    carry = ends.join(firsts, ["stream_id", "block"], "left").select(
        "stream_id",
        "block",
        F.first("first_head", ignorenulls=True).over(after).alias("later_head"),
        F.max("end").over(Window.partitionBy("stream_id")).alias("stream_end"),
    )
    entry = lambda rows, last: rows.select("stream_id", F.col("line_no").alias("first_line"), (last - 1).alias("last_line"), "ts_us", "level", "component", "message_len")
    inner = entry(heads.filter("next is not null"), F.col("next"))
    edge = entry(heads.filter("next is null").join(carry, ["stream_id", "block"]), F.coalesce(F.col("later_head"), F.col("stream_end") + 1))
    return inner.unionByName(edge)


def entry_bodies(lines: DataFrame, templated: bool = True) -> DataFrame:
    """Entries with their whole message: stream_id, first_line, ts_us, level, component, body.

    The body is the message and the entry's further lines, joined by a space
    where `templated` (each line as `template` gives it, empty ones left out)
    and by a line feed otherwise. An entry is a record: its lines come together,
    a whole stream never does.
    """
    parsed = _input(lines).mapInArrow(lambda b: _parse(b, False, templated), _TEXT_FIELDS)
    rows = _one_row(parsed.select("*", _block()).repartition("stream_id", "block"))
    block = Window.partitionBy("stream_id", "block")
    head = F.when(F.col("is_head"), F.col("line_no"))
    rows = rows.withColumn("head", F.last(head, ignorenulls=True).over(block.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("last_head", F.max(head).over(block))
    # Pieces: an entry's lines within one block, made where the lines are. Their number in an entry is its lines / BLOCK.
    glue = " " if templated else "\n"
    line = F.struct("line_no", "body")
    piece = rows.groupBy("stream_id", "block", "head").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("body") != "", line) if templated else line)), lambda x: x["body"]), glue).alias("body"),
        F.max(F.when(F.col("is_head"), F.struct("ts_us", "level", "component", "message_len"))).alias("h"),
        F.max("last_head").alias("last_head"),
    )
    piece = keep(piece)
    whole = piece.filter("head < last_head").select("stream_id", F.col("head").alias("first_line"), "h.ts_us", "h.level", "h.component", "h.message_len", "body")
    # Only the last entry of a block may go on in the next one, and a piece without a head continues the last head of an
    # earlier block: a row per block says which.
    blocks = piece.groupBy("stream_id", "block").agg(F.max("last_head").alias("last_head"))
    earlier = Window.partitionBy("stream_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("stream_id", "block", F.last("last_head", ignorenulls=True).over(earlier).alias("carried"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "body"))), lambda p: p["body"])
    edge = (
        piece.filter("head is null or head = last_head")
        .join(carry, ["stream_id", "block"])
        .withColumn("first_line", F.coalesce("head", "carried"))
        .filter("first_line is not null")
        .groupBy("stream_id", "first_line")
        .agg(F.array_join(F.filter(parts, lambda x: x != "") if templated else parts, glue).alias("body"), F.max("h").alias("h"))
        .select("stream_id", "first_line", "h.ts_us", "h.level", "h.component", "h.message_len", "body")
    )
    return whole.unionByName(edge)
