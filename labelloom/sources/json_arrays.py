"""Files that hold one JSON array, read in byte ranges by many tasks.

Where a range begins, nothing tells whether it is inside a string or how deep the brackets are.  So a first pass scans every range
for each state it may begin in and notes the state it ends in; the notes of a file, one for each range, are chained in order, and
from then on every range knows its state, the depth and the number of the first record that begins in it.  The second pass cuts out
the records that begin in a range, reading on past its end for the last one.  A file is read twice, by as many tasks as it
has ranges, and no task holds more than a range and a record.

Files are opened in the tasks with ``pyarrow.fs``, so a path must be one it knows (shared folders, HDFS, object stores).
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.staging import stage

SPLIT = 64 << 20
#: States a byte can be read in: outside strings, in a string, in a string after a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
#: The rest of a string, its end included.
REST = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)
MARK = re.compile(rb'["\[\]{}]')


def skip_string(data: bytes, at: int, state: int) -> tuple[int, int]:
    """Where a string that was open at ``at`` ends, and the state at the end of the data if it does not."""
    if state == ESCAPED:
        if at >= len(data):
            return at, ESCAPED
        at += 1
    end = REST.match(data, at)
    if end:
        return end.end(), OUTSIDE
    tail = len(data) - len(data.rstrip(b"\\"))
    # Backslashes before ``at`` belong to the skipped character.
    return len(data), ESCAPED if min(tail, len(data) - at) % 2 else INSIDE


def scan(data: bytes, state: int) -> tuple[int, int, dict[int, int]]:
    """State and depth (relative) at the end, and how many braces open at each relative depth."""
    at, depth, opened = 0, 0, Counter()
    if state != OUTSIDE:
        at, state = skip_string(data, at, state)
        if state != OUTSIDE:
            return state, 0, {}
    while mark := MARK.search(data, at):
        at, what = mark.end(), mark[0]
        if what == b'"':
            at, state = skip_string(data, at, INSIDE)
            if state != OUTSIDE:
                return state, depth, dict(opened)
        elif what in b"[{":
            if what == b"{":
                opened[depth] += 1
            depth += 1
        else:
            depth -= 1
    return OUTSIDE, depth, dict(opened)


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(name)


def cut(read, start: int, size: int, state: int, depth: int, step: int = 1 << 20) -> Iterator[bytes]:
    """Records that begin in ``size`` bytes from ``start``; ``read(at, n)`` gives bytes of the file."""
    data, base, end = read(start, size), 0, size
    at, record = 0, None
    if state != OUTSIDE:
        at, state = skip_string(data, at, state)
    quote = None  # where an unfinished string begins
    while True:
        mark = MARK.search(data, at) if state == OUTSIDE else None
        if mark is None:
            if record is None and base + len(data) >= end:
                return
            # On into the next bytes: what is before the open record is not needed any more.
            more = read(start + base + len(data), step)
            if not more:
                if record is not None:
                    raise ValueError("a record does not end")
                return
            keep = record if record is not None else len(data)
            if state != OUTSIDE:
                left, more_at = data[keep:], len(data) - keep
                data, base = left + more, base + keep
                at, state = skip_string(data, more_at, state)
            else:
                data, base, at = data[keep:] + more, base + keep, len(data) - keep
            record = 0 if record is not None else None
            continue
        at, what = mark.end(), mark[0]
        if what == b'"':
            at, state = skip_string(data, at, INSIDE)
        elif what in b"[{":
            if what == b"{" and depth == 1:
                if base + mark.start() >= end:
                    return
                record = mark.start()
            depth += 1
        else:
            depth -= 1
            if depth == 1 and record is not None:
                yield data[record:at]
                record = None
                if base + at >= end:
                    return


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, split: int = SPLIT) -> DataFrame:
    """``path, row_no`` (0-based, in the order of the array) and fields of every record of the array files at ``path``; runs a job.

    Records are objects; other elements of an array are skipped.  A broken record stops the job.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))
    ranges = files.where("length > 0").select("file", F.explode(starts).alias("start"), "length")
    ranges = ranges.select("file", "start", F.least(F.lit(split).cast("long"), F.col("length") - F.col("start")).alias("size"))
    ranges = stage(ranges, "json-ranges")
    tasks = max(1, ranges.count())
    ranges = ranges.repartitionByRange(tasks, "file", "start")

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                with _open(r.file) as f:
                    data = f.read_at(r.size, r.start)
                ends = [scan(data, s) for s in (OUTSIDE, INSIDE, ESCAPED)]
                yield pd.DataFrame({
                    "file": [r.file], "start": [r.start], "size": [r.size], "state": [[e[0] for e in ends]], "depth": [[e[1] for e in ends]],
                    "opened": [[list(map(list, e[2].items())) for e in ends]]})

    noted = stage(ranges.mapInPandas(
        scanned, "file string, start long, size long, state array<int>, depth array<int>, opened array<array<array<long>>>"), "json-notes")

    def chained(notes: pd.DataFrame) -> pd.DataFrame:
        state, depth, row, out = OUTSIDE, 0, 0, []
        for r in notes.sort_values("start").itertuples(index=False):
            out.append((r.file, r.start, r.size, state, depth, row))
            row += sum(int(n) for d, n in r.opened[state] if int(d) + depth == 1)
            state, depth = int(r.state[state]), depth + int(r.depth[state])
        return pd.DataFrame(out, columns=["file", "start", "size", "state", "depth", "row"])

    begun = noted.groupBy("file").applyInPandas(chained, "file string, start long, size long, state int, depth int, row long")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                with _open(r.file) as f:
                    rows, held = [], 0
                    for i, record in enumerate(cut(lambda at, n, f=f: f.read_at(n, at), r.start, r.size, r.state, r.depth)):
                        rows.append((r.file, r.row + i, record.decode()))
                        held += len(record)
                        if held > 4 << 20:
                            yield pd.DataFrame(rows, columns=["path", "row_no", "value"])
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=["path", "row_no", "value"])

    spread = stage(begun, "json-starts").repartitionByRange(tasks, "file", "start")
    each = spread.mapInPandas(records, "path string, row_no long, value string")
    parsed = each.select("path", "row_no", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("path", "row_no", "r.*")


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array of objects per partition, rows in the order of the partition."""
    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            lines = [("[" if first and i == 0 else ",") + v for i, v in enumerate(batch["value"])]
            first = first and not lines
            yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInPandas(framed, "value string").write.text(path)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
