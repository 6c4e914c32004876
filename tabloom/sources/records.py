"""Records of a CSV file whose quoted values may hold line ends, read by as many tasks as the file has splits.

A split begins at a line of which nobody knows whether it lies within quotes. So each line is taken as a function of that state (outside or
within quotes) to the state at its end; a first scan composes the functions of each split, the driver folds the splits' results (one row a
split), and a second scan cuts records where the state says so. A record that runs over splits is put together from its parts by a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Rest of a line from the start of a field on: whole fields, then one that opens a quote and doesn't close it.
_OPENS = r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+,)*+"(?:[^"]++|"")*+$'
# A line within quotes: no closing quote, or one, the rest of its field, and fields as above.
_STAYS = rf'^(?:[^"]++|"")*+(?:$|"[^,]*+,{_OPENS})'


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """Per line: split (its file and first byte there), id (rises with the place in the file), line, and whether its end lies
    within quotes if its start doesn't (from_out) or does (from_in)."""
    line = F.col("value")
    # a carriage return before the line's end is no part of a value's text for the state, but of a quoted value
    bare = F.regexp_replace(line, "\r$", "")
    quoted = F.contains(line, F.lit('"'))
    return spark.read.text(path, lineSep="\n").select(
        F.concat_ws(":", "_metadata.file_path", F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")).alias("split"), F.monotonically_increasing_id().alias("id"), line.cast("binary").alias("line"),
        (quoted & bare.rlike("^" + _OPENS)).alias("from_out"), (~quoted | bare.rlike(_STAYS)).alias("from_in"), F.is_valid_utf8(line).alias("utf8"),
    )


def states(from_out: np.ndarray, from_in: np.ndarray, start: bool) -> np.ndarray:
    """The state before each line and after the last one, for the state before the first: True within quotes."""
    n = len(from_out)
    fixed = from_out == from_in
    flips = np.concatenate([[0], np.cumsum(from_out & ~from_in)])
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1)) if n else np.zeros(0, int)
    base = np.where(last >= 0, from_out[last] if n else start, start)
    after = base ^ ((flips[1:] - np.where(last >= 0, flips[last + 1], 0)) & 1).astype(bool)
    return np.concatenate([[start], after])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The batch cut where another split begins."""
    a = 0
    for run in pc.run_end_encode(batch.column("split")).values if batch.num_rows else []:
        b = a + pc.sum(pc.equal(batch.column("split"), run)).as_py()
        yield run.as_py(), batch.slice(a, b - a)
        a = b


def _flags(part: pa.RecordBatch, start: bool) -> np.ndarray:
    return states(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("from_out", "from_in")), start)


_SUMMARY = "split string, out_to boolean, in_to boolean, in_starts boolean, utf8 boolean, first bigint, spans boolean"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list] = {}
    for batch in batches:
        for split, part in _runs(batch):
            s = found.setdefault(split, [False, True, False, True, None, False])
            inside = _flags(part, s[1])
            outside = _flags(part, s[0])
            s[0], s[1] = bool(outside[-1]), bool(inside[-1])
            s[5] |= bool(outside.any())
            s[2] |= not inside[:-1].all()
            s[3] &= pc.all(part.column("utf8")).as_py()
            if s[4] is None:
                filled = part.column("id").filter(pc.invert(pc.is_in(part.column("line"), value_set=pa.array([b"", b"\r"], part.column("line").type))))
                s[4] = filled[0].as_py() if len(filled) else None
    rows = [[k, *v] for k, v in found.items()]
    types = [pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [x.split()[0] for x in _SUMMARY.split(", ")])


def _joined(part: pa.RecordBatch, starts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Lines from each start to the next one as one text; ids of their first lines."""
    offsets = pa.array(np.append(starts, len(part)).astype(np.int32), pa.int32())
    texts = pc.binary_join(pa.ListArray.from_arrays(offsets, part.column("line").cast(pa.binary())), b"\n")
    return part.column("id").take(pa.array(starts, pa.int64())), texts


_PARTS = "id bigint, record binary, owner string"


def _cut(begins: dict[str, tuple[bool, str | None]], most: int | None):
    """Records that lie in one split (owner null), and the parts of the others (owner: the split in which they begin). With `most`
    a task stops once it has so many."""

    def out(ids, texts, owner: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, texts.cast(pa.binary()), pa.array([owner] * len(ids), pa.string())], ["id", "record", "owner"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # lines whose record hasn't ended, as batches; the split they are in, and who owns them: none as long as it begins here
        held: list[pa.RecordBatch] = []
        at, state, owner, done = None, False, None, 0

        def flush(owner):
            lines = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            return out(*_joined(lines, np.zeros(1, np.int64)), owner)

        for batch in batches:
            for split, part in _runs(batch):
                if split != at:
                    if held:  # ends open unless the split's last line closed it
                        yield flush(owner if owner is not None else (at if state else None))
                    at, (state, before) = split, begins[split]
                    owner = before if state else None
                inside = _flags(part, state)
                state = bool(inside[-1])
                starts = np.flatnonzero(~inside[:-1])
                if not len(starts):
                    held.append(part)
                    continue
                if starts[0]:
                    held.append(part.slice(0, starts[0]))
                if held:
                    yield flush(owner)
                owner = None
                # the last record may go on in the next batch
                end = int(starts[-1])
                if len(starts) > 1:
                    yield out(*_joined(part.slice(0, end).slice(int(starts[0])), starts[:-1] - starts[0]), None)
                held.append(part.slice(end))
                done += len(starts)
                if most is not None and done > most:
                    return
        if held:
            yield flush(owner if owner is not None else (at if state else None))

    return run


def splits_of(spark: SparkSession, path: str) -> list[Row]:
    """Each split's lines as one function of the state, and whether a record of it spans lines if it begins outside quotes (spans)."""
    return sorted(physical_lines(spark, path).mapInArrow(_summaries, _SUMMARY).collect())


def charset_of(splits: list[Row]) -> str:
    """UTF-8, or latin-1 if not all is UTF-8."""
    return "UTF-8" if all(s.utf8 for s in splits) else "ISO-8859-1"


def _first_record(lines: DataFrame, first: int) -> bytes:
    """The record that begins at a line, from as many lines as it has."""
    n = 1
    while True:
        rows = lines.where(F.col("id") >= first).select("line", "from_out", "from_in").take(n)
        inside = states(np.array([r.from_out for r in rows]), np.array([r.from_in for r in rows]), False)[1:]
        if not inside.all() or len(rows) < n:
            stop = len(rows) if inside.all() else int(np.argmin(inside)) + 1
            return b"\n".join(bytes(r.line) for r in rows[:stop])
        n *= 8


def read_records(spark: SparkSession, path: str, most: int | None = None, splits: list[Row] | None = None) -> tuple[DataFrame, str | None]:
    """(id, record) of a CSV file (or folder of files with equal headers) less its header, line ends within quotes kept; and the header (None if all is
    blank). Blank records are left out.

    ids rise with the place in a file. What isn't UTF-8 throughout is read as latin-1. Quotes open a value only at its start and are escaped by
    doubling; one that is never closed runs to the end of its file. With `most` only the first so many records. The driver gets one row
    for each split.
    """
    lines = physical_lines(spark, path)
    splits = splits_of(spark, path) if splits is None else splits
    begins, headers, state, owner, file, torn_any = {}, {}, False, None, None, False
    for s in splits:
        name = s.split.rpartition(":")[0]
        if name != file:
            file, state, owner = name, False, None
        begins[s.split] = (state, owner)
        if s.first is not None:
            headers.setdefault(name, s.first)
        starts_here = not state or s.in_starts
        state = s.in_to if state else s.out_to
        torn_any |= state
        if state and starts_here:
            owner = s.split
    if not headers:
        return spark.createDataFrame([], "id bigint, record string"), None
    charset = charset_of(splits)
    parts = lines.select("split", "id", "line", "from_out", "from_in").mapInArrow(_cut(begins, None if most is None else most + 1), _PARTS)
    whole = parts.where("owner IS NULL").select("id", "record")
    if torn_any:  # else no record runs over splits
        torn = parts.where("owner IS NOT NULL").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("id", "record"))).alias("x"))
        glue = F.reduce("x", F.lit(None).cast("binary"), lambda a, x: F.when(a.isNull(), x.record).otherwise(F.concat(a, F.lit(b"\n"), x.record)))
        whole = whole.unionByName(torn.select(F.col("x")[0].id.alias("id"), glue.alias("record")))
    text = F.regexp_replace(F.decode("record", charset), "\r$", "")
    found = whole.where(~F.col("id").isin(*headers.values())).select("id", text.alias("record")).where(F.length("record") > 0)
    if most is not None:
        found = found.orderBy("id").limit(most)
    header = _first_record(lines, min(headers.values())).decode(charset)
    return found, header.removesuffix("\r")


def fields(record: Column, n: int) -> Column:
    """The first n values of a record as a struct of texts c0, c1, ...; those that aren't there are null."""
    return F.from_csv(record, ", ".join(f"c{i} string" for i in range(n)), {"escape": '"', "multiLine": "true"})
