"""Operator 12: fill-in-middle forms of documents, by DuckDB's SQL over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one SQL statement looks at; a longer text has a statement of its own.
AT_ONCE = 4 << 20

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

#: The whole rule over a relation `batch` (doc_id, text). list_slice takes places from 1, both ends included.
RULE = r"""
with cut as (
    select doc_id, text, regexp_extract_all(text, '{token}') as tokens, sha256('{seed}:' || coalesce(doc_id::varchar, '')) as hex from batch
), drawn as (
    select *, len(tokens) as n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(hex, i, 8))::bigint) as h from cut
), placed as (
    select *, least(h[1] % (n + 1), h[2] % (n + 1)) as low, greatest(h[1] % (n + 1), h[2] % (n + 1)) as high,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= {rate} then 'plain'
             when h[4] % 100 < {spm} then 'spm' else 'psm' end as form
    from drawn
), parts as (
    select doc_id, text, n, form, array_to_string(list_slice(tokens, 1, low), '') as prefix, array_to_string(list_slice(tokens, low + 1, high), '') as middle,
        array_to_string(list_slice(tokens, high + 1, n), '') as suffix
    from placed
), formed as (
    select *, case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end as output
    from parts
), reread as (
    select *, case when form = 'plain' then [output] else string_split_regex(output, '<[PSM]>') end as found from formed
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
    case when form <> 'plain' then length(middle) end::bigint as middle_chars, output, sha256(output) as output_sha256,
    sha256(case form when 'plain' then found[1] when 'psm' then found[2] || found[4] || found[3] else found[3] || found[4] || found[2] end) as restored_sha256
from reread
"""

_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def slices(batch: pa.RecordBatch, column: str, at_once: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about at_once bytes of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + at_once, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 50, spm: int = 80, seed: int = 42, at_once: int = AT_ONCE) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    A text is cut at two of its n + 1 token borders, drawn from the sha256 of seed and id, and put together as suffix, prefix, middle
    (`spm`, in `spm` of 100 cases) or prefix, suffix, middle (`psm`) after the marks <S>, <P>, <M>; `rate` of 100 documents are
    changed. A text that holds a mark stays plain, so an output splits at its marks in one way only: a mark begins with `<` and ends
    with `>`, so no two of them, nor a mark and the text beside it, make another. restored_sha256 is of the text rebuilt from the output.

    Null texts are empty (plain, n = 0); null ids draw as an empty id; repeated rows come out alike; an empty table gives
    none; other columns are ignored, whatever their names. Very long texts are cut like others: a statement holds about `at_once` bytes
    or one text, and DuckDB works in one thread and writes no files. Python sees batches only, never rows.
    """
    rule = RULE.format(token=TOKEN, seed=seed, rate=rate, spm=spm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        for batch in batches:
            for part in slices(batch, "text", at_once):
                con.register("batch", pa.Table.from_batches([part]))
                yield from con.sql(rule).to_arrow_table().to_batches()
                con.unregister("batch")

    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return read.mapInArrow(run, _SCHEMA)


#: The query's rows by another way: cuts by places in the text, found by lengths of tokens, and the text itself as what must come back.
ORACLE = r"""
with h as (
    select doc_id, coalesce(text, '') as t, sha256('42:' || doc_id) as hex, list_transform(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) as sizes
    from documents
), c as (
    select *, len(sizes) as n, ('0x' || hex[1:8])::bigint % (len(sizes) + 1) as a, ('0x' || hex[9:16])::bigint % (len(sizes) + 1) as b, ('0x' || hex[17:24])::bigint as h3, ('0x' || hex[25:32])::bigint as h4 from h
), p as (
    select *, coalesce(list_sum(sizes[1:least(a, b)]), 0)::bigint as p, coalesce(list_sum(sizes[1:greatest(a, b)]), 0)::bigint as q,
        t = '' or regexp_matches(t, '<[PSM]>') or h3 % 100 >= 50 as plain from c
)
select doc_id, n::bigint as n, case when plain then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form, case when not plain then p end as prefix_chars, case when not plain then q - p end as middle_chars,
    sha256(case when plain then t when h4 % 100 < 80 then '<S>' || t[q + 1:] || '<P>' || t[:p] || '<M>' || t[p + 1:q] else '<P>' || t[:p] || '<S>' || t[q + 1:] || '<M>' || t[p + 1:q] end) as output_sha256,
    sha256(t) as restored_sha256
from p
"""
