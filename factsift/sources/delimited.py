"""Delimited text with quoted fields, read by many tasks.

Fields follow Python's ``csv`` defaults: a quote opens a quoted field only at
the field's start, a doubled quote in it is a quote, it may hold separators and
newlines, and what stands behind its closing quote belongs to the field
(``"abc" def`` reads ``abc def``); elsewhere quotes are ordinary characters.

Whether a line begins inside a quoted field depends on all lines before it, so
a file seems to need one reader. But a line only maps the state before it to
the state behind it, and such maps compose:

1. every task maps its blocks (file splits): the state behind the block and the
   records that begin in it, for either state before it; one row a block;
2. the driver composes these rows in file order: state and number of records
   before every block, and the header of every file;
3. every task reads its blocks with the right state. A record that crosses a
   block's end is sent on as pieces, put together by its number; these are at
   most one a block.

Lines end with ``\\n``, ``\\r\\n`` or ``\\r`` and are joined with ``\\n``, as Python's text
files are. Blank lines outside quotes are no records, before the header either. The first
record of each file is its header and must end in the file's first block; columns are found
by name (the last of equal ones), missing fields are null, others are left out.
An unclosed quote ends with its file, but for the file's last newline.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift.session import ship_package
from factsift.sources.files import input_paths

_SUMMARY = "file string, block long, out_end boolean, in_end boolean, out_records long, in_records long, header string, stopped boolean"
BOM = "﻿"


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open behind ``line``, given whether one is before it."""
    if '"' not in line:
        return inside
    for field in line.split(sep):
        if inside:
            rest = field
        elif field.startswith('"'):
            rest = field[1:]
        else:
            continue
        inside = '"' not in rest.replace('""', "")
    return inside


def parse_record(lines: list[str], sep: str) -> list[str]:
    """The fields of one record's lines."""
    if len(lines) == 1 and '"' not in lines[0]:
        return lines[0].split(sep)
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader([line + "\n" for line in lines[:-1]] + lines[-1:], delimiter=sep))


def _lines(batches: Iterator[pa.RecordBatch]):
    """``(file, block, line)`` in order."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _summarise(sep: str, limit: int | None, one_file: bool):
    """One row a block. Behind ``limit`` records for either state a block is left
    (``stopped``); of one file's blocks those behind it in the task then don't matter."""
    def run(batches):
        key, state, done = None, None, []
        for file, block, line in _lines(batches):
            if (file, block) != key:
                if key is not None:
                    done.append((*key, *state))
                key, state, first = (file, block), [False, True, 0, 0, None, False], []
            elif state[5]:
                continue
            out, inner = state[0], state[1]
            if block == 0 and state[4] is None and (first or line):
                first.append(line)
                if not inside_after(line, out, sep):
                    state[4] = "\n".join(first)
            state[2] += bool(line) and not out
            state[3] += bool(line) and not inner
            state[0] = inside_after(line, out, sep)
            state[1] = state[0] if inner == out else inside_after(line, inner, sep)
            if limit is not None and max(state[2], state[3]) > limit:
                state[5] = True
                if one_file:
                    break
        if key is not None:
            done.append((*key, *state))
        yield pa.RecordBatch.from_pylist([dict(zip(_SUMMARY_NAMES, r)) for r in done], _SUMMARY_ARROW)
    return run


_SUMMARY_NAMES = [c.split()[0] for c in _SUMMARY.split(", ")]
_SUMMARY_ARROW = pa.schema(list(zip(_SUMMARY_NAMES, [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.bool_()])))


def _compose(summaries, sep: str, limit: int | None):
    """``{(file, block): (inside, records before)}``, ``{file: header fields}`` in file
    order, up to ``limit`` records, and their number; None if a block was left too early to tell."""
    starts, headers = {}, {}
    file, inside, count = None, False, 0
    for row in sorted(summaries, key=lambda r: (r.file, r.block)):
        if limit is not None and count >= limit:
            break
        if row.file != file:
            file, inside = row.file, False
            if row.header is not None:
                headers[file] = parse_record(row.header.removeprefix(BOM).split("\n"), sep)
                count -= 1    # the header is a record of the file, not of the data
        if file not in headers and row.out_records:
            raise ValueError(f"the header of {file} doesn't end in the file's first block")
        starts[(row.file, row.block)] = (inside, count)
        count += row.in_records if inside else row.out_records
        if row.stopped and count < limit:
            return None
        inside = row.in_end if inside else row.out_end
    return starts, headers, count


def _records(starts, headers, columns: Sequence[str], sep: str, null: str | None, limit: int | None):
    """Records that lie within a block as rows, others as pieces of text."""
    names = ["seq", "file", *columns, "block", "piece"]
    schema = pa.schema([("seq", pa.int64()), ("file", pa.string()), *((c, pa.string()) for c in columns),
                        ("block", pa.int64()), ("piece", pa.string())])

    def run(batches):
        places, key, inside, at, held, skip = [], None, False, 0, [], False
        rows: list[tuple] = []
        blank = [None] * len(columns)

        for file, block, line in _lines(batches):
            if (file, block) != key:
                if held:                            # a record that goes on in the next block
                    rows.append((at, key[0], *blank, key[1], "\n".join(held)))
                key, held = (file, block), []
                skip = key not in starts.value      # behind the limit
                if not skip:
                    inside, before = starts.value[key]
                    at, continued = before - inside, inside
                    header_at = before if block == 0 else None
                    places = _places(headers.value.get(file, []), columns)
            if skip or not (inside or line):
                continue
            held.append(line)
            inside = inside_after(line, inside, sep)
            if not inside:
                if continued:
                    rows.append((at, file, *blank, block, "\n".join(held)))
                    continued = False
                elif at != header_at:
                    rows.append((at, file, *values(parse_record(held, sep), places, null), None, None))
                at, held = at + 1, []
                skip = limit is not None and at >= limit
            if len(rows) >= 5000:
                yield _batch(rows, names, schema)
                rows = []
        if held:
            rows.append((at, key[0], *blank, key[1], "\n".join(held)))
        yield _batch(rows, names, schema)
    return run


def _places(header: list[str], columns: Sequence[str]) -> list[int | None]:
    """Where the columns stand; the last of equal names counts."""
    where = {name: i for i, name in enumerate(header)}
    return [where.get(c) for c in columns]


def values(fields: list[str], places: list[int | None], null: str | None) -> list[str | None]:
    """A record's values of the asked columns."""
    found = [fields[i] if i is not None and i < len(fields) else None for i in places]
    return [None if v is not None and v == null else v for v in found]


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                      [pa.array([], type=f.type) for f in schema], names=names)


def _assembled(headers, columns: Sequence[str], sep: str, null: str | None):
    schema = pa.schema([("seq", pa.int64()), ("file", pa.string()), *((c, pa.string()) for c in columns)])

    def run(batches):
        for batch in batches:
            rows = []
            for seq, file, text in zip(*(c.to_pylist() for c in batch.columns)):
                places = _places(headers.value[file], columns)
                rows.append((seq, file, *values(parse_record(text.split("\n"), sep), places, null)))
            yield _batch(rows, schema.names, schema)
    return run


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "\t", glob: str | None = None,
                   null: str | None = None, limit: int | None = None) -> DataFrame:
    """``seq, file`` and ``columns`` (strings) of all records below ``path``.

    ``seq`` numbers the records densely from 0, by file path and place. With
    ``limit`` only records of a ``seq`` below it are read: leading files in
    doubling numbers, whose blocks are left behind that many records. Every file
    of any length is split; one row a split comes to the driver and travels to
    the tasks as a broadcast (100,000 rows for 100 TB at 1 GB a split).
    """
    ship_package(spark)
    reader = spark.read.option("recursiveFileLookup", "false")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    composed, taken = None, 1
    paths = input_paths(raw) if limit is not None else []
    while composed is None:
        source = raw if limit is None else spark.read.text(paths[:taken])
        lines = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
        summaries = lines.mapInArrow(_summarise(sep, limit, taken == 1 and limit is not None), _SUMMARY).collect()
        composed = _compose(summaries, sep, limit)
        if composed is None:                        # a block was left before its state was known
            summaries = lines.mapInArrow(_summarise(sep, None, False), _SUMMARY).collect()
            composed = _compose(summaries, sep, limit)
        if taken < len(paths) and composed[2] < limit:
            composed, taken = None, 2 * taken
    starts, headers = (spark.sparkContext.broadcast(x) for x in composed[:2])
    typed = "seq long, file string, " + ", ".join(f"`{c}` string" for c in columns)
    found = lines.mapInArrow(_records(starts, headers, columns, sep, null, limit), f"{typed}, block long, piece string")
    out = found.where("piece IS NULL").select("seq", "file", *[f"`{c}`" for c in columns])
    if any(row.out_end or (row.file, row.block) in composed[0] and composed[0][(row.file, row.block)][0] for row in summaries):
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "\n")
        pieces = found.where("piece IS NOT NULL").groupBy("seq", "file").agg(text.alias("text"))
        out = out.unionByName(pieces.mapInArrow(_assembled(headers, columns, sep, null), typed))
    return out if limit is None else out.where(F.col("seq") < limit)

