"""Packing of documents into sequences of fixed length: bounded-space best-fit with cuts.

Every task keeps at most ``windows`` open windows.  A document gives whole sequences of its own first;
what is left goes to the open window that it fills most.  Where it fits none and no window may be
opened, the fullest window takes as much of it as it still holds and is closed, and the rest is placed
again.  So closed windows are full.  What stays open at the end of a task is written with its ids; groups
of ``FAN_IN`` tasks are then merged the same way, round by round, until one group is left.  Its windows
are poured together, and the last, partly filled one is cut at powers of two, which need no padding.

A task holds one slice of texts and its windows; a merge holds the windows of ``FAN_IN`` tasks (32 MB of
ids with the defaults), whatever the input.  Rounds grow with the logarithm of the number of tasks.

Defined cases: a null or empty text has the end id alone.  Very long texts are sequences of their own
and a rest.  Repeated rows are packed as often as they come, so an id may come several times; a null id
stays null.  Columns other than the key and the text are ignored.  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import Scratch
from sluice.llm.tokens import Encoder, token_ids
from sluice.llm.words import text_slices

FAN_IN = 64
SLICE = 4 << 20

#: key, start in the document, ids, tokens of the document
Piece = tuple[object, int, np.ndarray, int]


def cut(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``size`` ids of some pieces, and the rest."""
    head: list[Piece] = []
    for i, (key, start, ids, total) in enumerate(pieces):
        if len(ids) > size:
            if size:
                head.append((key, start, ids[:size], total))
            return head, [(key, start + size, ids[size:], total), *pieces[i + 1 :]]
        head.append(pieces[i])
        size -= len(ids)
    return head, []


class Packer:
    """At most ``windows`` open windows of ``length`` tokens."""

    def __init__(self, length: int, windows: int):
        self.length, self.windows = length, windows
        self.used: list[int] = []  # rising
        self.held: list[list[Piece]] = []

    def _put(self, pieces: list[Piece], size: int) -> None:
        at = bisect_right(self.used, size)
        self.used.insert(at, size)
        self.held.insert(at, pieces)

    def add(self, item: list[Piece]) -> Iterator[list[Piece]]:
        """Place the pieces of an item; yields the sequences that become full."""
        size = sum(len(p[2]) for p in item)
        while size >= self.length:
            full, item = cut(item, self.length)
            size -= self.length
            yield full
        while size:
            best = bisect_right(self.used, self.length - size) - 1
            if best < 0 and len(self.used) < self.windows:
                self._put(item, size)
                return
            used, held = self.used.pop(best), self.held.pop(best)  # -1 is the fullest
            head, item = cut(item, self.length - used)
            taken = sum(len(p[2]) for p in head)
            size -= taken
            if used + taken == self.length:
                yield held + head
            else:
                self._put(held + head, used + taken)

    def pour(self) -> Iterator[list[Piece]]:
        """Close all windows: the fullest are filled from the emptiest, the last is cut at powers of two."""
        while len(self.held) > 1:
            used, held = self.used.pop(), self.held.pop()
            low, rest = self.used.pop(0), self.held.pop(0)
            head, rest = cut(rest, self.length - used)
            taken = sum(len(p[2]) for p in head)
            if used + taken == self.length:
                yield held + head
            else:
                self._put(held + head, used + taken)
            if rest:
                self._put(rest, low - taken)
        for size, rest in zip(self.used, self.held, strict=True):
            while size:
                power = 1 << size.bit_length() - 1
                head, rest = cut(rest, power)
                yield head
                size -= power
        self.used, self.held = [], []


class _Rows:
    """Output rows of sequences, as Arrow batches."""

    def __init__(self, kind: pa.DataType, keep_ids: bool):
        self.kind, self.keep_ids, self.rows = kind, keep_ids, []

    def closed(self, pieces: list[Piece], sequence: int) -> None:
        at = 0
        for key, start, ids, total in pieces:
            data = ids.tobytes()
            self.rows.append((key, start, len(ids), zlib.crc32(data), total, sequence, at, None, None, data if self.keep_ids else None))
            at += len(ids)

    def left(self, pieces: list[Piece], task: int, window: int) -> None:
        at = 0
        for key, start, ids, total in pieces:
            self.rows.append((key, start, len(ids), None, total, None, at, task, window, ids.tobytes()))
            at += len(ids)

    def table(self) -> pa.RecordBatch:
        long = pa.int64()
        kinds = [self.kind, long, long, long, long, long, long, long, long, pa.binary()]
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(kinds)
        made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], COLUMNS)
        self.rows = []
        return made


COLUMNS = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "window", "ids"]


class SequencePacker:
    """Documents as pieces of sequences of ``length`` tokens; ``path`` is a tokenizer file that all executors can read."""

    def __init__(self, path: str, length: int = 2048, end_id: int = 1, windows: int = 64):
        if length < 1 or windows < 1:
            raise ValueError("a sequence holds a token or more, and a task has a window or more")
        self.path, self.length, self.end_id, self.windows = path, length, end_id, windows

    def pack(self, docs: DataFrame, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
        """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
        scratch = Scratch(docs.sparkSession, "packing")
        rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        kind = f"key {rows.schema['key'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COLUMNS[1:-1]) + ", ids binary"
        tables = [scratch.put(rows.mapInArrow(self._first(Encoder(self.path).ranked is not None, keep_ids), kind), "packed")]
        level = 0
        while True:
            level += 1
            left = tables[-1].filter("sequence_id is null")
            groups = left.agg(F.max("task")).first()[0]
            if groups is None:
                break
            last = groups < FAN_IN
            merged = left.withColumn("group", F.floor(F.col("task") / FAN_IN)).groupBy("group").applyInArrow(self._merge(level, last, keep_ids), kind)
            tables.append(scratch.put(merged, "merged"))
        every = tables[0]
        for table in tables[1:]:
            every = every.unionByName(table)
        wanted = [F.col("key").alias(key), *COLUMNS[1:7], *(["ids"] if keep_ids else [])]
        return every.filter("sequence_id is not null").select(*wanted)

    def _first(self, by_rank: bool, keep_ids: bool):
        path, length, end_id, windows = self.path, self.length, np.uint32(self.end_id), self.windows

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, sequence, task, out, encoder = Packer(length, windows), 0, TaskContext.get().partitionId(), None, None
            for batch in batches:
                out = out or _Rows(batch.schema.field(0).type, keep_ids)
                encoder = encoder or Encoder(path, by_rank)
                for low, high, _, _ in text_slices(batch.column(1), SLICE):
                    ids, bounds = token_ids(batch.column(1).slice(low, high - low), encoder)
                    keys = batch.column(0).slice(low, high - low).to_pylist()
                    for i, own in enumerate(keys):
                        tokens = np.append(ids[bounds[i] : bounds[i + 1]], end_id).astype("<u4")
                        for full in packer.add([(own, 0, tokens, len(tokens))]):
                            out.closed(full, task << 32 | sequence)
                            sequence += 1
                    yield out.table()
            if out:
                for window, pieces in enumerate(packer.held):
                    out.left(pieces, task, window)
                yield out.table()

        return pack

    def _merge(self, level: int, last: bool, keep_ids: bool):
        length, windows = self.length, self.windows

        def merge(table: pa.Table) -> pa.Table:
            group = table.column("group")[0].as_py()
            out, packer, sequence = _Rows(table.schema.field("key").type, keep_ids), Packer(length, windows), 0
            first = level << 60 | group << 32
            table = table.sort_by([("task", "ascending"), ("window", "ascending"), ("offset", "ascending")])
            places = list(zip(table.column("task").to_pylist(), table.column("window").to_pylist(), strict=True))
            ids = [np.frombuffer(x, "<u4") for x in table.column("ids").to_pylist()]
            pieces = list(zip(table.column("key").to_pylist(), table.column("start").to_pylist(), ids, table.column("doc_tokens").to_pylist(), strict=True))
            item: list[Piece] = []
            for i, piece in enumerate(pieces):
                item.append(piece)
                if i + 1 == len(pieces) or places[i + 1] != places[i]:
                    for full in packer.add(item):
                        out.closed(full, first | sequence)
                        sequence += 1
                    item = []
            if last:
                for full in packer.pour():
                    out.closed(full, first | sequence)
                    sequence += 1
            for window, held in enumerate(packer.held):
                out.left(held, group, window)
            return pa.Table.from_batches([out.table()])

        return merge
