"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in a normal form: lower case, runs of characters that are no letter or digit as one
space.  An item of m characters may occur in a document with up to k = floor(rate m) edits.  It is cut
in k + 1 pieces; an occurrence with at most k edits leaves at least one piece untouched, so every
occurrence has an exact hit of a piece near its place in the item.  Pieces of all items are found in
one pass with an Aho-Corasick automaton.  A hit gives a stretch of the document that must hold the
occurrence; if it shares enough trigrams with the item (each edit breaks at most three), Myers'
bit-parallel scan computes the least edit distance of the item to any part of the stretch.

Items are taken in blocks of at most ``BLOCK_CHARS`` normalised characters, each with its own automaton;
every block is one pass over the documents, so any number of items is matched whole.

Defined cases: an item of fewer than ``min_chars`` normalised characters matches only as it is, between
word bounds; items that are null or have no letter or digit match nothing; null texts match nothing; rows with equal ids give one row per id and item, with the least distance.
Columns other than ids and texts are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_CHARS = 1 << 20
_GAP = re.compile(r"[\W_]+")
_ASCII = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def normalised(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split()).decode()
    return _GAP.sub(" ", text.lower()).strip()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item cut in k + 1 pieces of nearly equal length, with their places."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(item_bits: dict[str, int], m: int, text: str) -> int:
    """Least edit distance between the whole item and any part of the text (Myers' bit vectors)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for c in text:
        eq = item_bits.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
    return best


class Matcher:
    """All items of one block: automaton of their pieces, and what verification needs."""

    def __init__(self, items: list[tuple[object, str]], rate: float, min_chars: int):
        self.items, self.min_chars = items, min_chars
        self.automaton = ahocorasick.Automaton()
        hits: dict[str, list] = {}
        self.budget, self.bits, self.grams = [], [], []
        for index, (_, text) in enumerate(items):
            k = int(rate * len(text)) if len(text) >= min_chars else 0
            self.budget.append(k)
            bits: dict[str, int] = {}
            for i, c in enumerate(text):
                bits[c] = bits.get(c, 0) | 1 << i
            self.bits.append(bits)
            self.grams.append({text[i : i + 3] for i in range(len(text) - 2)})
            for place, piece in pieces(text, k):
                hits.setdefault(piece, []).append((index, place))
        for piece, where in hits.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, int]:
        """Distance per item (by index) that the text holds within its budget."""
        found: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()
        for end, (size, where) in self.automaton.iter(text):
            for index, place in where:
                start = end + 1 - size - place
                if found.get(index) == 0 or (index, start) in seen:
                    continue
                seen.add((index, start))
                item, k = self.items[index][1], self.budget[index]
                if len(item) < self.min_chars:
                    if (start == 0 or text[start - 1] == " ") and text[end + 1 : end + 2] in ("", " "):
                        found[index] = 0
                    continue
                if text.startswith(item, max(start, 0)) and start >= 0:
                    found[index] = 0
                    continue
                stretch = text[max(0, start - k) : start + len(item) + k]
                grams = self.grams[index]
                common = len(grams.intersection(stretch[i : i + 3] for i in range(len(stretch) - 2)))
                if common < len(grams) - 3 * k:
                    continue
                distance = myers(self.bits[index], len(item), stretch)
                if distance <= k and distance < found.get(index, k + 1):
                    found[index] = distance
        return found


class Decontaminator:
    """Documents that hold benchmark items, up to a rate of edits per character."""

    def __init__(self, rate: float = 0.08, min_chars: int = 40):
        self.rate, self.min_chars = rate, min_chars

    def blocks(self, benchmark: DataFrame, item_key: str, text: str) -> Iterator[list[tuple[int, str]]]:
        """Normalised items in blocks of bounded size, read one block at a time."""

        def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [normalised(t) for t in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("_item"), pa.array(done, pa.string())], ["_item", "_text"])

        kind = benchmark.schema[item_key].dataType.simpleString()
        items = benchmark.select(F.col(item_key).alias("_item"), F.col(text).alias("_text"))
        items = items.mapInArrow(normal, f"_item {kind}, _text string").filter(F.length("_text") > 0)
        block: list[tuple[int, str]] = []
        held = 0
        for row in items.toLocalIterator():
            if block and held + len(row._text) > BLOCK_CHARS:
                yield block
                block, held = [], 0
            block.append((row._item, row._text))
            held += len(row._text)
        if block:
            yield block

    def matches(
        self, docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
    ) -> DataFrame:
        """One row per document and item it holds: key, item_key, distance (edits), budget."""
        kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
        schema = f"_id {kind}, _item {item_kind}, distance long, budget long"
        rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).filter("_text is not null")
        found = None
        for block in self.blocks(benchmark, item_key, item_text):
            part = rows.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(block), self.rate, self.min_chars, to_arrow_type(benchmark.schema[item_key].dataType)), schema)
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = docs.sparkSession.createDataFrame([], schema)
        return (
            found.groupBy("_id", "_item")
            .agg(F.min("distance").alias("distance"), F.min("budget").alias("budget"))
            .withColumnsRenamed({"_id": key, "_item": item_key})
        )

    def clean(self, docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
        """The rows of docs that hold no item, all columns as they are; nothing is shuffled."""
        for block in self.blocks(benchmark, item_key, item_text):
            docs = docs.mapInArrow(_dropper(docs.sparkSession.sparkContext.broadcast(block), self.rate, self.min_chars, text), docs.schema)
        return docs


def _dropper(block, rate: float, min_chars: int, text: str):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value, rate, min_chars)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.matches(normalised(t.as_py())) for t in batch.column(text)], pa.bool_()))

    return drop


def _finder(block, rate: float, min_chars: int, item_type: pa.DataType):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value, rate, min_chars)
        for batch in batches:
            rows, items, distances, budgets = [], [], [], []
            for i, text in enumerate(batch.column("_text")):
                for index, distance in matcher.matches(normalised(text.as_py())).items():
                    rows.append(i)
                    items.append(matcher.items[index][0])
                    distances.append(distance)
                    budgets.append(matcher.budget[index])
            ids = batch.column("_id").take(pa.array(rows, pa.int64()))
            columns = [ids, pa.array(items, item_type), pa.array(distances, pa.int64()), pa.array(budgets, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_item", "distance", "budget"])

    return find
