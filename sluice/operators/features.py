"""Term weights over texts: word n-grams, character n-grams, and linear scores on them.

Terms are counted inside the task, over a few texts at a time: each distinct word or piece
of them is looked at once, and no posting is shuffled.  Memory depends on ``SLICE`` or ``WORD_SLICE`` bytes of
text, or on the longest text, not on the rows that Spark hands over at once.

A vocabulary of words and pairs (``frequent_terms``) is counted in two reads of texts whose words are numbers already
(``coded_texts``: cut once, and written with the distinct words of some texts at a time).  The first counts the words.  A pair
is at most as frequent as each of its words, so where the cut has room for n terms, a pair of a word that is rarer
than the n-th word can't be in it.  The second read counts the pairs of the other words, as pairs of numbers.

Other vocabularies (windows of pieces, no cut, or more words than ``CAPACITY``) are counted as strings in one read: every task keeps at most ``CAPACITY`` terms and flushes what it has to one sum per
term (``slice_counts``).  For a cut of a vocabulary far larger than the cut, a task may instead shrink its table by the
Misra-Gries rule (``lossy``): every count loses what the smallest kept one had, so rare terms go and no
count is off by more than the sum of these losses.  The cut is then certain as soon as that sum is below
the count of its last term: what can still belong to it are the candidates, and only these are counted
exactly, in a second read.  Where it isn't, all terms are counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import lexicons as lx
from sluice.operators.prefix import ranked
from sluice.session import stored

WORD = r"[\p{L}\p{N}_]{2,}"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
LOW, HIGH = 3, 5
CAPACITY = 1 << 20
SLICE = 1 << 20
WORD_SLICE = 1 << 22
PAIRS = 1 << 20
ENTRIES = 1 << 18
MAX_FEATURES = 300_000
SPACES = ("word", "char")


def words(text: Column) -> Column:
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def pieces(text: Column) -> Column:
    """Lower-cased runs of anything but white space."""
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


CUTS: dict[str, Callable[[Column], Column]] = {"word": words, "char": pieces}


def _starts(own: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Numbers from ``begin`` on, ``own`` of them each, end to end."""
    return np.arange(own.sum()) + np.repeat(begin - (np.cumsum(own) - own), own)


def piece_windows(names: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The distinct windows of 3 to 5 characters of pieces with one space on each side, the place of every window of
    every piece, piece by piece, and how many each piece has.

    A window is a number, that of the window without its last character and this character; only distinct ones become strings.
    """
    size = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    chars = np.frombuffer("".join(f" {w} " for w in names.to_pylist()).encode("utf-32-le"), np.uint32)
    of_size = [np.maximum(0, size - n + 1) for n in range(LOW, HIGH + 1)]
    many, begin = sum(of_size), np.cumsum(size) - size
    room = np.cumsum(many) - many
    used = np.zeros(0x110000, bool)
    used[chars] = True
    letter, letters = (np.cumsum(used) - 1)[chars], int(used.sum())
    shorter = letter * letters + np.append(letter[1:], 0)  # the number of the window that is one shorter, by start
    place, terms, known = np.empty(int(many.sum()), np.int64), [], 0
    for n, own in zip(range(LOW, HIGH + 1), of_size, strict=True):
        at = _starts(own, begin)
        number = pa.array(shorter[at] * letters + letter[at + n - 1]).dictionary_encode().indices.to_numpy().astype(np.int64)
        shorter = np.zeros(len(chars), np.int64)
        shorter[at] = number
        first = at[np.diff(np.maximum.accumulate(number), prepend=-1) > 0]  # numbers are dealt in order of appearance
        text = chars[first[:, None] + np.arange(n)]
        ends = np.cumsum(np.append(0, (1 + (text >= 0x80).astype(int) + (text >= 0x800) + (text >= 0x10000)).sum(axis=1)))
        terms.append(pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text.tobytes().decode("utf-32-le").encode())))
        place[_starts(own, room)] = known + number
        room, known = room + own, known + len(first)
    return pa.concat_arrays(terms), place, many


def _summed(row: np.ndarray, term: np.ndarray, times: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and total of equal (row, term), in that order."""
    bits = [int(x).bit_length() for x in (terms, times.max(initial=0))]
    if int(row.max(initial=0)).bit_length() + sum(bits) < 64:  # in one number they are sorted without an order of places
        packed = np.sort(((row << bits[0]) | term) << bits[1] | times)
        key, times = packed >> bits[1], packed & ((1 << bits[1]) - 1)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(times, first) if len(key) else times
        return key[first] >> bits[0], key[first] & ((1 << bits[0]) - 1), total
    key = row * max(1, terms) + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(times[order], first) if len(key) else times
    return *np.divmod(key[first], max(1, terms)), total


def slice_counts(cut: pa.ListArray, space: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of some texts, and (row, place in these, count) of each text's terms, by row and place.

    Terms are words and pairs of neighbours, or windows of pieces.
    """
    offsets = cut.offsets.to_numpy()
    flat = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    names, code = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
    row, n = np.repeat(np.arange(len(cut)), np.diff(offsets)), max(1, len(flat.dictionary))
    if space == "word":
        pair = row[1:] == row[:-1]
        keys, at = np.unique(code[:-1][pair] * n + code[1:][pair], return_inverse=True)
        terms = names + [f"{names[a]} {names[b]}" for a, b in zip((keys // n).tolist(), (keys % n).tolist(), strict=True)]
        row, term = np.concatenate([row, row[:-1][pair]]), np.concatenate([code, len(names) + at])
        return terms, *_summed(row, term, np.ones(len(row), np.int64), len(terms))
    terms, row, term, times = _window_entries(cut)
    return terms.to_pylist(), *_summed(row, term, times, len(terms))


def _window_entries(cut: pa.ListArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows of some texts, and row, place in these and times of each distinct piece's windows."""
    texts = Words.of(cut)
    row, piece, times = _summed(texts.row, texts.code, np.ones(len(texts.row), np.int64), len(texts.names))
    terms, place, many = piece_windows(texts.names)
    own = many[piece]
    return terms, np.repeat(row, own), place[_starts(own, (np.cumsum(many) - many)[piece])], np.repeat(times, own)


def _cut(df: DataFrame, spaces: Sequence[str], text: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, *(CUTS[s](F.col(text)).alias(f"_cut_{s}") for s in spaces))


def _slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``most`` bytes of cut text and at most as many rows, one row at least."""
    held = np.ones(batch.num_rows, np.int64)
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if name.startswith("_cut_"):
            upto = np.concatenate(([0], np.cumsum(pc.binary_length(column.values).to_numpy(zero_copy_only=False))))
            held += np.diff(upto[column.offsets.to_numpy()]).astype(np.int64)
    yield from _runs(batch, held, most)


def _runs(batch: pa.RecordBatch, held: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs that hold about ``most``, one row at least."""
    run = np.cumsum(held) // most
    ends = np.concatenate((np.flatnonzero(run[1:] != run[:-1]) + 1, [batch.num_rows])) if batch.num_rows else []
    low = 0
    for high in ends:
        yield batch.slice(low, high - low)
        low = high


@dataclass
class Words:
    """Row and code of every word of some texts, and the distinct words, by code."""

    row: np.ndarray
    code: np.ndarray
    names: pa.Array
    rows: int
    found: np.ndarray | None = None

    @staticmethod
    def of(cut: pa.ListArray) -> "Words":
        offsets = cut.offsets.to_numpy()
        flat = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        return Words(np.repeat(np.arange(len(cut)), np.diff(offsets)), flat.indices.to_numpy().astype(np.int64), flat.dictionary, len(cut))

    def places(self, known: pa.Array) -> np.ndarray:
        """The place of every word among the known ones, -1 for an unknown one."""
        return (_found(self.names, known) if self.found is None else self.found)[self.code]


def _found(names: pa.Array, known: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy().astype(np.int64)


CODED = {"_names": T.ArrayType(T.StringType()), "_size": T.BinaryType(), "_code": T.BinaryType()}
#: Rows of ``coded_texts`` hold some megabytes: the writer looks at the size of its buffer after each.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def coded_texts(df: DataFrame, text: str = "prompt") -> DataFrame:
    """The words of texts as numbers, written once, for what reads them several times; a row per about ``WORD_SLICE`` bytes of words.

    ``_rows`` has the other columns of the texts, ``_names`` the distinct words, ``_size`` the words of each text and
    ``_code`` their places in ``_names``, both as int32.
    """
    keys = [c for c in df.columns if c != text]
    fields = [T.StructField("_rows", T.ArrayType(df.select(*keys).schema))] if keys else []
    schema = T.StructType([*fields, *(T.StructField(c, kind) for c, kind in CODED.items())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, WORD_SLICE):
                words = Words.of(part.column("_cut_word"))
                kept = [pa.StructArray.from_arrays([part.column(k) for k in keys], keys)] if keys else []
                lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in [*kept, words.names]]
                numbers = [np.bincount(words.row, minlength=words.rows), words.code]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in numbers)], schema.names)

    return stored(_cut(df, ["word"], text, keys).mapInArrow(encode, schema), "words", **LARGE_ROWS)


def _is_coded(df: DataFrame) -> bool:
    return CODED.keys() <= set(df.columns)


def _decoded(batch: pa.RecordBatch, known: pa.Array | None = None) -> Iterator[tuple[pa.RecordBatch | None, Words]]:
    """Rows and words of some texts at a time, from ``coded_texts``; the known words are looked up for all at once."""
    found = None if known is None else _found(batch.column("_names").flatten(), known)
    ends = np.cumsum([0, *pc.list_value_length(batch.column("_names")).to_pylist()])
    for i in range(batch.num_rows):
        size, code = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32).astype(np.int64) for c in ("_size", "_code"))
        rows = batch.column("_rows")[i].values if "_rows" in batch.schema.names else None
        part = None if rows is None else pa.RecordBatch.from_arrays(rows.flatten(), [f.name for f in rows.type])
        own = None if found is None else found[ends[i] : ends[i + 1]]
        yield part, Words(np.repeat(np.arange(len(size)), size), code, batch.column("_names")[i].values, len(size), own)


def _neighbours(row: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and number, first * n + second, of every pair of neighbours that are both known."""
    both = (row[1:] == row[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0)
    return row[:-1][both], word[:-1][both] * n + word[1:][both]


def _equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, rising, and how often each comes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _docs_and_occurrences(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of some texts, the texts that have each, and its occurrences."""
    cell, times = _equal(key * rows + row)
    found, docs = _equal(cell // max(1, rows))
    return found, docs, np.add.reduceat(times, np.cumsum(docs) - docs) if len(docs) else times


def _places(terms: list[str], place: dict[str, int]) -> np.ndarray:
    """The place of every term, -1 for an unknown one."""
    return np.fromiter((place.get(t, -1) for t in terms), np.int64, len(terms))


class TermTable:
    """Documents and occurrences per term, at most ``capacity`` of them after each shrink."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.place: dict[str, int] = {}
        self.counts = np.zeros((2, 1024), np.int64)

    @property
    def docs(self) -> dict[str, int]:
        return dict(zip(self.place, self.counts[0].tolist(), strict=False))

    @property
    def occurrences(self) -> dict[str, int]:
        return dict(zip(self.place, self.counts[1].tolist(), strict=False))

    def add(self, counts: dict[str, int]) -> None:
        """One text's terms."""
        self.add_many(list(counts), np.ones(len(counts), np.int64), np.fromiter(counts.values(), np.int64, len(counts)))

    def add_many(self, terms: list[str], docs: np.ndarray, occurrences: np.ndarray) -> None:
        """Distinct terms with the texts that have them and their occurrences there."""
        place = self.place
        at = np.fromiter((place.setdefault(t, len(place)) for t in terms), np.int64, len(terms))
        if len(place) > self.counts.shape[1]:
            self.counts = np.pad(self.counts, ((0, 0), (0, max(len(place), self.counts.shape[1] * 3 // 2) - self.counts.shape[1])))
        self.counts[0, at] += docs
        self.counts[1, at] += occurrences

    def full(self) -> bool:
        return len(self.place) > 2 * self.capacity

    def shrink(self) -> None:
        """Take from every count what the first one beyond the capacity has, and drop what is used up."""
        n = len(self.place)
        values = self.counts[1, :n]
        off = int(np.partition(values, n - self.capacity - 1)[n - self.capacity - 1])
        self.lost += off
        stays = values > off
        self.place = {t: i for i, t in enumerate(t for t, keep in zip(self.place, stays.tolist(), strict=True) if keep)}
        self.counts = np.maximum(0, self.counts[:, :n][:, stays] - off)

    def take(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(self.place)
        out = list(self.place), self.counts[0, :n], self.counts[1, :n]
        self.place, self.counts = {}, np.zeros((2, 1024), np.int64)
        return out


def _totals(term: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, term, times)
    return out


def term_counts(df: DataFrame, space: str, text: str, lossy: bool, capacity: int) -> DataFrame:
    """(term, df, cf) from one read; the row with a null term has in cf what a count may lack at most, in df the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = TermTable(capacity), 0

        def batch_of(terms: list, docs: Sequence, occurrences: Sequence) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(docs, pa.int64()), pa.array(occurrences, pa.int64())], ["term", "df", "cf"])

        for batch in batches:
            rows += batch.num_rows
            for part in _slices(batch):
                terms, _, term, times = slice_counts(part.column(0), space)
                table.add_many(terms, np.bincount(term, minlength=len(terms)), _totals(term, times, len(terms)))
                if table.full():
                    if lossy:
                        table.shrink()
                    else:
                        yield batch_of(*table.take())
        if lossy and len(table.place) > capacity:
            table.shrink()
        yield batch_of(*table.take())
        yield batch_of([None], [rows], [table.lost])

    partial = _cut(df, [space], text).mapInArrow(count, "term string, df bigint, cf bigint")
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


COUNTS = ["df", "cf"]


def _sums(partial: DataFrame, key: str) -> DataFrame:
    return partial.groupBy(key).agg(*(F.sum(c).alias(c) for c in COUNTS))


def word_counts(coded: DataFrame) -> DataFrame:
    """(term, df, cf) of every word; the row with a null term has in df the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in batches:
            names = batch.column("_names").flatten().dictionary_encode()
            counts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for _, words in _decoded(batch):
                rows += words.rows
                counts.append(_docs_and_occurrences(words.row, words.code, words.rows)[1:])  # every code comes, so they are by code
            totals = [_totals(names.indices.to_numpy(), np.concatenate(x), len(names.dictionary)) for x in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([names.dictionary, *map(pa.array, totals)], ["term", *COUNTS])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([rows]), pa.array([0])], ["term", *COUNTS])

    return _sums(coded.select(*CODED).mapInArrow(count, "term string, df bigint, cf bigint"), "term")


def _least(counted: DataFrame, most: int) -> int:
    """Occurrences of the ``most``-th term, or 1 where there are fewer: a rarer one is in no cut of so many.

    The driver gets the terms per number of occurrences: fewer numbers than the root of twice all occurrences.
    """
    alike = counted.groupBy("cf").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("cf", "descending")])
    at = int(np.searchsorted(np.cumsum(alike.column("n").to_numpy()), most))
    return alike.column("cf")[at].as_py() if at < len(alike) else 1


def _merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(pair, df, cf) of several slices, summed."""
    pair, docs, occurrences = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(pair, kind="stable")
    found, n = _equal(pair)
    at = np.cumsum(n) - n
    sums = [np.add.reduceat(x[order], at) if len(at) else x for x in (docs, occurrences)]
    return pa.RecordBatch.from_arrays([*map(pa.array, (found, *sums))], ["pair", *COUNTS])


def frequent_terms(coded: DataFrame, min_df: int, max_features: int, capacity: int) -> tuple[DataFrame | None, int]:
    """Exact (term, df, cf) of the words and pairs that may be in the cut, of texts from ``coded_texts``, and the number of texts.

    None where more than ``capacity`` words may be in it: so many are sent to the tasks at most.
    """
    words = stored(word_counts(coded), "terms")
    texts = words.filter("term is null").first().df
    words = words.filter((F.col("df") >= min_df) & F.col("term").isNotNull())
    least = _least(words, max_features)
    words = words.filter(F.col("cf") >= least)
    if words.count() > capacity:
        return None, texts
    sent = coded.sparkSession.sparkContext.broadcast(words.select("term").toArrow().column(0).combine_chunks())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = sent.value, [], 0
        for _, words in (x for batch in batches for x in _decoded(batch, known)):
            row, pair = _neighbours(words.row, words.places(known), len(known))
            held.append(_docs_and_occurrences(row, pair, words.rows))
            n += len(held[-1][0])
            if n > PAIRS:
                yield _merged(held)
                held, n = [], 0
        if held:
            yield _merged(held)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ends = [known.take(pa.array(at)) for at in np.divmod(batch.column(0).to_numpy(), max(1, len(known)))]
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*ends, " "), batch.column(1), batch.column(2)], ["term", *COUNTS])

    pairs = _sums(coded.select(*CODED).mapInArrow(count, "pair bigint, df bigint, cf bigint"), "pair")
    pairs = pairs.filter((F.col("df") >= min_df) & (F.col("cf") >= least))
    counted = stored(words.unionByName(pairs.mapInArrow(name, "term string, df bigint, cf bigint")), "terms")
    sent.destroy()
    return counted.filter(F.col("cf") >= _least(counted, max_features)), texts


def _ranked_terms(counted: DataFrame, min_df: int) -> DataFrame:
    """Terms of enough texts by falling frequency, then by term: (term, df, cf, place from 1)."""
    kept = counted.filter((F.col("df") >= min_df) & F.col("term").isNotNull()).withColumn("_rare", -F.col("cf"))
    return ranked(kept, ["_rare", "term"], name="place").drop("_rare")


@dataclass
class Space:
    """The vocabulary of one space, (term, df, cf, place), and the number of texts it was counted over."""

    terms: DataFrame
    texts: int


def fit_space(
    df: DataFrame, space: str, text: str = "prompt", min_df: int = 2, max_features: int | None = MAX_FEATURES, capacity: int = CAPACITY
) -> Space:
    """The most frequent terms; ties by term.  ``max_features`` None keeps all."""
    counted, texts = None, 0
    if space == "word" and max_features is not None:
        coded = df if _is_coded(df) else coded_texts(df.select(text), text)
        counted, texts = frequent_terms(coded, min_df, max_features, min(capacity, CAPACITY))
    if counted is None:
        counted, texts = _counted_terms(df, space, text, min_df, max_features, capacity)
    placed = _ranked_terms(counted, min_df)
    if max_features is not None:
        placed = placed.filter(F.col("place") <= max_features)
    return Space(stored(placed, "vocabulary"), texts)


def _counted_terms(df: DataFrame, space: str, text: str, min_df: int, max_features: int | None, capacity: int) -> tuple[DataFrame, int]:
    """Exact (term, df, cf) of all terms that may be in the cut, counted as strings, and the number of texts."""
    lossy = max_features is not None and max_features < capacity
    counted = stored(term_counts(df, space, text, lossy, capacity), "terms")
    totals = counted.filter("term is null").first()
    if totals.cf and lossy:
        exact = _verified(df, space, text, counted, totals.cf, min_df, max_features, capacity)
        counted = exact if exact is not None else stored(term_counts(df, space, text, False, capacity), "terms")
    return counted, totals.df


def _verified(
    df: DataFrame, space: str, text: str, counted: DataFrame, lost: int, min_df: int, max_features: int, capacity: int
) -> DataFrame | None:
    """Exact counts of every term that may be in the cut, or None where the summary can't tell."""
    last = _ranked_terms(counted, min_df).filter(F.col("place") == max_features).first()
    if last is None or last.cf <= lost:
        return None
    candidates = counted.filter(F.col("term").isNotNull() & (F.col("cf") + lost >= last.cf)).select("term")
    names = [r.term for r in candidates.limit(2 * capacity + 1).toLocalIterator()]  # the bound of what tasks are sent
    if len(names) > 2 * capacity:
        return None
    sent = df.sparkSession.sparkContext.broadcast(pa.array(names, pa.string()))
    del names

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(sent.value.to_pylist())}
        docs, occurrences = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for batch in batches:
            for part in _slices(batch):
                terms, _, term, times = slice_counts(part.column(0), space)
                at = _places(terms, place)[term]
                known = at >= 0
                docs += np.bincount(at[known], minlength=len(docs))
                np.add.at(occurrences, at[known], times[known])
        seen = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([sent.value.take(pa.array(seen)), pa.array(docs[seen]), pa.array(occurrences[seen])], ["term", "df", "cf"])

    partial = _cut(df, [space], text).mapInArrow(count, "term string, df bigint, cf bigint")
    exact = stored(partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), "candidates")
    sent.destroy()
    return exact


def idf(texts: int, df: str = "df") -> Column:
    """Smoothed inverse document frequency."""
    return F.log((F.lit(1.0) + F.lit(float(texts))) / (F.lit(1.0) + F.col(df))) + 1.0


@dataclass
class WordPlaces:
    """Words, the idx of each (-1: none of its own), and the idx of pairs of them, by rising number of the pair."""

    words: pa.Array
    single: np.ndarray
    pairs: np.ndarray
    pair_idx: np.ndarray

    @staticmethod
    def of(terms: pa.Array, idx: np.ndarray) -> "WordPlaces":
        cut = Words.of(pc.split_pattern(terms, " "))
        row, code, words = cut.row, cut.code, cut.names
        first = np.searchsorted(row, np.arange(len(terms)))
        alone = np.bincount(row, minlength=len(terms)) == 1
        single = np.full(len(words) + 1, -1)  # the last one is for unknown words, whose place is -1
        single[code[first[alone]]] = idx[alone]
        pair = code[first[~alone]] * len(words) + code[first[~alone] + 1]
        order = np.argsort(pair)
        return WordPlaces(words, single, pair[order], idx[~alone][order])

    def find(self, texts: Words) -> tuple[np.ndarray, np.ndarray]:
        """Row and idx of every known word and pair of some texts."""
        row, word = texts.row, texts.places(self.words)
        at = self.single[word]
        one = at >= 0
        if not len(self.pairs):
            return row[one], at[one]
        pair_row, pair = _neighbours(row, word, len(self.words))
        pair, pair_row = np.divmod(np.sort(pair * texts.rows + pair_row), max(1, texts.rows))  # in order they are found faster
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        hit = self.pairs[place] == pair
        return np.concatenate([row[one], pair_row[hit]]), np.concatenate([at[one], self.pair_idx[place[hit]]])


def _tallied(cut: Words | pa.ListArray, place: WordPlaces | dict[str, int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, occurrences) of the known words and pairs, or windows, of some texts, by row and idx."""
    if isinstance(cut, Words):
        row, idx = place.find(cut)
        cell, times = _equal(row * size + idx)
        return *np.divmod(cell, max(1, size)), times
    terms, row, term, times = _window_entries(cut)
    idx = _places(terms.to_pylist(), place)[term]
    known = idx >= 0
    return _summed(row[known], idx[known], times[known], size)


def _weights(cut: Words | pa.ListArray, place: WordPlaces | dict[str, int], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, weight) of the known terms of some texts, unit length per text."""
    row, idx, times = _tallied(cut, place, len(known))
    weight = (1.0 + np.log(times)) * known[idx]
    return row, idx, weight / np.sqrt(np.bincount(row, weight * weight))[row]


def _fields(df: DataFrame) -> list[T.StructField]:
    """The columns of texts, also of coded ones."""
    return (df.schema["_rows"].dataType.elementType if _is_coded(df) else df.schema).fields


@dataclass
class Vectoriser:
    """Vocabulary and idf of training texts, for any texts; a vocabulary of words also for ``coded_texts``.

    ``terms`` has (space, term, idf, idx); ``idx`` numbers the terms of all spaces from 0 to ``size``.
    Terms that the training texts lack have no weight.  The terms travel to the tasks: ``max_features`` of
    each space bounds them, and a task holds them once.
    """

    terms: DataFrame
    size: int

    def _weighed(self, df: DataFrame, keys: Sequence[str], text: str, shape: Callable, schema: T.StructType | str, entries_of: Callable | None = None) -> DataFrame:
        """Rows that ``shape`` makes of a few texts, their terms' (row, idx, weight), or what ``entries_of`` gives, by row and idx, and the vocabulary."""
        table = self.terms.select("space", "term", "idx", "idf").orderBy("idx").toArrow()
        spaces = sorted(set(table.column("space").unique().to_pylist()))
        coded = _is_coded(df)
        sent = df.sparkSession.sparkContext.broadcast(table.combine_chunks())

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = sent.value
            idx = found.column("idx").to_numpy()
            known = np.zeros(int(idx.max(initial=-1)) + 1)
            known[idx] = found.column("idf").to_numpy()
            place: dict[str, WordPlaces | dict[str, int]] = {}
            for s in spaces:
                own = found.filter(pc.equal(found.column("space"), s))
                terms, at = own.column("term").combine_chunks(), own.column("idx").to_numpy()
                place[s] = WordPlaces.of(terms, at) if s == "word" else dict(zip(terms.to_pylist(), at.tolist(), strict=True))
            for part, cuts in (x for batch in batches for x in runs(batch, place)):
                entries = [(entries_of or _weights)(cuts[s], place[s], known) for s in spaces] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                row, at, weight = (np.concatenate(x) for x in zip(*entries, strict=True))
                order = np.lexsort((at, row)) if len(spaces) > 1 else slice(None)
                yield from shape(part, row[order], at[order], weight[order], found)

        def runs(batch: pa.RecordBatch, place: dict) -> Iterator[tuple[pa.RecordBatch, dict[str, Words | pa.ListArray]]]:
            if coded:
                yield from ((part, {"word": words}) for part, words in _decoded(batch, place["word"].words if "word" in place else None))
                return
            for part in _slices(batch, WORD_SLICE if spaces == ["word"] else SLICE):
                cuts = {s: part.column(f"_cut_{s}") for s in spaces}
                yield part, {s: Words.of(c) if s == "word" else c for s, c in cuts.items()}

        return (df.select("_rows", *CODED) if coded else _cut(df, spaces, text, keys)).mapInArrow(weigh, schema)

    def arrays(self, df: DataFrame, text: str = "prompt") -> DataFrame:
        """The rows with ``idx`` and ``weight`` (arrays) instead of the text: sublinear tf, idf, unit length per text and space."""
        fields = [f for f in _fields(df) if f.name != text]
        keys = [f.name for f in fields]
        schema = T.StructType(fields).add("idx", T.ArrayType(T.IntegerType())).add("weight", T.ArrayType(T.DoubleType()))

        def shape(part: pa.RecordBatch, row: np.ndarray, idx: np.ndarray, weight: np.ndarray, found: pa.Table) -> Iterator[pa.RecordBatch]:
            bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(idx.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(weight))]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *lists], [*keys, "idx", "weight"])

        return self._weighed(df, keys, text, shape, schema)

    def blocks(self, df: DataFrame, text: str = "prompt") -> DataFrame:
        """The weights of labelled texts (``label``, ``row_weight``) as ``blocks``, made in the task that weighs them."""

        held: list[np.ndarray] = []  # of a task: space and idf by idx, and the number of spaces

        def shape(part: pa.RecordBatch, row: np.ndarray, idx: np.ndarray, times: np.ndarray, found: pa.Table) -> Iterator[pa.RecordBatch]:
            if not held:
                at, of = found.column("idx").to_numpy(), found.column("space").combine_chunks().dictionary_encode()
                space, known = np.zeros(int(at.max(initial=-1)) + 1, np.int64), np.zeros(int(at.max(initial=-1)) + 1)
                space[at], known[at] = of.indices.to_numpy(), found.column("idf").to_numpy()
                held.extend((space, known, max(1, len(of.dictionary))))
            space, known, spaces = held
            own, value = row * spaces + space[idx], 1.0 + np.log(times)
            length = np.sqrt(np.bincount(own, (value * known[idx]) ** 2, part.num_rows * spaces))
            size = np.bincount(own, minlength=part.num_rows * spaces)
            yield block(size, idx, value, part.column("label"), part.column("row_weight"), known, 1.0 / np.where(size > 0, length, 1.0))

        return self._weighed(df, ["label", "row_weight"], text, shape, BLOCK_SCHEMA, lambda cut, place, known: _tallied(cut, place, len(known)))

    def transform(
        self, df: DataFrame, id_col: str = "sample_id", text: str = "prompt", columns: Sequence[str] = ("space", "term", "idx", "weight")
    ) -> DataFrame:
        """(id, space, term, idx, weight), or the id and some of these: a row per text and known term; texts without one have no row."""
        kinds = {"space": T.StringType(), "term": T.StringType(), "idx": T.IntegerType(), "weight": T.DoubleType()}
        schema = T.StructType([*(f for f in _fields(df) if f.name == id_col), *(T.StructField(c, kinds[c]) for c in columns)])

        def shape(part: pa.RecordBatch, row: np.ndarray, idx: np.ndarray, weight: np.ndarray, found: pa.Table) -> Iterator[pa.RecordBatch]:
            numbers = found.column("idx").to_numpy()
            place = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
            place[numbers] = np.arange(len(numbers))
            names = {c: found.column(c).combine_chunks() for c in columns if c in ("space", "term")}
            for low in range(0, len(row), ENTRIES):
                cut = slice(low, low + ENTRIES)
                at = pa.array(place[idx[cut]])
                made = {c: names[c].take(at) for c in names} | {"idx": pa.array(idx[cut].astype(np.int32)), "weight": pa.array(weight[cut])}
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(row[cut])), *(made[c] for c in columns)], [id_col, *columns])

        return self._weighed(df, [id_col], text, shape, schema)

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Vectoriser":
        terms = spark.read.parquet(path)
        return Vectoriser(terms, terms.count())


def fit_vectoriser(
    train: DataFrame,
    spaces: Sequence[str] = SPACES,
    text: str = "prompt",
    min_df: int = 2,
    max_features: int | None = MAX_FEATURES,
    capacity: int = CAPACITY,
) -> Vectoriser:
    """Vocabulary (at most ``max_features`` terms a space) and idf of training texts, written once."""
    terms, size = None, 0
    for space in spaces:
        fitted = fit_space(train, space, text, min_df, max_features, capacity)
        part = stored(
            fitted.terms.select(F.lit(space).alias("space"), "term", "df", "cf", idf(fitted.texts).alias("idf"), (F.col("place") - 1 + size).cast("int").alias("idx")),
            "vocabulary",
        )
        size += part.count()
        terms = part if terms is None else terms.unionByName(part)
    return Vectoriser(terms, size)


def fit_tfidf(
    df: DataFrame, analyzer: str = "word", id_col: str = "sample_id", text: str = "prompt", min_df: int = 2, max_features: int | None = MAX_FEATURES
) -> DataFrame:
    """(id, term, weight) of a corpus under its own vocabulary."""
    texts = df.select(id_col, text)
    if analyzer == "word" and max_features is not None:
        texts = coded_texts(texts, text)
    return fit_vectoriser(texts, [analyzer], text, min_df, max_features).transform(texts, id_col, text, ["term", "weight"])


def concat_features(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack weight tables into one feature space; ``space`` keeps equal terms apart."""
    stacked = None
    for name, part in parts.items():
        tagged = part.withColumn("space", F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return stacked


def linear_score(rows: DataFrame, coefficients: np.ndarray, intercept: float, out: str = "router_score") -> DataFrame:
    """Rows with ``idx`` and ``weight`` arrays, scored by a logistic model inside the row; no known term counts 0.

    The weights stay in the engine, so a task that has made them in Python needs no second worker for their scores.
    """
    sent = rows.sparkSession.createDataFrame(pa.table({"coefficients": pa.array([coefficients.astype(float)])}))
    known = rows.select("*", sent.scalar().alias("_coefficients"))
    products = F.zip_with("idx", "weight", lambda i, w: w * F.get("_coefficients", i))
    margin = F.coalesce(F.aggregate(products, F.lit(0.0), lambda total, x: total + x), F.lit(0.0)) + F.lit(float(intercept))
    return known.select(*rows.columns, (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias(out))


#: Weights of some rows as numbers end to end.  A weight is value x factor of its idx x scale of its part of a row: entries per
#: part, the distinct idx and their factors, the place of each entry's idx in these, the distinct values, the place of each
#: entry's value in those (``_value``, of as few bytes as that takes), scales, and label and weight of the rows, whose total is beside them.
BLOCK = {"_size": np.int32, "_idx": np.int32, "_factor": np.float64, "_place": np.int32, "_values": np.float64, "_value": None, "_scale": np.float64, "_label": np.float64, "_row_weight": np.float64}
BLOCK_SCHEMA = ", ".join(f"{c} binary" for c in BLOCK) + ", _total double"


def block(size: np.ndarray, idx: np.ndarray, value: np.ndarray, label: pa.Array, row_weight: pa.Array, known: np.ndarray | None = None, scale: np.ndarray | None = None) -> pa.RecordBatch:
    """One row of ``BLOCK_SCHEMA``; ``known`` has the factors by idx.  Rows have equally many parts."""
    used = np.zeros(int(idx.max(initial=-1)) + 1, bool)
    used[idx] = True
    distinct, own = np.flatnonzero(used), row_weight.to_numpy(zero_copy_only=False)
    factor, scale = np.ones(len(distinct)) if known is None else known[distinct], np.ones(len(size)) if scale is None else scale
    coded = pa.array(value, pa.float64()).dictionary_encode()
    values, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    parts = (size, distinct, factor, (np.cumsum(used) - 1)[idx], values, place, scale, label.to_numpy(zero_copy_only=False), own)
    kinds = [kind or np.min_scalar_type(max(1, len(values) - 1)) for kind in BLOCK.values()]
    data = [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(parts, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*data, pa.array([float(own.sum())])], [*BLOCK, "_total"])


def is_blocks(rows: DataFrame) -> bool:
    return BLOCK.keys() <= set(rows.columns)


def blocks(rows: DataFrame) -> DataFrame:
    """Rows with ``idx``, ``weight``, ``label`` and ``row_weight`` in blocks of about ``ENTRIES`` weights."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (run for whole in batches for run in row_runs(whole)):
            idx, weight, row = flat_rows(batch)
            yield block(np.bincount(row, minlength=batch.num_rows), idx, weight, batch.column("label"), batch.column("row_weight"))

    return rows.select("idx", "weight", "label", "row_weight").mapInArrow(pack, BLOCK_SCHEMA)


def unpacked(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    """Of each block: entries per part, idx, factors, places, values of the entries, scales, labels and weights of the rows."""
    for i in range(batch.num_rows):
        data = {c: batch.column(c)[i].as_buffer() for c in BLOCK}
        size, idx, factor, place, values, _, scale, y, w = (np.frombuffer(data[c], kind or np.uint8) for c, kind in BLOCK.items())
        at = np.frombuffer(data["_value"], f"u{max(1, data['_value'].size // max(1, len(place)))}")
        yield [size, idx, factor, place, values[at], scale, y, w]


def row_runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with ``idx`` in runs of about ``ENTRIES`` weights, one row at least."""
    return _runs(batch, np.diff(batch.column("idx").offsets.to_numpy()).astype(np.int64), ENTRIES)


def flat_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and values end to end, and the row of each."""
    idx, weight = batch.column("idx"), batch.column("weight")
    sizes = np.diff(idx.offsets.to_numpy())
    return idx.flatten().to_numpy(), weight.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def benign_lexicon(coefficients: DataFrame, n: int = 120, blocked: Sequence[str] = tuple(lx.BLOCKED_TERMS)) -> DataFrame:
    """Most negative-weight readable terms: the lexicon of the density gate."""
    term = F.col("term")
    blocked_hit = F.lit(False)
    for b in blocked:
        blocked_hit = blocked_hit | term.contains(b)
    readable = (F.length(term) >= 3) & ~term.rlike(r"[^\p{L}\p{N}\s]")
    return coefficients.filter(readable & ~blocked_hit).orderBy("coefficient", "term").limit(n)
