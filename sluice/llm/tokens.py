"""Token ids of whole texts by a byte-level BPE tokenizer, many texts at once.

The tokenizer's pattern starts a new piece at every space between two other characters, so a text is cut
there, and only the distinct parts of a slice of texts are encoded.  Parts are laid end to end: a token
that begins with a space begins a part.

The file is read with ``tokenizers``.  Where every entry of its vocabulary encodes to itself and follows
the entries it is merged from, the order of the vocabulary alone fixes every merge; ``tiktoken`` then
merges by that order, several times faster.  (Take two neighbours whose concatenation is an entry with
another listed merge.  Alone, they would come out as that entry by its own merge, so before it they were
its two listed halves, and not these.)  Other files, parts with white space at an end and parts with long
runs of it go through ``tokenizers``.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "Ġ"
BLANK = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\p{Z}]"
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
LONG_BLANK = re.compile(r"\s{64}")

#: Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A tokenizer file, loaded where it is used: once per task; ``by_rank`` is what another load has found."""

    def __init__(self, path: str, by_rank: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        every = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(every.values()) + 1, bool)
        self.begins[[i for token, i in every.items() if token.startswith(SPACE)]] = True
        by_rank = self.fixed_by_order() if by_rank is None else by_rank
        self.ranked = self._merger() if by_rank else None

    def fixed_by_order(self) -> bool:
        """Whether the order of the vocabulary alone fixes the merges."""
        import json

        told = json.loads(self.tokenizer.to_str())
        model, cutter = told["model"], told.get("pre_tokenizer") or {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(o) for o in options) or told.get("normalizer"):
            return False
        if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            return False
        byte = byte_of()
        if not all(c in byte for token in vocab for c in token):
            return False
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rising = all(max(vocab[a], vocab[b]) < vocab[a + b] for a, b in merges)
        ordered = [vocab[a + b] for a, b in merges]
        alone = all([t.id for t in self.tokenizer.model.tokenize(v)] == [i] for v, i in vocab.items())
        return rising and ordered == sorted(ordered) and alone

    def _merger(self):
        """A merger by the order of the vocabulary."""
        import tiktoken

        byte, vocab = byte_of(), self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        sizes = np.array([len(ids) for ids in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts with a space before each, and how many each has."""
        plain = np.array([bool(p) and not p[0].isspace() and not p[-1].isspace() and not (len(p) > 64 and LONG_BLANK.search(p)) for p in parts], bool)
        joined = [p for p, ok in zip(parts, plain, strict=True) if ok]
        ids = np.zeros(0, np.uint32)
        if joined and self.ranked:
            ids = self.ranked.encode_to_numpy(" " + " ".join(joined), allowed_special="all")
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(joined):  # no merger by rank, or a part holds a token that begins with a space
            plain[:] = False
            ids, starts = ids[:0], starts[:0]
        others, sizes = self.each([" " + p for p, ok in zip(parts, plain, strict=True) if not ok])
        low, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        low[plain], size[plain] = starts, np.diff(np.append(starts, len(ids)))
        low[~plain], size[~plain] = len(ids) + np.cumsum(sizes) - sizes, sizes
        return np.concatenate((ids, others))[gather(low, size)], size


def gather(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places low[i] .. low[i] + size[i] - 1 for each i, end to end."""
    ends = np.cumsum(size)
    return np.repeat(low - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def token_ids(texts: pa.Array, known: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, and the bounds of each text's ids; a null has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    runs = pc.match_substring_regex(texts, f"{BLANK} ({BLANK}|$)").to_numpy(zero_copy_only=False)
    kind = pa.large_list(pa.large_string())
    if runs.any():  # white space of several characters: cut only where no run is touched
        cut = pa.array([BETWEEN.split(t) if odd else t.split(" ") for t, odd in zip(texts.to_pylist(), runs, strict=True)], kind)
    else:
        cut = pc.split_pattern(texts, " ").cast(kind)
    bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    first = np.zeros(int(bounds[-1]), bool)
    first[bounds[:-1]] = True
    all_parts, shift, pools = cut.flatten(), 0, []
    low, size = np.zeros(len(all_parts), np.int64), np.zeros(len(all_parts), np.int64)
    for where, encode in ((first, known.each), (~first, known.parts)):
        coded = all_parts.filter(pa.array(where)).dictionary_encode()
        ids, sizes = encode(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        low[where], size[where] = (np.cumsum(sizes) - sizes)[at] + shift, sizes[at]
        pools.append(ids)
        shift += len(ids)
    ends = np.concatenate(([0], np.cumsum(size)))
    return np.concatenate(pools)[gather(low, size)], ends[bounds]
