"""Packing and token ids against the tokenizer itself: every id in exactly one piece, no padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sluice.llm import packing
from sluice.llm.queries import tokenizer_path
from sluice.llm.tokens import Encoder, token_ids


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(5)
    parts = ["a", " ", "  ", "\n", " ", " word", "'s", "<|endoftext|>", "é", "99", ".", "\x85", "\x1c", "B", " c", "　", " " * 70, "\n" * 300]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(5000)] + [None, "", "x" * 5000, " " * 2000, "\n" * 2000 + " a"]
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{chr(c)}1 {chr(c)}" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    ids, bounds = token_ids(pa.array(texts), Encoder(tokenizer_path()))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text
    assert Encoder(tokenizer_path()).ranked is not None


def test_other_tokenizers_go_the_plain_way():
    path = tokenizer_path("word_bpe_49k.json")
    assert Encoder(path).ranked is None


def check(rows, texts, tokenizer, length):
    """``texts``: (key, text) in any order; rows with ids."""
    wanted = defaultdict(int)
    for key, text in texts:
        wanted[key, tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])] += 1
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id, r.doc_tokens, r.start].append(np.frombuffer(r.ids, "<u4").tolist())
    for places in sequences.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at == length or at < length and at & (at - 1) == 0
    got = sum(len(ids) for group in parts.values() for ids in group)
    assert got == sum(len(ids) * n for (_, ids), n in wanted.items())
    return wanted, parts, sequences


@pytest.mark.parametrize("length, windows, fan_in", [(2048, 64, 64), (64, 3, 2), (1, 1, 2)])
def test_every_id_lies_in_one_piece(spark, tokenizer, monkeypatch, length, windows, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma  ", "\n"]) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, "long " * 9000), (None, "null id")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = packing.SequencePacker(tokenizer_path(), length, windows=windows).pack(docs, keep_ids=True).collect()
    wanted, parts, _ = check(rows, texts, tokenizer, length)
    for (key, ids), n in wanted.items():
        assert n == 1
        own = sorted((start, piece) for (k, _, start), group in parts.items() if k == key for piece in group)
        assert [x for _, piece in own for x in piece] == list(ids)
        assert [start for start, _ in own] == [sum(len(p) for _, p in own[:i]) for i in range(len(own))]


def test_repeats_other_keys_and_empty_tables(spark, tokenizer):
    packer = packing.SequencePacker(tokenizer_path())
    texts = [("x", "same text")] * 5 + [(None, None)] * 2
    docs = spark.createDataFrame([(k, t, 1, "s", b"i") for k, t in texts], "doc_id string, text string, start int, sequence_id string, ids binary")
    rows = packer.pack(docs, keep_ids=True).collect()
    check(rows, texts, tokenizer, 2048)
    none = packer.pack(docs.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_full_sequences_and_reruns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packer = packing.SequencePacker(tokenizer_path())
    one, two = (sorted(map(tuple, packer.pack(docs).collect()), key=str) for _ in range(2))
    assert one == two
    sizes = defaultdict(int)
    for row in one:
        sizes[row[5]] += row[2]
    assert sum(s < 2048 for s in sizes.values()) <= 11 and all(s & (s - 1) == 0 for s in sizes.values())
