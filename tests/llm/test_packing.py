import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_tables import docs_table, messy_rows, words
from postmill.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


def check(rows, pieces, window):
    """Every document is its pieces, every sequence gapless; returns lengths of sequences."""
    own = reference()
    want = sorted([*own.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in rows)
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u4").tolist()
        assert len(ids) == p.length > 0
        docs[p.doc_id].append((p.start, ids, p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, len(ids)))
    for own_pieces in sequences.values():
        at = 0
        for offset, n in sorted(own_pieces):
            assert offset == at
            at += n
        assert at <= window
    # Rows with one id are told apart by following starts, where their texts are equal.
    got = []
    for own_pieces in docs.values():
        own_pieces.sort(key=lambda p: (p[2], p[0], p[1]))
        open_ = []
        for start, ids, total in own_pieces:
            fits = [d for d in open_ if len(d[0]) == start and d[1] == total and start]
            if fits:
                fits[0][0].extend(ids)
            else:
                assert start == 0
                open_.append((list(ids), total))
        for ids, total in open_:
            assert len(ids) == total
            got.append(ids)
    assert sorted(got) == want
    return [sum(n for _, n in s) for s in sequences.values()]


@pytest.mark.parametrize("window, most, bucket", [(2048, 256, 1 << 22), (64, 4, 500), (16, 1, 40)])
def test_every_id_lies_in_one_piece(messy, window, most, bucket):
    got = packing.pack(messy, PATH, window, most, bucket_tokens=bucket)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    check(messy_rows(), got.collect(), window)


def test_little_padding(spark):
    draw = random.Random(7)
    rows = [(i, words(draw, draw.randrange(1, 400)), "en", "a") for i in range(1500)]
    lengths = check(rows, packing.pack(docs_table(spark, rows).repartition(6), PATH).collect(), 2048)
    assert sum(lengths) / (2048 * len(lengths)) > 0.98


def test_empty(empty):
    assert packing.pack(empty, PATH).collect() == []


def test_ids_are_those_of_the_library():
    own, quick = reference(), packing.load_vocabulary(PATH)
    draw = random.Random(2)
    texts = ["", " ", "\n\n  \t x", "<|endoftext|> a", "I'll don't 's 12345 ½ ²", "x" * 3000, " " * 3000, "日本語 🙂👍🏽 ‍﻿"]
    texts += ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(160, 0x3000), draw.randrange(0x10000, 0x20000)]))
                      for _ in range(60)) for _ in range(300)]
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)}b  {chr(c)}." for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert [quick.encode_ordinary(t) for t in texts] == want


def test_best_fit_and_fullest():
    windows = packing.OpenWindows(10, 2)
    piece = lambda n: (0, 0, np.arange(n, dtype="<u4"), n)
    assert windows.place(piece(6), 6) == [] and windows.place(piece(7), 7) == []
    assert [n for n, _ in windows.place(piece(3), 3)] == [1]  # into the room of 3, which is full then
    assert windows.place(piece(5), 5) == []                   # a new window; 6 and 5 are held
    assert [n for n, _ in windows.place(piece(9), 9)] == [0]  # none fits: the one with 6 goes
    assert sorted(windows.rooms) == [(1, 3), (5, 2)]
