import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import range_coder
from tidemark.llm.common import new_folder
from tidemark.llm.shards import pack, read_shards, unpack, write_shards
from tidemark.llm.tokens import WordMemo

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, id string, n int, ids string"


@pytest.mark.parametrize("path, keeps", [(BYTE, True), (WORD, False)])
def test_memo_equals_whole_texts(path, keeps):
    r, m = random.Random(1), WordMemo(path, keeps)
    alphabet = "aB 9.\n\t '  s<>|é漢 ̀ǅİΣ!\x1c\x85　z's "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 18))) for _ in range(6000)]
    texts += [" ".join(r.choice(["word", "don't", "x\ny", "<|endoftext|>", "", "Ünï", "12,5", "<|startoftext|>"]) for _ in range(12)) for _ in range(500)]
    want = m.direct(texts)
    assert [m.encode(t) for t in texts] == want
    assert m.encode_all(texts) == want and WordMemo(path, keeps).encode_all(texts) == want


@pytest.mark.parametrize("path, keeps", [(BYTE, True), (WORD, False)])
def test_letters_marks_and_lines_are_put_together(path, keeps):
    r, m = random.Random(2), WordMemo(path, keeps)
    words = ["".join(r.choice("abcÀéßüñµªºöÿĀ") for _ in range(r.randint(1, 9))).title() for _ in range(300)] + ["it's", "x_", "R2"]
    marks = ["", "", ".", "$$$", ".%%%", "--", "_", "()", "'", "',", '"', "\u00a0", "\x85", "…", "!" * 12]
    between = [" ", " ", " ", "\n", "\n\n", " \n", "\n ", "  ", "\t"]
    texts = ["".join(r.choice(words) + r.choice(marks) + r.choice(between) for _ in range(40)) for _ in range(400)]
    assert m.encode_all(texts) == m.direct(texts) and [m.encode(t) for t in texts] == m.direct(texts)
    seen = []
    m.direct = lambda some: seen.extend(some) or [b""] * len(some)
    m._learn(["Novelword$$$", "anotherword.\nThirdword,"])
    assert "anotherword" not in " ".join(seen) or not keeps  # only its marks take the long way


def test_coder_round_trip():
    r = np.random.default_rng(1)
    for ids in (r.integers(0, 65536, 3000), np.zeros(5000, int), r.zipf(1.3, 9000) % 50257, np.tile(r.integers(0, 50257, 97), 60), np.array([7]), np.full(300, 65535)):
        for block in (1, 64, 1000):
            part = ids[:200] if block == 1 else ids
            blocks = range_coder.encode_blocks(part, block)
            assert (range_coder.decode_blocks(blocks) == part).all()
            if len(blocks) > 1:  # each block alone
                assert (range_coder.decode_blocks(blocks[1:2]) == part[block : 2 * block]).all()
    assert len(range_coder.decode_blocks(range_coder.encode_blocks(np.empty(0, int)))) == 0


def test_coder_compresses():
    ids = np.tile(np.random.default_rng(1).integers(0, 50257, 200), 20)
    assert sum(len(p) for *_, p in range_coder.encode_blocks(ids, 4000)) < 0.25 * 2 * len(ids)


def test_unconfirmed_contexts_take_no_decision(monkeypatch):
    asked, plain = [], range_coder._Out.bit
    monkeypatch.setattr(range_coder._Out, "bit", lambda self, on, *x: asked.append(len(on)) or plain(self, on, *x))
    ids = np.arange(4000) % 1000 + np.arange(4000) // 1000 * 1000  # no id, so no context, comes twice
    blocks = range_coder.encode_blocks(ids, 4000)
    assert (range_coder.decode_blocks(blocks) == ids).all() and sum(asked) < 10
    ids = np.tile(np.arange(100), 40)
    assert (range_coder.decode_blocks(range_coder.encode_blocks(ids, 4000)) == ids).all() and sum(asked) > 3000


def test_damage_is_seen():
    ids = np.arange(4000) % 777
    data = bytearray(pack([1, None], [1000, 3000], ids))
    assert unpack(bytes(data))[0] == [1, None]
    for at in (10, 70, len(data) - 300):
        bad = bytearray(data)
        bad[at] ^= 0x41
        with pytest.raises(Exception):
            unpack(bytes(bad))


def test_documents(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "été", "#", "x" * 50]) for _ in range(r.randint(0, 300)))) for i in range(200)]
    rows += [(900, None), (901, ""), (None, "no id"), (17, "again"), (902, "long text " * 30000)]
    r.shuffle(rows)
    folder = new_folder(spark, "ids")
    shards = write_shards(spark.createDataFrame([(*x, "s", 1, "t") for x in rows], SCHEMA), folder, BYTE)
    got = read_shards(shards, folder).collect()
    lib = Tokenizer.from_file(BYTE)
    want = {}
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.setdefault(i, []).append((len(ids) // 4, zlib.crc32(ids), ids))
    have, at = {}, 0
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == at
        at += g.n_tokens
        have.setdefault(g.doc_id, []).append((g.n_tokens, g.ids_crc32, bytes(g.ids)))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    order = [g.doc_id for g in sorted(got, key=lambda g: g.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_empty(spark):
    folder = new_folder(spark, "ids")
    assert read_shards(write_shards(spark.createDataFrame([], SCHEMA), folder, BYTE), folder).count() == 0


def test_large_ids_are_refused():
    with pytest.raises(ValueError):
        range_coder.encode_blocks(np.array([1, 65536], "<u4"))


def test_lanes_take_little_memory():
    ids = np.random.default_rng(2).zipf(1.3, 256 * 256) % 50257
    tracemalloc.start()
    try:
        blocks = range_coder.encode_blocks(ids, 256)
        assert (range_coder.decode_blocks(blocks) == ids).all()
        assert tracemalloc.get_traced_memory()[1] < 20e6  # 256 lanes; 148 KB of order 0 in each would be 38 MB
    finally:
        tracemalloc.stop()
