from __future__ import annotations

import random

import pyarrow as pa
import pytest

from sensorloom.llm import tokens

P = pytest.importorskip("public_tokenizers")
PARTS = ["the", "of", "Thtion,", "a", "é", "ß", "'s", "don't", " ", "  ", "   ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", "12", "3.4", "$$$", "<|endoftext|>", "x" * 300, "日本", "é", "Σ", " "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_the_whole_text(name):
    rng = random.Random(4)
    coder = tokens.ChunkEncoder(P.path(name))
    texts = ["", None, " ", "a  ", "  a", "a \n b", "a\n  b"] + ["".join(rng.choice(PARTS) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    got = coder.encode(pa.array(texts))
    for lo in (1, 100):
        part = coder.encode(pa.array(texts).slice(lo, 300))
        assert [x.tolist() for x in part] == [x.tolist() for x in got[lo : lo + 300]]
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_store_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "STORE_PIECES", 5)
    coder = tokens.ChunkEncoder(P.path("byte_bpe_50k.json"))
    for text in ("a b c d", "e f g h i j k", "a b e f"):
        assert coder.encode(pa.array([text]))[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_no_rows():
    assert tokens.ChunkEncoder(P.path("byte_bpe_50k.json")).encode(pa.array([], pa.string())) == []


def test_a_small_store_and_small_slices():
    """The store keeps its size, and the ids stay those of a large one."""
    path = P.path("byte_bpe_50k.json")
    texts = [" ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[k % 10]}{'uvwxyzabcd'[i // 10]}q" for k in range(i % 23)) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    flat = lambda **sizes: [ids.tolist() for _, coded in tokens.encoded([batch], path, 2, **sizes) for ids in coded]
    assert flat(together=200, store=50) == flat()
    assert len(tokens.encoder(path, 50).at) <= 150
    assert len(tokens.encoder(path).at) > 400
