from __future__ import annotations

import random

import numpy as np
import pytest

from sensorloom.llm import tokenbin
from sensorloom.plans.staging import new_path

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_round_trip(mode):
    rng = random.Random(1)
    for high in (0, 1, 255, 256, 49_407, 2**32 - 1):
        for n in (1, 7, 8, 100):
            ids = np.array([rng.randint(0, high) for _ in range(n)], np.uint32)
            assert tokenbin.ids_of(tokenbin.planes_of(ids, mode), n, mode).tolist() == ids.tolist()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_store_round_trip(spark, docs, mode):
    from tokenizers import Tokenizer

    texts = [f"Word{i} the of {i}" * (i % 5) for i in range(60)] + [None, "", "x y " * 2000, (7, "twice"), (None, "no id")]
    path, folder = P.path("word_bpe_49k.json"), new_path(spark, "tokens")
    tokenbin.write_store(docs(texts, "extra"), folder, path, 1, mode, block_ids=16, chunk_ids=100)
    rows = tokenbin.read_store(spark, folder).collect()
    coder = Tokenizer.from_file(path)
    rows = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(len(rows))]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)
    want = sorted((i, [*coder.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in ((-1 if t[0] is None else t[0], t[1]) if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)))
    assert sorted((i, np.frombuffer(r["ids"], "<u4").tolist()) for i, r in zip(ids, rows, strict=True)) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in rows)
    some = tokenbin.read_store(spark, folder, 10, 19)
    assert sorted(r["doc_id"] for r in some.collect()) == list(range(10, 20))


def test_no_rows(spark, docs):
    folder = new_path(spark, "tokens")
    tokenbin.write_store(docs([]), folder, P.path("word_bpe_49k.json"), 1)
    assert tokenbin.read_store(spark, folder).count() == 0
    with pytest.raises(ValueError):
        tokenbin.write_store(docs([]), folder, P.path("word_bpe_49k.json"), 1, "nibble")
