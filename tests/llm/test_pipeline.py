"""The pipeline on a small corpus, stage by stage against what each must do."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline

pytest.importorskip("public_tokenizers")


def prose(rng, n):
    return " ".join("".join(rng.choice(["tha", "er", "on", "ti", "re", "an", "sh"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture
def folder(spark, docs, tmp_path):
    rng = random.Random(5)
    clean = ["\n".join(prose(rng, 30) for _ in range(4)) for _ in range(12)]
    item = prose(rng, 30)
    passage = prose(rng, 55)
    words = clean[0].split()
    texts = {
        **dict(enumerate(clean)), 20: "too short", 21: "spam ham eggs " * 60, 22: clean[1].replace(" ", "$$$ "), 23: clean[2],
        24: f"{prose(rng, 60)}\n{passage}\n{prose(rng, 20)}", 25: f"{prose(rng, 60)}\n{passage}\n{prose(rng, 20)}",
        26: " ".join(words[:50] + ["new"] + words[51:]), 27: f"{prose(rng, 40)} {item} {prose(rng, 40)}", 28: None, 29: "",
    }
    docs(list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts, passage


def test_stages(spark, folder):
    path, texts, passage = folder
    df, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = df.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, path)
        out.write.parquet(f"{path}/stage-{number}")
        df = spark.read.parquet(f"{path}/stage-{number}")
        if number < 4:
            assert df.columns == columns
        seen.append({r["doc_id"]: r["text"] for r in df.collect()} if number < 4 else {r["doc_id"] for r in df.collect()})
    clean = set(range(12))
    assert set(seen[0]) == clean | {23, 24, 25, 26, 27}
    # 23 is a copy of 2 and loses every line; 25 loses the passage that 24 has.
    assert set(seen[1]) == clean | {24, 25, 26, 27}
    assert passage in seen[1][24]
    assert passage not in seen[1][25]
    assert all(seen[1][i] == texts[i] for i in clean)
    # 26 has the words of 0 in one line, all but one.
    assert set(seen[2]) == clean | {24, 25, 27}
    assert set(seen[3]) == clean | {24, 25}
    assert seen[4] == clean | {24, 25}


def test_run(spark, folder):
    path, _, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in rows} == set(range(12)) | {24, 25}
    assert all(r["offset"] + r["length"] <= 1024 for r in rows)


def test_no_rows(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
