from __future__ import annotations

import random

import corpus_pipeline
from stockledger.llm import queries
from stockledger.llm.common import table, written


def test_every_stage_takes_effect_and_keeps_clean_documents(spark, tmp_path):
    draw = random.Random(8)
    words = lambda n: " ".join("".join(draw.choice("abcdefghijkl") for _ in range(draw.randint(3, 8))) for _ in range(n))
    clean = [words(draw.randint(60, 120)) for _ in range(60)]
    item, passage = words(14), words(70)
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(100 + i, words(30) + " zuqxvile zuqxfoul zuqxbad " + words(20)) for i in range(40)]
    docs += [(200, clean[0]), (201, clean[1] + " one"), (202, f"{words(50)} {item} {words(20)}")]
    docs += [(203, f"{words(60)}\n{passage}\n{words(40)}"), (204, f"{words(60)}\n{passage}\n{words(40)}"), (205, None), (206, "")]
    rows = [(d, t, "en", None, len(t) if t is not None else None) for d, t in docs]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(d, 1, int(100 <= d < 200)) for d, _ in docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame = table(spark, folder, "documents")
    columns, kept = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = written(stage(spark, frame, folder), name)
        assert frame.columns == columns
        kept[name] = {r.doc_id: r.text for r in frame.collect()}
    left = set(range(60)) | {200, 201, 202, 203, 204, 205, 206}
    assert set(kept["toxicity"]) == left
    assert set(kept["ngram_jaccard"]) == left - {200, 201}
    texts = kept["substring_dedup"]
    assert set(texts) == left - {200, 201} and all(texts[i] == clean[i] for i in range(60))
    assert passage in texts[203] and len(texts[204]) < len(dict(docs)[204]) - 250
    assert set(kept["decontamination"]) == left - {200, 201, 202}
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, frame, folder).collect()}
    assert set(last) == set(kept["decontamination"]) and last[205].n_tokens == 0 and all(r.valid_utf8 for r in last.values())


def test_each_operator_has_its_query():
    names = [name.split("_")[0] for name in queries.REGISTRY if name != "pipeline"]
    assert names == [f"op{n}" for n in range(1, 14)] and "pipeline" in queries.REGISTRY
