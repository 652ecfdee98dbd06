"""What a Python worker holds for one stage is gone in the next one."""

import gc

import public_tokenizers
import pyarrow as pa

from stockledger.llm import bpe, common

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_codec_is_not_held_beyond_its_stage(spark):
    docs = spark.createDataFrame([(i, f"some words {i} of a text") for i in range(20)], "doc_id long, text string").repartition(2)
    assert bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).where("n_tokens > 0").count() == 20
    schema = pa.schema([("codecs", pa.int64())])

    def run(batches):
        for _ in common.runs(batches):
            gc.collect()
            yield common.record(schema, [sum(type(x).__name__ == "Codec" for x in gc.get_objects())])

    found = common.id_and_text(docs, "doc_id", "text").mapInArrow(run, "codecs long").collect()
    assert found and not any(r.codecs for r in found)


def test_held_once_in_a_stage(monkeypatch):
    made = []
    monkeypatch.setattr(common, "_HELD", {})
    for stage in (1, 1, 2):
        monkeypatch.setattr(common, "_stage", lambda stage=stage: stage)
        common.held(made.append, "x")
    assert made == ["x", "x"] and len(common._HELD) == 1
