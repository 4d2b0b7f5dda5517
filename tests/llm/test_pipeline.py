import hashlib

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from epilane.llm import bpe, pii, toxicity

from . import cases
from .test_neardup import model as near_model


def test_stages_against_brute_force(spark):
    """Every stage on the rows that the stages before it kept."""
    folder = cases.FOLDER
    docs = cases.documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    texts = cases.texts(spark, folder)
    scorer = toxicity.Scorer(model, toxicity.Matcher(model.entries))
    texts = {k: t for k, t in texts.items() if scorer.scores([t])[0] < 0.5}
    component = {k: c for k, _, c in near_model(texts.items())}
    texts = {k: t for k, t in texts.items() if component[k] == k}
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    whole = {k for k, t in texts.items() if any(i in t for i in items)}
    texts = {k: t for k, t in texts.items() if k not in whole}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    weights = pii.fit_pii(frame)
    tokenizer = Tokenizer.from_file(bpe.BYTE_BPE)
    expected = {}
    for key, text in texts.items():
        for start, kind, end, _ in reversed(pii.all_spans(text, weights)):
            text = f"{text[:start]}<{pii.KINDS[kind].upper()}>{text[end:]}"
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        expected[key] = (
            len(ids),
            hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )
    rows = entry_point.queries()["pipeline"](spark, folder).collect()
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows}
    assert len(rows) == len(found)
    assert found == expected


def test_stages_take_awkward_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark = spark.createDataFrame([(1, "no such passage " * 10)], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame, n in ((cases.awkward(spark), 11), (cases.nothing(spark), 0)):
        docs = frame
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == frame.columns
            path = f"{tmp_path}/{n}-{i}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == n
