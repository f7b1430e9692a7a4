"""Each stage against brute force on what the stage before it kept."""
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from corpusql.llm import quality
from corpusql.llm.common import stored

from brute import edge_rows, fingerprint, fm_dedup, groups, mix, table
from conftest import SF_SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, n = docs.columns, {"documents": docs.count()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SF_SMALL), f"test-{name}")
        after = docs.collect()
        n[name] = len(after)
        if name != "tokens":
            assert docs.columns == columns
        if name == "quality":
            keep = quality.classify(spark.read.parquet(f"{SF_SMALL}/documents.parquet"),
                                    spark.read.parquet(f"{SF_SMALL}/labels.parquet")).where("keep").collect()
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in keep)
            junk = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("quality = 1").collect()}
            assert len(junk & {r.doc_id for r in after}) >= 0.95 * len(junk & {r.doc_id for r in before})
        elif name == "near_dedup":
            want = groups([(r.doc_id, fingerprint(r.text)) for r in before], 2)
            assert sorted(r.doc_id for r in after) == sorted(set(want.values()))
        elif name == "substring_dedup":
            want = {i: text for i, _, _, text in fm_dedup([(r.doc_id, r.text) for r in before], 13)}
            assert {r.doc_id: r.text for r in after} == want
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "mix":
            taken, _ = mix([(r.doc_id, r.text, r.source) for r in before])
            assert sum(len(r.text.split()) for r in after) == sum(taken.values())
        else:
            library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
            texts = {r.doc_id: r.text for r in before}
            assert len(after) == len(before) and all(r.ids == library.encode(texts[r.doc_id]) for r in after)
    assert n["documents"] > n["quality"] > n["near_dedup"] == n["substring_dedup"] and n["mix"] == n["tokens"] > 0
    assert docs.select(F.sum("n_ids")).first()[0] > 0


def test_edge_rows_and_an_empty_table(spark):
    """Nulls in every column, empty, long and repeated texts, columns of any name; then no rows at all."""
    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    docs = table(spark, edge_rows())
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SF_SMALL), f"test-edge-{name}")
        if name != "tokens":
            assert docs.columns == columns
        if name == "near_dedup":
            want = groups([(r.doc_id, fingerprint(r.text)) for r in before], 2)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(set(want.values()))
        if name == "substring_dedup":
            want = {i: text for i, _, _, text in fm_dedup([(r.doc_id, r.text) for r in before], 13)}
            # a null text stays null, and spaces between kept words become one
            assert {r.doc_id: r.text or "" for r in docs.collect()} == want
        if name == "tokens":
            texts = {r.doc_id: r.text or "" for r in before}
            assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(str(r.doc_id) for r in before)
            assert all(r.ids == library.encode(texts[r.doc_id]) for r in docs.collect())
    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), f"test-empty-{name}")
        assert docs.count() == 0
