from corpusql.operators import batches


def _df(spark, rows):
    return spark.createDataFrame(rows, "pos bigint, input_ids array<int>, attention_mask array<int>, labels array<int>")


def test_pad_and_defaults(spark):
    df = _df(spark, [(0, [1, 2, 3], None, None), (1, [4], [1], [9]), (2, [5, 6, 7, 8, 9], None, None)])
    out = {r["pos"]: r for r in batches.pad_batch(df, 2).collect()}
    assert out[0]["input_ids"] == [1, 2, 3] and out[1]["input_ids"] == [4, 0, 0]
    assert out[1]["attention_mask"] == [1, 0, 0] and out[1]["labels"] == [9, -100, -100]
    assert out[0]["attention_mask"] == [1, 1, 1] and out[0]["labels"] == [1, 2, 3]
    assert out[2]["input_ids"] == [5, 6, 7, 8, 9]                     # alone in batch 1


def test_completion_mask(spark):
    df = _df(spark, [(0, [7, 83, 81, 5, 83, 81, 6], None, None),   # template twice -> last
                     (1, [1, 2, 3], None, None),                    # absent
                     (2, [83], None, None)])                        # shorter than template
    d = batches.default_features(df)
    out = {r["pos"]: r["labels"] for r in batches.completion_mask(d, [83, 81]).collect()}
    assert out[0] == [-100, -100, -100, -100, -100, -100, 6]
    assert out[1] == [-100, -100, -100]
    assert out[2] == [-100]


def test_truncate(spark):
    df = _df(spark, [(0, [1, 2, 3, 4], [1, 1, 1, 1], None)])
    r = batches.truncate_tokens(df, 2).first()
    assert r["input_ids"] == [1, 2] and r["attention_mask"] == [1, 1] and r["labels"] is None
