"""Arrays read by byte ranges: every layout, and files cut anywhere."""
import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusql.sources import readers
from corpusql.sources.json_array import read_array


def _values(n, seed=1):
    rng = random.Random(seed)
    odd = ["}", "{", "]", "[", ",", '"', "\\", '\\"', "\\\\", "}}", '"}', "é☃😀", "\n", "\t", "plain text", "a } b { c", '\\"}{"']
    out = []
    for i in range(n):
        text = " ".join(rng.choice(odd) for _ in range(rng.randrange(12)))
        out.append({"db_id": f"d{i}", "question": text, "query": f"SELECT {i}", "deep": {"a": [[1, {"b": text}], []], "c": {}}})
    return out


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("layout", [{"indent": 2}, {}, {"separators": (",", ":")}, {"indent": 2, "ensure_ascii": False}])
def test_cut_anywhere(spark, tmp_path, small_splits, layout):
    values = _values(60)
    values[7]["question"] = "long } text { " * 300          # one record over many ranges
    (tmp_path / "a.json").write_text(json.dumps(values, **layout) + "\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(" \n" + json.dumps(values[:20], **layout), encoding="utf-8")
    found = read_array(spark, str(tmp_path))
    rows = found.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(80))
    assert [json.loads(r.record) for r in rows] == values + values[:20]
    tasks = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
    assert tasks > 10


def test_examples_and_positions(spark, tmp_path, small_splits):
    values = _values(50)
    (tmp_path / "x.json").write_text(json.dumps(values))
    got = readers.scan_examples(spark, str(tmp_path / "x.json")).orderBy("pos").collect()
    assert [(r.pos, r.db_id, r.question, r.query) for r in got] == [(i, v["db_id"], v["question"], v["query"]) for i, v in enumerate(values)]
    for k, v in enumerate(values):
        v["pos"] = 100 - k
    (tmp_path / "x.json").write_text(json.dumps(values))
    assert {r.db_id: r.pos for r in readers.scan_examples(spark, str(tmp_path / "x.json")).collect()} == {v["db_id"]: v["pos"] for v in values}
    del values[3]["pos"]           # numbers of some records only are no numbers
    (tmp_path / "x.json").write_text(json.dumps(values))
    assert sorted(r.pos for r in readers.scan_examples(spark, str(tmp_path / "x.json")).collect()) == list(range(50))


@pytest.mark.parametrize("content", ['[{"db_id": "a", "query": "q"}', '[{"db_id": "a", "query": "q"} {"db_id": "b", "query": "q"}]',
                                     '[{"db_id": "a", "query": "q"}, 5]', '[{"db_id": "a", "query": "q}]', '["a"]', '[{"db_id": "a" "query": "q"}]'])
def test_what_is_no_array_of_objects_raises(spark, tmp_path, content):
    (tmp_path / "x.json").write_text(content)
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.scan_examples(spark, str(tmp_path / "x.json")).collect()


def test_empty_array_and_mixed_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]\n")
    assert readers.scan_examples(spark, str(tmp_path)).count() == 0
    (tmp_path / "a.json").write_text(json.dumps(_values(3), indent=1))
    (tmp_path / "b.json").write_text('{"db_id": "a", "query": "q"}\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.scan_examples(spark, str(tmp_path)).collect()


def test_lines_keep_their_places_without_a_shuffle(spark, tmp_path, small_splits):
    values = [{"db_id": f"d{i}", "question": "q" * (i % 90), "query": f"SELECT {i}"} for i in range(300)]
    for k in range(3):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(v) for v in values[100 * k:100 * k + 100]) + "\n")
    df = readers.scan_examples(spark, str(tmp_path))
    assert {r.db_id: r.pos for r in df.collect()} == {v["db_id"]: i for i, v in enumerate(values)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    values[5]["pos"] = 0                         # a number beside records without one must not clash
    (tmp_path / "0.json").write_text("\n".join(json.dumps(v) for v in values[:100]) + "\n")
    assert readers.scan_examples(spark, str(tmp_path)).agg(F.countDistinct("pos")).first()[0] == 300


def test_a_batch_is_scanned_in_bounded_runs(spark, tmp_path, monkeypatch):
    """A batch is a number of chunks of any length: what is scanned at once follows bytes, and runs end at chunks."""
    import pyarrow as pa
    from corpusql.sources import json_array
    values = ["x" * 3000 + str(i) for i in range(2000)]
    batch = pa.record_batch([pa.array([1] * 2000), pa.array([0] * 1000 + [7] * 1000), pa.array(values), pa.array(["p"] * 2000)],
                            ["file", "start", "value", "path"])
    runs = list(json_array._runs([batch]))
    assert max(len(data) for _, _, data in runs) <= 1_060_000 and len(runs) >= 6
    joined = {start: b"".join(d.tobytes() for (_, s), _, d in runs if s == start).decode() for start in (0, 7)}
    assert joined[0] == "".join(v + "}" for v in values[:1000]) and joined[7] == "".join(v + "}" for v in values[1000:])
    assert [row for _, row, _ in runs] == sorted({row for _, row, _ in runs})
