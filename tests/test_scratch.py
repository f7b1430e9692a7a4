"""Scratch tables go with the scope that owns them."""
import os

import pytest

from corpusql.session import scratch_scope, stored


def _paths(df):
    return [f.removeprefix("file:").replace("///", "/") for f in df.inputFiles()]


def test_scope_removes_its_own_tables_only(spark):
    kept = stored(spark.range(5), "kept")
    with scratch_scope(spark):
        outer = stored(spark.range(5), "outer")
        with scratch_scope(spark):
            inner = _paths(stored(spark.range(5), "inner"))
        assert not any(map(os.path.exists, inner)) and all(map(os.path.exists, _paths(outer)))
        files = _paths(outer)
    assert not any(map(os.path.exists, files)) and all(map(os.path.exists, _paths(kept)))
    with pytest.raises(ValueError), scratch_scope(spark):
        files = _paths(stored(spark.range(5), "failed"))
        raise ValueError
    assert not any(map(os.path.exists, files))
