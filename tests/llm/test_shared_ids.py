"""Rows that share an id but not a vector, and token ids that two bytes can't hold."""

import numpy as np
import pytest

from skerry.llm import ann, token_files


def test_each_vector_of_an_id_counts(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [1.0, 0.1]), (7, [-1.0, 0.2]), (7, [1.0, 0.1]), (8, [0.1, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(df, lambda i: i % 50 == 0).orderBy("rank").collect()]
    near, far = 1 / np.sqrt(1.01), 0.2 / np.sqrt(1.04)
    assert got == [(0, 1, 7, round(near, 6)), (0, 2, 8, round(near, 6)), (0, 3, 7, round(far, 6))]


def test_large_token_ids_are_refused():
    assert token_files.shifted(np.array([0, 65_534], "<u4").tobytes()) == np.array([1, 65_535], "<u2").tobytes()
    assert token_files.shifted(b"") == b""
    with pytest.raises(ValueError, match="two bytes"):
        token_files.shifted(np.array([65_535], "<u4").tobytes())
