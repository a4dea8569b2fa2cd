"""A label counts wherever one of its spans is clear of longer notices."""

import pytest

from skerry.llm import licenses

BY = "licensed under a creative commons attribution 4 0 international license"
BY_SA = "licensed under a creative commons attribution sharealike 4 0 international license"
GPL3 = "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
GPL2 = "licensed under the gnu general public license version 2"
GAP = " " + "other words stand here " * 20
CASES = [(BY_SA + GAP + BY, "cc-by,cc-by-sa"), (BY + GAP + BY_SA, "cc-by,cc-by-sa"), (BY, "cc-by"), (BY_SA, "cc-by-sa"), (GPL3 + GAP + GPL2, "gpl-2,gpl-3"), (GPL2 + GAP + GPL3, "gpl-2,gpl-3"), (GPL3, "gpl-3"), ((BY_SA + GAP) * 300 + BY, "cc-by,cc-by-sa")]


@pytest.fixture(scope="module")
def labels(spark):
    got, _ = licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id long, text string"))
    return {r.doc_id: r.labels for r in got.collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_clear_spans_keep_their_label(labels, k):
    assert labels[k] == CASES[k][1]
