"""Contents that many sets have don't bring unlike sets together, and no similar pair is lost by leaving them out."""

import numpy as np

from skerry.llm import jaccard


def test_frequent_contents_are_left_out():
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    common = draw(200)
    sets = [np.unique(np.concatenate([common, draw(300)])) for _ in range(120)]
    names, n = np.unique(np.concatenate([jaccard.signatures(x, 80, every=True) for x in sets]), return_counts=True)
    frequent = names[n > 1], np.argsort(np.argsort(-n[n > 1], kind="stable"), kind="stable").astype(np.uint64)
    assert len(frequent[0])
    met = lambda **options: np.unique(np.concatenate([jaccard.signatures(x, 80, **options) for x in sets]), return_counts=True)[1].max()
    assert met(every=True) >= 10 and met(frequent=frequent) <= 2


def test_similar_sets_meet_whatever_is_frequent():
    rng = np.random.default_rng(8)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for percent in (60, 80, 90, 95):
        for n in (2, 5, 9, 20, 60, 333, 1200):
            for _ in range(12):
                x = np.unique(draw(n))
                most = 2 * len(x) * (100 - percent) // (100 + percent)
                gone = int(rng.integers(0, most + 1))
                y = np.unique(np.concatenate([x[gone // 2 :], draw(gone - gone // 2)]))
                both = len(np.intersect1d(x, y))
                if 100 * both < percent * (len(x) + len(y) - both):
                    continue
                known = np.unique(np.concatenate([jaccard.signatures(v, percent, every=True) for v in (x, y)]))
                some = np.sort(rng.permutation(known)[: len(known) // 2])
                frequent = some, rng.permutation(len(some)).astype(np.uint64)
                own = [set(jaccard.signatures(v, percent, frequent).tolist()) for v in (x, y)]
                assert own[0] & own[1] or np.array_equal(x, y)


def test_one_component_is_found_without_a_tree(monkeypatch):
    counts = np.full((500, 64), 5, np.int32)
    counts[np.arange(500), np.arange(500) % 64] += 1
    monkeypatch.setattr(jaccard, "Tree", type("None_", (), {"_may": staticmethod(jaccard.Tree._may)}))
    nodes = list(range(500))
    assert {a for a, _ in jaccard.link(None, counts, nodes, nodes, None, 80)} == set(range(1, 500))
