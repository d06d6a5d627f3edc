"""Vectors of several lengths in one table."""

import numpy as np

from hushgate.llm import neardup


def test_vectors_of_every_length_meet_their_own(spark):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for n, d in enumerate((48, 48, 48, 20, 20, 3, 1)):
        base = r.standard_normal(d)
        near = base + 0.02 * r.standard_normal(d) if d > 1 else base * 3
        for k, v in enumerate((base, base * 2, near)):
            rows.append((n * 10 + k, v.tolist()))
            want[n * 10 + k] = (2, n * 10)
    rows += [(100, [1.0] * 48), (101, [1.0] * 47), (102, [0.0] * 20), (103, None), (104, [])]
    want |= {k: (0, k) for k in range(100, 105)}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {x.vec_id: (x.n_links, x.component_id) for x in neardup.near_duplicates(table).collect()}
    assert got == want


def test_recall_by_band_for_pairs(spark):
    """Pairs at 0.90, 0.92 and 0.95 apart from each other, of the usual length and of another."""
    r = np.random.default_rng(2)
    rows, pairs = [], {}
    for d, many in ((64, 120), (40, 60)):
        for band in (0.901, 0.92, 0.95):
            for _ in range(many):
                a = r.standard_normal(d)
                a /= np.linalg.norm(a)
                z = r.standard_normal(d)
                z -= (z @ a) * a
                rows += [(len(rows), a.tolist()), (len(rows) + 1, (a * band + z / np.linalg.norm(z) * np.sqrt(1 - band * band)).tolist())]
                pairs.setdefault((d, band), []).append(len(rows) - 1)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    links = {x.vec_id: x.n_links for x in neardup.near_duplicates(table).collect()}
    for (d, band), ids in pairs.items():
        found = np.mean([links[i] for i in ids])
        assert 0.85 <= found <= 1, (d, band, found)
    assert np.mean([links[i] for ids in pairs.values() for i in ids]) >= 0.93
