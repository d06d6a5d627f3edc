"""Near copies of one text: the leader of a list answers for nearly all of them."""

import random

from hushgate.llm import jaccard


def test_near_copies_are_not_compared_with_each_other(spark, monkeypatch):
    pick, n_copies = random.Random(11), 120
    stem = [f"w{i}" for i in range(150)]

    def copy(i):  # three edits of a word each: 0.81 like the text it stems from, about 0.66 like another copy
        ws = list(stem)
        for j, at in enumerate(sorted(pick.sample(range(10, 140, 6), 3))):
            ws[at] = f"edit{i}x{j}"
        return " ".join(ws)

    # The stem has the largest id, so that the least id of a list is a copy's.
    rows = [(i, copy(i)) for i in range(n_copies)] + [(n_copies, " ".join(stem))]
    asked, near = [], jaccard._near
    monkeypatch.setattr(jaccard, "_near", lambda pairs, *a: asked.append(pairs.count()) or near(pairs, *a))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=5, percent=80).collect()
    assert {r.component_id for r in got} == {0} and len(got) == n_copies + 1
    assert asked[-1] < n_copies  # pairs after the answers; each with each would be 7,140
