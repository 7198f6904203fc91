"""Chains of candidates too large for one task: what travels grows with the sets, and no link is lost."""

import random

import pytest

from strataweave.llm import partenum


def rows(seed):
    """Versions of three texts, apart and mixed, with a passage that all have."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    out = []
    for i in range(72):
        own = [f"t{i % 3}w{j}" for j in range(90)]
        for _ in range(r.randrange(7)):
            own[r.randrange(len(own))] = f"x{r.randrange(40)}"
        out.append((i, " ".join(passage + own[: r.randrange(60, 90)])))
    return out


@pytest.mark.parametrize("elements", [4_000_000, 900])
def test_one_pair_a_set(llm, monkeypatch, elements):
    df = llm.createDataFrame(rows(1), "doc_id long, text string")
    want = sorted(map(tuple, partenum.jaccard_join(df).collect()))
    pairs, verify = [], partenum._verify
    monkeypatch.setattr(partenum, "_verify", lambda p, sets: pairs.append(p.count()) or verify(p, sets))
    assert sorted(map(tuple, partenum.jaccard_join(df, 12, elements).collect())) == want
    assert len({c for _, _, c in want}) > 1 and max(sum(x[2] == c for x in want) for c in {x[2] for x in want}) > 12
    assert 0 < sum(pairs) <= len(want)
