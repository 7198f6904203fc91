"""The n-gram stage: of linked documents one stays, and only texts of possible copies are looked up."""

import corpus_pipeline
from strataweave.llm import partenum


def test_only_possible_copies_are_looked_up(llm):
    base = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[i] + " more") for i in range(0, 30, 10)] + [(0, base[0]), (None, base[1]), (None, base[2]), (200, None), (201, "")]
    docs = llm.createDataFrame(rows, "doc_id int, text string")
    got = corpus_pipeline.ngram_jaccard(llm, docs, "")
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(map(str, [*range(30), None, None, 200, 201]))
    gone = llm.createDataFrame([(100 + i,) for i in range(0, 30, 10)], "doc_id long")
    assert {r["doc_id"] for r in docs.where(partenum.possible(gone, docs["doc_id"])).collect()} == {100, 110, 120}
    empty = corpus_pipeline.ngram_jaccard(llm, docs.limit(0), "")
    assert empty.isEmpty() and empty.columns == docs.columns
