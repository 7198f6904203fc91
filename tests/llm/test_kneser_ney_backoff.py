"""Evidence of symbols that the labelled sample doesn't have after their context, against the whole formula."""

import numpy as np
import pyarrow as pa

from strataweave.llm import kneser_ney


def codes(*texts):
    raw = [t.encode() for t in texts]
    return kneser_ney.symbols(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw]))


def counted(words):
    table = pa.table({"word": pa.array([w.encode() for w in words], pa.binary()), "n": pa.array(list(words.values()))})
    return kneser_ney._counts(table)


def test_unseen_symbols_back_off():
    by_class = [counted({"abc": 40, "abd": 2}), counted({"abc": 5, "abe": 9, "abf": 3, "xy": 8})]
    grams = np.union1d(by_class[0][0], by_class[1][0])
    shared = np.linspace(0.01, 0.3, len(grams))
    model = kneser_ney._combine(grams, by_class, shared)

    def whole(code, p):
        """log p(toxic) - log p(ordinary), a symbol and context at a time; p is the shared probability."""
        inside = [{g: n for g, n in zip(*c) if g >> 8 == code >> 8} for c in by_class]
        both = {g: sum(c.get(g, 0) for c in inside) for g in {*inside[0], *inside[1]}}
        d, total = kneser_ney.SHARED_DISCOUNT, sum(both.values())
        pooled = (max(both.get(code, 0) - d, 0) + d * len(both) * p) / total if total else p
        logs = []
        for own in inside:
            n = sum(own.values()) + kneser_ney.STRENGTH
            freed = sum(min(x, kneser_ney.DISCOUNT) for x in own.values()) + kneser_ney.STRENGTH
            logs.append(np.log(max(own.get(code, 0) - kneser_ney.DISCOUNT, 0) / n + freed / n * pooled))
        return logs[1] - logs[0]

    seen = dict(zip(grams.tolist(), shared))
    code = codes("abc", "abq", "xz", "abcabc", "zzz", "")
    expected = np.array([whole(c, seen.get(c, 0.02)) for c in code.tolist()])
    got = kneser_ney.evidence(model, code)
    assert np.allclose(got, expected)
    unseen = ~np.isin(code, grams)
    after_known = np.isin(code >> 8, grams >> 8)
    assert (np.abs(got[unseen & after_known]) > 1e-3).any() and (got[unseen & ~after_known] == 0).all()
