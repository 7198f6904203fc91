"""A large block takes few steps, and its tables are made anew only some of them."""

import numpy as np

from strataweave.llm import range_coder


def test_a_large_block_takes_few_steps(monkeypatch):
    made = []
    for name in ("_weigh", "_relate"):
        plain = getattr(range_coder._Model, name)
        monkeypatch.setattr(range_coder._Model, name, lambda self, f=plain: made.append(f.__name__) or f(self))
    ids = np.random.RandomState(5).zipf(1.3, range_coder.LARGE) % 5000
    coded = range_coder.encode_block(ids)
    assert range_coder._lanes(len(ids))[1] <= 256  # 512 before
    assert made.count("_relate") <= 8 and made.count("_weigh") <= 25  # 12 and 47 before
    assert (range_coder.decode_block(coded, len(ids)) == ids).all()
