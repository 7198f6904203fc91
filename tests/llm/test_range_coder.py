"""Blocks of the context-mixing coder: independent, checked, and smaller than what any single order gives."""

import numpy as np
import pytest

from strataweave.llm import range_coder


def chain(n, kinds=800, followers=12, seed=3):
    """Each id is followed by one of a few; one step in twenty goes anywhere."""
    r = np.random.RandomState(seed)
    after = r.randint(0, 50000, (kinds, followers)) % kinds
    pick, jump, where = r.randint(0, followers, n), r.rand(n) < 0.05, r.randint(0, kinds, n)
    out = np.zeros(n, np.int64)
    for i in range(1, n):
        out[i] = where[i] if jump[i] else after[out[i - 1], pick[i]]
    return out * 17 % 50257


def entropy(keys):
    n = np.unique(keys, return_counts=True)[1] / len(keys)
    return -(n * np.log2(n)).sum()


def test_mixture_beats_order_0():
    ids = chain(300_000)
    coded = range_coder.encode_block(ids)
    assert (range_coder.decode_block(coded, len(ids)) == ids).all()
    assert 8 * len(coded) / len(ids) < 0.55 * entropy(ids)


def test_order_2_is_used():
    r = np.random.RandomState(1)
    ids = np.zeros(100_000, np.int64)
    table = r.randint(0, 64, (64, 64))
    ids[:2] = 1, 2
    jump = r.rand(len(ids)) < 0.1
    for i in range(2, len(ids)):
        ids[i] = r.randint(64) if jump[i] else table[ids[i - 2], ids[i - 1]]
    coded = range_coder.encode_block(ids)
    assert (range_coder.decode_block(coded, len(ids)) == ids).all()
    assert 8 * len(coded) / len(ids) < 2 < entropy(ids[1:] * 64 + ids[:-1]) - entropy(ids)


def test_blocks_are_reset(monkeypatch):
    monkeypatch.setattr(range_coder, "BLOCK", 5000)
    ids = np.concatenate([chain(5000), chain(5000), chain(1234, seed=4)])
    data = range_coder.write_segment(np.array([1, 2]), np.array([9000, 2234]), ids)
    doc_ids, lengths, back = range_coder.read_segment(data)
    assert doc_ids.tolist() == [1, 2] and lengths.tolist() == [9000, 2234] and (back == ids).all()
    # equal blocks are coded alike wherever they stand, so none depends on what is before it
    assert range_coder.encode_block(ids[:5000]) == range_coder.encode_block(ids[5000:10000])
    for at in range(30, len(data), 997):
        with pytest.raises(range_coder.CorruptError):
            range_coder.read_segment(data[:at] + bytes([data[at] ^ 16]) + data[at + 1 :])


def test_all_ids_and_none():
    for ids in (np.arange(65536), np.arange(65536)[::-1], np.full(70000, 65535), np.random.RandomState(2).permutation(65536).repeat(2)):
        assert (range_coder.decode_block(range_coder.encode_block(ids), len(ids)) == ids).all()
    assert len(range_coder.read_segment(range_coder.write_segment(np.zeros(0), np.zeros(0), np.zeros(0, np.int64)))[2]) == 0
