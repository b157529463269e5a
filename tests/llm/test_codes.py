"""Binary codes of operator 6: unbiased estimates, a confidence bound that keeps linked pairs and discards others."""

import numpy as np
import pytest

from notedrift.llm import embeddings as M


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_codes_are_packed_bits():
    x = unit(np.random.default_rng(0).standard_normal((5, 37)))
    packed, factor = M.codes(x)
    assert packed.shape == (5, 5) and packed.dtype == np.uint8
    turned = x @ M.rotation(37)
    assert (M.signs(packed, 37) == np.where(turned >= 0, 1, -1)).all()
    assert factor == pytest.approx((turned * M.signs(packed, 37)).sum(axis=1) / np.sqrt(37))


def test_estimates_are_unbiased(monkeypatch):
    rng = np.random.default_rng(1)
    d = 48
    x, y = unit(rng.standard_normal((2, d)))
    y = unit((x + 0.7 * y)[None])[0]
    found = []
    for _ in range(3000):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        monkeypatch.setattr(M, "rotation", lambda _, q=q * np.sign(np.diag(r)): q)
        packed, factor = M.codes(x[None])
        found.append(float(M.signs(packed, d)[0] @ (y @ M.rotation(d))) / (np.sqrt(d) * factor[0]))
    assert np.mean(found) == pytest.approx(x @ y, abs=4 * np.std(found) / np.sqrt(len(found)))
    # and their error is no wider than the bound's law
    assert np.std(found) <= np.sqrt(1 - (x @ y) ** 2) * np.sqrt(1 - 0.75 ** 2) / (0.75 * np.sqrt(d - 1)) * 1.1


@pytest.mark.parametrize("d", [2, 8, 32, 64, 256])
def test_linked_pairs_stay_and_most_others_go(d):
    rng = np.random.default_rng(d)
    x = unit(rng.standard_normal((400, d)))
    near = unit(x + rng.standard_normal((400, d)) * 0.45 / np.sqrt(d))
    y = np.concatenate([near, unit(rng.standard_normal((400, d)))])
    packed, factor = M.codes(x)
    got = M.undecided(M.signs(packed, d), factor, y @ M.rotation(d), 0.9)
    kept = set(map(tuple, got.tolist()))
    linked = set(map(tuple, np.argwhere(x @ y.T >= 0.9).tolist()))
    assert linked and linked <= kept
    if d >= 64:
        assert len(kept) - len(linked) < 0.02 * x.shape[0] * y.shape[0]
