"""op8: one pass over the logits of a batch, shifted only where they could be large."""

import numpy as np
import pytest

from rationale.llm import scoring as S


def _by_word(net, near, target):
    """Log-probabilities word by word, in 64 bits."""
    wide = [x.astype(float) for x in net]
    out = []
    for x, y in zip(near, target, strict=True):
        hidden = np.tanh(sum(wide[0][e] * wide[1][k] for k, e in enumerate(x)) + wide[2])
        c, m = divmod(int(y), S.MEMBERS)
        out.append(sum(z[i] - z.max() - np.log(np.exp(z - z.max()).sum()) for z, i in ((hidden @ wide[3] + wide[4], c), (hidden @ wide[5][c] + wide[6][c], m))))
    return np.array(out)


@pytest.mark.parametrize("large", [False, True])
def test_logits_shifted_where_large(large):
    rng = np.random.default_rng(2)
    net = S.initial_network()
    if large:
        net[3][:, 5] += 100
        net[6][7] += np.linspace(0, 300, S.MEMBERS, dtype=np.float32)
    near, target = rng.integers(0, S.ENTRIES + 1, (300, 4)), rng.integers(0, S.ENTRIES, 300)
    target[:40] = 7 * S.MEMBERS + np.arange(40)
    order, first = S._by_class(target)
    weights = S._weights(net)
    assert weights[2] is not large
    logits = S._forward(net, near[order], first, weights)[2:]
    assert all((x.max(1) == 0).all() is np.bool_(large) for x in logits)
    assert S.log_probabilities(net, near, target) == pytest.approx(_by_word(net, near, target), abs=2e-4, rel=2e-5)
    squares = [np.full(x.shape, 1e-4, np.float32) for x in net]
    before = [x.copy() for x in net]
    S.train(net, squares, near, target)
    assert all(np.isfinite(x).all() for x in net)
    unseen = np.setdiff1d(np.arange(S.CLASSES), target // S.MEMBERS)
    assert np.array_equal(net[5][unseen], before[5][unseen]) and np.array_equal(net[6][unseen], before[6][unseen])
