import math

import numpy as np
import pytest

from weftsample.functions.poisson import poisson_block, poisson_quantile


def exact_pmf(mean, n):
    return math.exp(n * math.log(mean) - mean - math.lgamma(n + 1))


@pytest.mark.parametrize("mean", [1e-9, 0.01, 0.5, 1, 7.3, 32, 32.5, 100, 1234.5, 1e5])
def test_block_is_the_distribution_function(mean):
    first, cdf = poisson_block(mean)
    raw = [exact_pmf(mean, n) for n in range(first, first + len(cdf))]
    assert sum(raw) == pytest.approx(1, abs=1e-9)  # nothing noticeable is left out
    assert np.allclose(cdf, np.cumsum(raw), rtol=0, atol=1e-9)
    assert cdf[-1] == 1.0


@pytest.mark.parametrize("mean", [0.001, 0.3, 5.0, 31.9, 40.0, 3000.0])
def test_quantile_is_the_smallest_number_reaching_u(mean):
    u = np.random.default_rng(1).uniform(size=2000)
    drawn = poisson_quantile(u, np.full(len(u), mean))
    first, cdf = poisson_block(mean)
    assert drawn.tolist() == (first + np.searchsorted(cdf, u)).tolist()


def test_extreme_uniforms_and_huge_means():
    u = np.array([2.0**-53, 1 - 2.0**-53])
    for mean in (1e-6, 1.0, 31.0, 50.0, 1e6, 1e9):
        low, high = poisson_quantile(u, np.full(2, mean))
        spread = 9 * math.sqrt(mean) + 20
        assert max(0, mean - spread) <= low <= mean <= high + 1
        assert high <= mean + spread


def test_mixed_means_in_one_batch():
    rng = np.random.default_rng(2)
    mean = rng.choice([0.1, 2.0, 60.0, 900.0], size=20_000)
    drawn = poisson_quantile(rng.uniform(size=len(mean)), mean)
    for m in np.unique(mean):
        some = drawn[mean == m]
        assert some.mean() == pytest.approx(m, abs=5 * math.sqrt(m / len(some)))
        assert some.var() == pytest.approx(m, rel=0.15)
