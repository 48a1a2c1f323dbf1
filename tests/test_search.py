"""The kernel search: gradients against differences, climbs against a pattern search."""

import numpy as np
import pytest

from isoplane.functions.kernels import kernel_block, kernel_slopes
from isoplane.plans import gp, search
from isoplane.spec import KernelConfig

KERNELS = [KernelConfig(constant=1.7), KernelConfig(kernel_type="matern", nu=0.5), KernelConfig(kernel_type="matern", nu=1.5, constant=2.0),
           KernelConfig(kernel_type="matern", nu=2.5, white_noise=True, noise_level=0.004), KernelConfig(kernel_type="rq", rq_alpha=0.7),
           KernelConfig(ard=False, length_scale=0.8), KernelConfig(kernel_type="rq", rq_alpha=2.0, white_noise=True, noise_level=0.002)]


def data(seed, n=30, width=3, repeated=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + rng.normal(0, 0.2, n)
    return x, (y - y.mean()) / y.std(), rng.uniform(0.01, 0.1, n), rng.integers(1, 9, n).astype(float)


def differences(value, theta, step=1e-5):
    out = []
    for k in range(len(theta)):
        up, down = theta.copy(), theta.copy()
        up[k] += step
        down[k] -= step
        out.append((value(up) - value(down)) / (2 * step))
    return np.array(out)


@pytest.mark.parametrize("kernel", KERNELS, ids=lambda k: f"{k.kernel_type}-{k.nu}-{k.ard}-{k.white_noise}")
@pytest.mark.parametrize("rows", [False, True])
def test_gradient_equals_differences(kernel, rows):
    x, y, noise, counts = data(3)
    made = (0.05, counts, 2.5) if rows else (noise, None, 0.0)
    theta = np.log([v for _, v, _ in kernel.free(3)])

    def value(t):
        return gp.likelihood_slope(kernel.with_free(3, np.exp(t)), x, y, *made)[0]

    lml, slope = gp.likelihood_slope(kernel, x, y, *made)
    params = kernel.params(3)
    plain = gp.collapsed_likelihood(params, x, y, counts, 2.5, 0.05) if rows else gp.log_likelihood(params, x, y, noise)
    assert lml == plain[0]
    assert slope == pytest.approx(differences(value, theta), rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("kernel", KERNELS[:5], ids=lambda k: f"{k.kernel_type}-{k.nu}")
def test_slopes_begin_with_the_kernel(kernel):
    x, z = data(1)[0], data(2, 7)[0]
    assert kernel_slopes(kernel.params(3), x, z)[0] == pytest.approx(kernel_block(kernel.params(3), x, z), rel=1e-12)


def pattern_search(value, theta, low, high):
    """Hooke and Jeeves 1961, to 1e-4 of the range."""
    step, best = (high - low) / 8, value(theta)
    while (step > (high - low) * 1e-4).any():
        here, top = theta, best
        for k in range(len(theta)):
            for sign in (1, -1):
                tried = here.copy()
                tried[k] = np.clip(here[k] + sign * step[k], low[k], high[k])
                got = value(tried)
                if got > top:
                    here, top = tried, got
                    break
        if top > best:
            theta, best = here, top
        else:
            step = step / 2
    return best


@pytest.mark.parametrize("kernel", KERNELS, ids=lambda k: f"{k.kernel_type}-{k.nu}-{k.ard}-{k.white_noise}")
def test_search_is_never_below_a_pattern_search(spark, kernel):
    x, y, noise, _ = data(8, 40, 2)
    free = kernel.free(2)
    low, high = np.log([b for _, _, b in free]).T
    score = search._likelihood(kernel, (x, y, noise, None, 0.0))
    thetas = search.candidate_thetas(np.clip(np.log([v for _, v, _ in free]), low, high), np.column_stack([low, high]), 64, 42)
    first = sorted(thetas, key=lambda t: -score(t))[:3]
    _, lml = search.search(spark, kernel, x, y, noise)
    assert lml >= max(pattern_search(score, t, low, high) for t in first) - 1e-6


def test_climb_stops_on_bounds_and_says_so():
    low, high = np.full(3, -1.0), np.full(3, 1.0)
    target = np.array([0.3, 4.0, -4.0])
    theta, value, done = search.climb(lambda t: (-((t - target) ** 2).sum(), -2 * (t - target)), np.zeros(3), low, high)
    assert done and theta == pytest.approx([0.3, 1.0, -1.0], abs=1e-6)
    assert search.climb(lambda t: (-((t - target) ** 2).sum(), -2 * (t - target)), np.zeros(3), low, high, max_steps=2)[2] is False


def test_climb_leaves_what_cannot_be_factored():
    def value(t):
        return (-np.inf, np.zeros(1)) if t[0] > 0.5 else (float(t[0]), np.ones(1))
    theta, best, done = search.climb(value, np.zeros(1), np.array([-1.0]), np.array([1.0]))
    assert done and 0.49 < theta[0] <= 0.5
    assert search.climb(lambda t: (-np.inf, np.zeros(1)), np.zeros(1), -np.ones(1), np.ones(1))[2]


def test_climb_through_a_curved_valley():
    def value(t):
        a, b = t
        return -((1 - a) ** 2 + 100 * (b - a * a) ** 2), np.array([2 * (1 - a) + 400 * a * (b - a * a), -200 * (b - a * a)])
    theta, best, done = search.climb(value, np.array([-1.2, 1.0]), np.full(2, -5.0), np.full(2, 5.0))
    assert done and theta == pytest.approx([1, 1], abs=1e-4) and best == pytest.approx(0, abs=1e-8)
