"""Distribution tails against closed forms and table values."""

import math

import pytest

from corpuscope.functions.tails import beta_inc, chi2_upper, correlation_p, t_two_sided


@pytest.mark.parametrize("x", [0.01, 0.5, 1.0, 3.84, 20.0, 200.0])
def test_chi2(x):
    assert chi2_upper(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
    assert chi2_upper(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)


def test_t():
    assert t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, rel=1e-6)
    assert t_two_sided(1.96, 1e7) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-5)
    assert beta_inc(2, 3, 0.4) == pytest.approx(0.5248)


def test_correlation():
    assert math.isnan(correlation_p(0.5, 2))
    assert correlation_p(1.0, 10) == 0.0
    assert correlation_p(0.632, 10) == pytest.approx(0.05, abs=1e-3)
