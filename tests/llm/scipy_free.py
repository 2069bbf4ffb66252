"""Exact reference values."""

from fractions import Fraction
from math import comb


def binomial_cdf(k, n, p):
    q = Fraction(p)
    return float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))
