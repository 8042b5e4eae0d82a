"""Upper tails of the chi-square distribution, in closed form for 2 and 5 degrees of freedom."""

from __future__ import annotations

import math

Z95 = 1.959963984540054


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for a chi-square variable with ``df`` in {1, 2, 5}."""
    if x <= 0:
        return 1.0
    if df == 1:
        return math.erfc(math.sqrt(x / 2))
    if df == 2:
        return math.exp(-x / 2)
    if df == 5:
        return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    raise ValueError(f"no closed form kept for df={df}")
