from math import ceil, comb

import pytest

from tidepool.llm import minhash


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_lose_next_to_no_pair_at_the_threshold(percent):
    n, s = minhash.BANDS * minhash.ROWS, percent / 100
    least = s - minhash.SLACK * (s * (1 - s) / n) ** 0.5
    assert sum(comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(ceil(least * n))) < 1e-9
