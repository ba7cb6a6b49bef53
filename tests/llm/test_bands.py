"""Bands of near duplicates by threshold."""

import pytest

from quorumlake.llm.neardup import bands_of


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 90, 99, 100])
def test_chance_of_missing(percent):
    bands, rows = bands_of(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= 3e-7 and bands * rows <= 192


def test_contract_keeps_its_bands():
    assert bands_of(85) == (32, 6) and bands_of(80) == (38, 5)
