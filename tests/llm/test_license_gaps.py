"""Phrases that are wrapped in indented, commented or centred blocks."""

import time

import pytest

from spanlight.llm import license_scan


@pytest.mark.parametrize("gap", [" ", "\n" + " " * 12, "\n *" + " " * 30, "*" * 40])
def test_gaps_of_any_length(gap):
    labels = lambda text: {r.label for *_, r in license_scan.detections(text.lower())}
    assert labels(f"Mozilla{gap}Public{gap}License") == {"mpl"}
    assert labels(f"License{gap}:{gap}MIT") == {"mit"}


def test_long_gaps_stay_linear():
    started = time.monotonic()
    license_scan.detections("license mozilla apache mit " + ("license" + ":" * 300_000 + "x") + " mozilla" + " " * 300_000)
    assert time.monotonic() - started < 20
