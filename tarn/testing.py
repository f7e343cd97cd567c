"""Fixtures for tests of one's own steps. Name this module in ``pytest_plugins``."""

from __future__ import annotations

import pytest

from tarn.plans import parameters
from tarn.sources import results


@pytest.fixture
def results_root(tmp_path, monkeypatch) -> str:
    """A folder for published results that no other test sees; encoders and codecs that a test registers are gone after it."""
    monkeypatch.setattr(parameters, "ENCODERS", list(parameters.ENCODERS))
    monkeypatch.setattr(results.Codec, "registered", list(results.Codec.registered))
    monkeypatch.setattr(results, "CODECS", dict(results.CODECS))
    return str(tmp_path / "results")
