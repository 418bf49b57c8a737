"""Kernel features are made for few rows at a time, and their sums are those of all rows."""

import numpy as np
import pandas as pd
import pytest

from aerocal.operators import kernel
from aerocal.operators.kernel import KernelInputs, kernel_values


def test_expand_yields_chunks_that_cover_the_frame(monkeypatch):
    monkeypatch.setattr(kernel, "CHUNK", 7)
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.normal(size=(23, 2)), columns=["a", "b"])
    frame.loc[4, "a"] = np.nan
    marks, root = rng.normal(size=(3, 2)), rng.normal(size=(3, 3))
    inputs = KernelInputs(("a", "b"), np.zeros(2), np.ones(2), np.full(2, 2.0), marks, 0.5, root)
    parts = list(inputs.expand(frame))
    assert [len(z) for _, z in parts] == [7, 7, 7, 2]
    whole = kernel_values(inputs.standard(frame), marks, 0.5) @ root
    assert np.vstack([z for _, z in parts]) == pytest.approx(np.column_stack([whole, np.ones(23)]))
    y, w = rng.normal(size=23), rng.normal(size=4)
    added = sum(kernel._weighted(z, y[at], w, 0.1) for at, z in parts)
    assert added == pytest.approx(kernel._weighted(np.vstack([z for _, z in parts]), y, w, 0.1))
