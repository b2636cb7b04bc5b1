from __future__ import annotations

import inspect
import re
from pathlib import Path

import numpy as np
import pytest

from twinspot.llm import common, line_dedup, near_dup, packing, toxicity


def _held() -> float:
    """MB of this process that are no mapped files."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="Linux only")
def test_a_task_leaves_no_free_memory_in_its_worker():
    kept = []

    def kernel(batches):
        # some 180 MB in blocks of the heap, which a block above them that stays keeps from shrinking
        blocks = [np.ones(12_000) for _ in range(2000)]
        kept.append(np.ones(12_000))
        yield from (b for b in batches if len(blocks))

    before = _held()
    assert list(common.lean(kernel)(iter([1, 2]))) == [1, 2]
    assert len(kept) == 1 and _held() < before + 60


@pytest.mark.parametrize("module", [toxicity, line_dedup, near_dup, packing])
def test_the_pipeline_has_no_other_kernels(module):
    source = inspect.getsource(module)
    assert source.count(".mapInArrow(") == source.count(".mapInArrow(lean(") > 0
