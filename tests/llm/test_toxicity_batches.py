"""Words of few texts are held at a time."""

import pyarrow as pa

from opstrail.llm import toxicity


def test_features_leave_in_small_batches():
    n = 3 * toxicity.SLICE + 7
    part = pa.RecordBatch.from_arrays(
        [pa.array([False] * n), pa.array([1] * n, pa.int32()), pa.array([f"women talk {i}" for i in range(n)])], ["checks", "label", "body"]
    )
    out = list(toxicity._featured(toxicity.SWAPS)(iter([part])))
    assert max(b.num_rows for b in out) <= toxicity.SLICE and sum(b.num_rows for b in out) == n
    assert [x for b in out for x in b.column(2).to_pylist()][n - 1] == sorted({"women", "talk", str(n - 1)})
    assert [x for b in out for x in b.column(3).to_pylist()][0] == sorted({"men", "talk", "0"})
