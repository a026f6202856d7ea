"""Python steps take batches apart a slice at a time."""

import pyarrow as pa

from tessera.storage import SLICE_BYTES, SLICE_ROWS, slices


def test_slices_are_small_and_whole():
    many = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["x" * (i % 50) for i in range(10_000)])], names=["a", "b"])
    long = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["y" * 1_000_000] * 40)], names=["a", "b"])
    found = list(slices([many, long]))
    assert [x for part in found for x in part.column(0).to_pylist()] == [*range(10_000), *range(40)]
    assert max(part.num_rows for part in found) <= SLICE_ROWS
    assert all(part.num_rows * 1_000_000 <= SLICE_BYTES for part in found if part.column(1)[0].as_py().startswith("y"))
    assert list(slices([many.slice(0, 0)])) == []
