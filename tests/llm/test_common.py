"""What Python workers keep between operators."""

import gc

import pyarrow as pa

from tessera.llm import common, piece_codec


def test_a_worker_keeps_no_model_of_another_operator(model_file):
    """The tables of the codec, kept from task to task, go when another operator works, cycles and frozen objects included."""
    batches = [pa.RecordBatch.from_pydict({"x": [1, 2]}), pa.RecordBatch.from_pydict({"x": [3]})]
    piece_codec.codec(model_file).encode("some text")
    assert [b.num_rows for b in common.worker(lambda it: it, "codec")(iter(batches))] == [2, 1]
    assert piece_codec.codec.cache_info().currsize == 1
    assert [b.num_rows for b in common.worker(lambda it: it)(iter(batches))] == [2, 1]
    assert piece_codec.codec.cache_info().currsize == 0 and not [x for x in gc.get_objects() if isinstance(x, piece_codec.PieceCodec | piece_codec.State)]
    assert piece_codec.codec(model_file).encode("") == []
