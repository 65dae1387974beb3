import numpy as np
import pyarrow as pa

from marketframe.llm import packing, quality
from marketframe.llm.common import slices


class Seen:
    """Stands for a table: keeps what a task would run."""

    def select(self, *cols):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_slices_are_all_rows_in_order():
    rows = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": ["x" * 100] * 50})
    parts = list(slices(rows, 500))
    assert len(parts) > 5 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([rows]))
    assert [p.to_pylist() for p in slices(pa.array(["a" * 9000, ""]), 10)] == [["a" * 9000], [""]]
    assert list(slices(pa.array([], pa.string()))) == []


def test_pieces_are_made_some_texts_at_a_time(spark):
    text = "some words here. " * 4000
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": [text] * 100})
    seen = Seen()
    packing.pieces(seen, packing.tokenizer_path("byte_bpe_50k.json"), keep_ids=True)
    made = list(seen.run(iter([whole])))
    assert len(made) > 2 and len({d for b in made for d in b.column(0).to_pylist()}) == 100


def test_pooled_from_arrow_as_from_texts():
    texts = [f"Word{i % 90} w{i % 7}! é{i % 53} " * (i % 40) for i in range(20000)]
    vectors = quality.WordVectors(np.ones((quality.SLOTS, quality.DIMS + 1)))
    assert np.array_equal(vectors.pool(pa.array(texts)), vectors.pool(texts))
    assert vectors.pool(pa.array([], pa.string())).shape == (0, 2 * quality.DIMS + 1)
