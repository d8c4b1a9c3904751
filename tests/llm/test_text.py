import random

import numpy as np
import pyarrow as pa

from ashlar.llm import _text


def test_words_as_the_contract_splits_them():
    random.seed(1)
    texts = ["".join(random.choice(["a", "B", "é", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", " ", "日本"]) for _ in range(random.randint(0, 60))) for _ in range(300)] + ["", None, " ", "x"]
    hashes, counts = _text.word_hashes(pa.array(texts))
    words = [(t or "").encode().lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for own in words for w in own]
    assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist(), strict=True)))


def test_slices_and_empty_columns():
    column = pa.array(["a b", "c", "d e f"])
    whole, _ = _text.word_hashes(column)
    part, counts = _text.word_hashes(column.slice(1, 2))
    assert counts.tolist() == [1, 3] and part.tolist() == whole[2:].tolist()
    assert _text.word_hashes(pa.array([], pa.string()))[0].tolist() == []
    assert _text.word_hashes(pa.array(["", None]))[1].tolist() == [0, 0]


def test_batches_bound_bytes_but_take_a_row_at_least():
    batch = pa.record_batch({"text": ["x" * 10, "y" * 100, "", "z" * 5, None]})
    cut = list(_text.batches(iter([batch]), "text", 20))
    assert [b.num_rows for b in cut] == [1, 1, 3] or sum(b.num_rows for b in cut) == 5
    assert pa.Table.from_batches(cut).to_pydict() == batch.to_pydict()
    assert np.array_equal(_text.mix(np.array([1, 2], np.uint64)), _text.mix(np.array([1, 2], np.uint64)))
