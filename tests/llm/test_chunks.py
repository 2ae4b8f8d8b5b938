"""The table of encoded chunks: what a full table keeps, and that it gives the same ids."""

import random

import numpy as np
import pyarrow as pa
import pytest

from turnframe.llm import chunks


def test_a_full_table_keeps_what_recurs(monkeypatch):
    monkeypatch.setattr(chunks, "TABLE", 20)
    asked = []

    def encode(new):
        asked.extend(new)
        return [np.arange(len(c), dtype=np.uint32).tobytes() for c in new]

    table, common = chunks.TokenTable(encode), ["a", "bb", "", "ccc"]
    for k in range(30):
        table.trim()
        words = [*common, *(f"{k}-{i}" for i in range(6))]
        rows = table.rows_of(words)
        assert [table.ids[table.starts[r] : table.starts[r] + table.sizes[r]].tolist() for r in rows] == [list(range(len(w))) for w in words]
        assert len(table.rows) <= 20 + len(words)
    assert all(asked.count(c) == 1 for c in common)  # were encoded anew each time that the table was full
    for k in range(5):  # where most recurs, it is emptied as before
        table.trim()
        for _ in range(2):
            table.rows_of([f"all {i}" for i in range(40)])
    table.trim()
    assert not table.rows


@pytest.mark.parametrize("most", [0, 5, 60])
def test_ids_are_the_librarys_whatever_the_table_holds(monkeypatch, most):
    from tokenizers import Tokenizer

    from turnframe.llm.tokenfile import vocabulary_path

    monkeypatch.setattr(chunks, "TABLE", most)
    chunks.token_table.cache_clear()
    rng, tok = random.Random(2), Tokenizer.from_file(vocabulary_path())
    words = ["the", "and", "walks", "x1", "it's", "日本", "  two", "\n", "a-b", *(f"w{i}q" for i in range(60))]
    for _ in range(12):
        texts = [" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(8)]
        ids, n = chunks.encode_byte_level(pa.array(texts), vocabulary_path())
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    chunks.token_table.cache_clear()
