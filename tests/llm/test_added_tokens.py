"""Texts that quote an added token get the ids of the library's plain call, and rows without a doc_id are kept."""

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from engram.llm import token_store
from engram.llm.tokens import Encoder

TEXTS = ["ab<|endoftext|>cd, a b", "plain words, no more.", "<|endoftext|>", "x <|ENDOFTEXT|> y <|startoftext|> \x01 z", None, "<|endoftext|> <|endoftext|>  end", "<|endof text|>"]


@pytest.mark.parametrize("name,spaced,end", [("word_bpe_49k.json", False, 49407), ("byte_bpe_50k.json", True, 50256)])
def test_added_tokens_are_single_ids(name, spaced, end):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    ids, offsets = Encoder(path, spaced).batch(pa.array(TEXTS))
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert got[2] == [end]


def test_rows_without_doc_id_are_kept(spark, tmp_path):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(3, "three words here"), (None, "nameless"), (1, "one <|endoftext|>"), (None, None), (None, "also nameless")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    for size in (8_000_000, 1):
        files = token_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/{size}", file_tokens=size)
        got = token_store.read_store(files).orderBy("start").collect()
        assert [r.doc_id for r in got] == [1, 3, None, None, None]
        assert sorted((r.doc_id or 0, bytes(r.tokens_le)) for r in got) == sorted((i or 0, ids(t)) for i, t in rows)
        assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
