from __future__ import annotations

import numpy as np

from skytab.llm import tokens

NAME = "byte_bpe_50k"
TEXTS = ["<|endoftext|>", "Hello world <|endoftext|>  x\n\n y", "a<|endoftext|><|endoftext|>b.", " <|endoftext|> <|endoftext", "no such token", ""]


def _json_ids(text: str) -> list[int]:
    import public_tokenizers
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path(f"{NAME}.json")).encode(text, add_special_tokens=False).ids, 0]


def test_ids_equal_the_json_form_at_its_defaults():
    for text in TEXTS:
        assert tokens.token_ids(text, NAME).tolist() == _json_ids(text)
    assert tokens.token_ids(None, NAME).tolist() == [0]
    assert tokens.sentence_ends(NAME)[50256]


def test_operators_emit_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    packed = {}
    for r in tokens.pack_documents(docs).orderBy("doc_id", "start").collect():
        packed[r.doc_id] = packed.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    assert packed == {k: _json_ids(t) for k, t in enumerate(TEXTS)}
