"""Operator 8 on texts that hold the string of a special token, against the library as it comes."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tickflow.llm import tokens
from tickflow.llm.common import scratch_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    return [e.ids for e in Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_unmodified_library(monkeypatch):
    rng = random.Random(11)
    parts = ["a", "word", " ", "\n", "12", "中文", "<|endoftext|>", "<|", "endoftext", "|>", "'s", "’", "😀", "<|ENDOFTEXT|>", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(2000)]
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encode = tokens.Encoder(VOCABULARY, special=True).encode
    for k in range(0, len(texts), 500):
        ids, counts = encode(texts[k : k + 500])
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == library(texts[k : k + 500])


def test_token_file_of_texts_with_the_special_token(spark, make_docs):
    rows = [(1, "a <|endoftext|> b"), (2, "plain"), (3, "it's<|endoftext|>"), (4, None), (5, "<|endoftext|>")]
    want, start = [], 0
    for (i, _), ids in zip(rows, library([t or "" for _, t in rows]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert want[0][2] == 5
    path = f"{scratch_dir(spark)}/tokens-special-{uuid.uuid4().hex}"
    tokens.write_token_files(make_docs(rows), path, VOCABULARY)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_token_files(spark, path).collect()) == want
