"""Token files hold the ids that the tokenizers library gives by default, added tokens included."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from decklens.llm import token_files


def test_texts_with_added_tokens(spark):
    texts = ["a<|endoftext|>b", "one two, three.\nfour", "x <|endoftext|> y  z\n<|endoftext|>", "<|endoftext|", "<|endoftext|>", "", "two <|end of text|> three"]
    untouched = Tokenizer.from_file(token_files.TOKENIZER)
    got = token_files.stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crc=True).orderBy("doc_id").collect()
    start = 0
    for r, text in zip(got, texts, strict=True):
        ids = [*untouched.encode(text, add_special_tokens=False).ids, token_files.END_ID]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got[0].ids[:3] == [64, 50256, 65]
