import zlib

import pytest
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark):
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def encode():
    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="session")
def edges():
    """Nulls, blanks, ties, repeats and a long text, as (doc_id, text)."""
    return [(1, None), (2, ""), (3, " \n\t"), (4, "One two three, four!! five."), (4, "One two three, four!! five."), (5, "one  two three,four!! five."), (6, "é" * 3000), (7, "word " * 5000), (None, "One two three, four!! five.")]


@pytest.fixture(scope="session")
def crc():
    return zlib.crc32
