"""op3's ids against tokenizers where the rank file alone differs or fails."""

import zlib

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from daybook.llm import packing

E = "<|endoftext|>"
TEXTS = [
    f"a {E} b", E, E + E, f"{E} a\n{E}\n\nb  {E}", f"x{E}y <|endoftext| >{E[:-1]}", f"<|{E}|>", f" {E} é {E}",
    " " * 2_000_000 + "a", "a" + "\n" * 2_000_000 + f"b{E} c", " " * 500_000 + " b", "a " * 10_000 + " " * packing.RUN, " " * (packing.RUN - 1) + "a" * 5,
]


@pytest.fixture(scope="module")
def want():
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_added_token_and_long_runs(want):
    encode = packing.encoder(packing.tokenizer_path())
    assert [list(encode(t)) for t in TEXTS] == want


def test_packing_of_added_token_and_long_runs(spark, want):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = packing.op3(docs.repartition(2)).collect()
    for i, ids in enumerate(want):
        ids = [*ids, packing.END]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
