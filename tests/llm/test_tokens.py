import random

import public_tokenizers as P
from tokenizers import Tokenizer

from claimloom.llm.tokens import Counter, token_counts


def texts():
    r = random.Random(5)
    abc = list("abcdeéßÑ中の😀'’.,;!?0123  \n\t\r\x0b\x1c  <|>") + [" ", " ", "word", " the", "'s", "<|endoftext|>", "\n\n", "   "]
    out = ["", " ", "a", "a  b", " lead", "trail ", "x\n y", "it's 'sa", "<|endoftext|>", "a<|endoftext|> b", "y" * 3000, " " * 700, "a " * 900, "1 2  3 \n 4"]
    return out + ["".join(r.choice(abc) for _ in range(r.randint(1, 900))) for _ in range(150)]


def test_counts_as_the_library_in_units_and_chunks():
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = texts()
    want = [len(e.ids) for e in lib.encode_batch(own, add_special_tokens=False)]
    for chunk, overlap in ((32_768, 256), (64, 4), (17, 1), (200, 150)):
        assert Counter(P.path("byte_bpe_50k.json"), chunk, overlap).counts(own) == want, (chunk, overlap)


def test_rows(spark):
    rows = [(1, "a b", 7), (1, "a b", 7), (2, None, 1), (None, "", 2), (3, "w " * 40_000, 3)]
    df = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"))
    got = sorted(df.collect(), key=str)
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = len(lib.encode("w " * 40_000).ids)
    assert sorted(map(tuple, got), key=str) == sorted([(1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False), (None, 0, 0, False), (3, 80_000, n, True)], key=str)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
