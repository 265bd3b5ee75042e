import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import tiktoken

from claimloom.llm.bpe import Codec, bpe_codes


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(9)
    abc = list("abcdeéßÑ中の😀'’.,;!?0123  \n\t\r\x0b\x1c\x85  <|>") + [" the", "'s", "<|endoftext|>", "\n\n", "   ", "ing", "tion"]
    out = ["", " ", "it's 'sa", "<|endoftext|>", "a" * 300, "abab" * 60, " " * 50, "the " * 500]
    return out + ["".join(r.choice(abc) for _ in range(r.randint(1, 300))) for _ in range(120)]


def test_as_the_library():
    lib, own = library(), texts()
    c = Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for block in (1 << 18, 7):
        for x, (text, ids, back) in zip(own, c.documents(own, block), strict=True):
            want = lib.encode_ordinary(x)
            assert text == ",".join(map(str, want)).encode() and ids.tolist() == want and b"".join(back) == x.encode()
            assert len(back) == -(-len(want) // block)
    rows = [[], lib.encode_ordinary("héllo wörld"), [255, 0, 255]]
    assert c.decode([np.array(x, np.int32) for x in rows]) == [lib.decode_bytes(x) for x in rows]


def test_long_words_by_pieces():
    lib, r = library(), random.Random(3)
    c = Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, piece=16)
    assert c.plain
    words = [x * n for x in ("a", "ab", "abc", "the", "intention", "é", "中文") for n in (17, 100, 333)]
    words += ["".join(r.choice(abc) for _ in range(r.randint(17, 900))) for abc in ("acgt", "ab", "aaaab", "etaoinshrdlu", "éàüxyz", "abcdefghijklmnopqrstuvwxyz") for _ in range(25)]
    for w in words:
        assert np.frombuffer(c.encode_words([w.encode()])[0], np.int32).tolist() == lib._encode_single_piece(w.encode()), w


def test_very_long_words_take_time_in_proportion():
    lib, r = library(), random.Random(4)
    c = Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for w in ("".join(r.choice("acgt") for _ in range(200_000)), "abc" * 70_000, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))):
        began = time.time()
        assert np.frombuffer(c.encode_words([w.encode()])[0], np.int32).tolist() == lib._encode_single_piece(w.encode())
        assert time.time() - began < 60


def test_a_vocabulary_whose_tokens_need_later_ones():
    c = Codec.__new__(Codec)
    c.ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257}
    assert len(c._before(b"abc")) == 3 and c._before(b"bc") == [b"b", b"c"]


def test_rows(spark):
    lib = library()
    own = [(1, "a b", 7), (1, "a b", 7), (2, None, 1), (None, "", 2), (3, "wörd one " * 30_000, 3)]
    df = spark.createDataFrame(own, "doc_id long, text string, ids int")
    for r in bpe_codes(df).collect():
        t = {x[0]: x[1] or "" for x in own}[r.doc_id]
        assert r.ids == lib.encode_ordinary(t) and r.n_tokens == len(r.ids) and r.decoded == t.encode()
    for r in bpe_codes(df, digests=True).collect():
        t = {x[0]: x[1] or "" for x in own}[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, lib.encode_ordinary(t))).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe_codes(df).count() == len(own) and bpe_codes(df.limit(0)).count() == 0
