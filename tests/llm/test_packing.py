import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from claimloom.llm import packing
from claimloom.llm.packing import Encoder, Shard, pack, pack_shard


def test_units_encode_as_the_library():
    r = random.Random(3)
    abc = list("abZÉßİΣς中😀'’.,;!?0123́ \x85\x1c  \n\t\r\x0b\x0c") + [" ", "word ", " The", "'s", "<|endoftext|>", "  "]
    texts = ["", " ", "x" * 500, "ΟΔΟΣ ΣΟΦΟΣ", "Été... ÀÉ, Straße!! STRASSE<|endoftext| Thh'... a_b_ A` x<|endoftext|>", "á ́b"] + ["".join(r.choice(abc) for _ in range(r.randint(1, 400))) for _ in range(200)]
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(P.path("word_bpe_49k.json")).encode(texts)] == want


def test_bm25_scores():
    docs = [np.array(d, "<u4") for d in ([1, 1, 2], [2, 3], [3, 4, 5, 1])]
    s = Shard(docs)
    got = s.scores(np.array([1, 3]), 10)
    avg, want = 3, []
    for d in docs:
        x = 0
        for t in (1, 3):
            df = sum(t in e for e in docs)
            tf = list(d).count(t)
            x += np.log1p((3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        want.append(x)
    assert np.allclose(got, want, atol=1e-5)


def test_every_id_once_and_only_powers_of_two_are_short():
    r = random.Random(1)
    for _ in range(60):
        docs = [np.array([r.randint(0, 30) for _ in range(r.choice([1, 2, 7, 40, 200]))], "<u4") for _ in range(r.randint(1, 60))]
        seen = defaultdict(list)
        for seq in pack_shard(docs, 64, 5):
            n = sum(x[2] for x in seq)
            assert n == 64 or n & (n - 1) == 0
            for i, at, k in seq:
                seen[i].append((at, k))
        for i, d in enumerate(docs):
            at = 0
            for start, k in sorted(seen[i]):
                assert start == at and k > 0
                at += k
            assert at == len(d)


def test_neighbours_share_a_window():
    a, b = [np.array([w] * 3 + list(range(100 * w, 100 * w + 29)), "<u4") for w in (1, 2)]
    first = next(iter(pack_shard([a, b, b.copy(), a.copy()], 64, 8)))
    assert [x[0] for x in first] == [0, 3]


def test_rows(spark):
    long = "w1 " * 9000
    rows = [(1, "a b", 7), (1, "a b", 7), (2, None, 1), (None, "", 2), (3, long, 3)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").coalesce(1)).collect()
    assert sum(x.length for x in got) == sum(len(Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(t or "").ids) + 1 for _, t, _ in rows)
    by = defaultdict(list)
    for x in got:
        assert len(x.ids) == 4 * x.length
        by[x.sequence_id].append((x.offset, x.length))
    for seq in by.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    whole = b"".join(x.ids for x in sorted((x for x in got if x.doc_id == 3), key=lambda x: x.start))
    assert zlib.crc32(whole[-4:]) == zlib.crc32(np.array([2], "<u4").tobytes())
    assert packing.pack(spark.createDataFrame(rows[:1], "doc_id long, text string, n int"), window=2).count() == 2


def test_all_terms_of_a_seed_count(spark):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    words = [w for w in sorted(lib.get_vocab()) if w.isascii() and w.isalpha() and w.islower() and len(w) > 3 and len(lib.encode(w, add_special_tokens=False).ids) == 1][:280]
    own, shared = words[:20], words[20:40]
    others = [" ".join(words[40 * j : 40 * j + 40]) for j in range(1, 7)]
    texts = [" ".join(own * 4 + shared), *others, " ".join(shared * 3)]  # the seed's 12 best terms are all among its own
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = pack(rows, window=512).where("sequence_id = 0").orderBy("offset").collect()
    assert [x.doc_id for x in got][:2] == [0, 7]


def test_scores_by_postings_and_by_rows():
    r = random.Random(5)
    docs = [np.array([min(int(r.paretovariate(0.4)), 900) for _ in range(r.randint(1, 120))], "<u4") for _ in range(90)]
    s, avg = Shard(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in {int(t) for d in docs for t in d}}
    assert min(df.values()) < 9 < max(df.values())  # both ways are used
    for q in docs[:20]:
        want = [sum(np.log1p((90 - df[t] + 0.5) / (df[t] + 0.5)) * (n := int((d == t).sum())) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / avg)) for t in {int(t) for t in q}) for d in docs]
        assert np.allclose(s.scores(q), want, rtol=1e-4)


def plain_packer(docs, window):
    """Sequences as pack_shard() says, from whole rankings."""
    pieces = [(i, at, min(window, len(d) - at)) for i, d in enumerate(docs) for at in range(0, len(d), window)]
    out, rest = [[p] for p in pieces if p[2] == window], [p for p in pieces if p[2] < window]
    if not rest:
        return out
    index, unused = Shard([docs[i][at:] for i, at, _ in rest]), list(range(len(rest)))
    seed, begun = unused.pop(0), 0
    while True:
        i, at, n = rest[seed]
        now, room, cut = [(i, at + begun, n - begun)], window - (n - begun), None
        score = index.scores(docs[i][at:])
        for j in sorted(unused, key=lambda j: (-score[j], j)):
            if not room:
                break
            take = min(room, rest[j][2])
            now.append((rest[j][0], rest[j][1], take))
            unused.remove(j)
            room -= take
            cut = (j, take) if take < rest[j][2] else None
        if room:
            break
        out.append(now)
        if cut:
            seed, begun = cut
        elif unused:
            seed, begun = unused.pop(0), 0
        else:
            return out
    ids = [(i, at + k) for i, at, n in now for k in range(n)]
    while ids:
        take = 1 << (len(ids).bit_length() - 1)
        own, ids = ids[:take], ids[take:]
        seq = []
        for i, at in own:
            if seq and seq[-1][0] == i and seq[-1][1] + seq[-1][2] == at:
                seq[-1] = (i, seq[-1][1], seq[-1][2] + 1)
            else:
                seq.append((i, at, 1))
        out.append(seq)
    return out


def test_greedy_choice_against_a_plain_packer():
    r = random.Random(12)
    for _ in range(60):
        topics = [[r.randint(0, 60) for _ in range(25)] for _ in range(5)]
        docs = [np.array([r.choice(t) for _ in range(r.choice([1, 3, 20, 40, 150]))], "<u4") for t in (r.choice(topics) for _ in range(r.randint(1, 90)))]
        want, got = plain_packer(docs, 64), list(pack_shard(docs, 64))
        assert sorted(want) == sorted([tuple(map(int, x)) for x in seq] for seq in got)
