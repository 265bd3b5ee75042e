import math
import random
import zlib

import numpy as np

from claimloom.llm.langid import UND, Model, Moves, automaton, language_id, sample


def brute(text: str, known: str) -> int:
    """Phrases of a text: a new one begins where text[begin:i] is no substring of known; unknown letters count once more."""
    n, begin = 0, 0
    for i in range(len(text)):
        if i == 0 or text[begin : i + 1] not in known:
            n, begin = n + 1, i if text[i] in known else i + 1
            if i == 0 and text[0] not in known:
                begin = 1
    return n + sum(c not in known for c in text)


def test_automaton_holds_exactly_the_substrings():
    r = random.Random(2)
    for _ in range(30):
        s = [r.randint(0, 2) for _ in range(r.randint(1, 25))]
        t = automaton(s)
        m = Moves(t, 5)
        subs = {tuple(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)}
        for _ in range(200):
            x = [r.randint(0, 2) for _ in range(r.randint(1, 6))]
            at, ends = 0, False
            for c in x:
                to, miss = m.step(np.array([at]), np.array([c]))
                assert bool(miss[0]) == (c not in t[at]) and to[0] == t[0 if miss[0] else at].get(c, 0)
                at, ends = int(to[0]), ends or bool(miss[0])
                if ends:
                    break
            assert ends != (tuple(x) in subs)


def test_phrases_against_brute_force():
    r = random.Random(4)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(1, 6)))
    samples = {"x": " ".join(word("abc") for _ in range(60)), "y": " ".join(word("bcd") for _ in range(60))}
    m = Model(samples)
    texts = [" ".join(word("abcdé") for _ in range(r.randint(1, 40))) for _ in range(60)] + ["a", ""]
    texts += [samples["x"] * 3, "a" * 500, "abcab" * 90, "b c" * 200]
    for piece, most in ((10_000, 1 << 21), (7, 1 << 21), (5, 33), (64, 100)):
        got = m.phrases([m.symbols(x) for x in texts], piece, most)
        for x, row in zip(texts, got, strict=True):
            for k, lang in enumerate(m.langs):
                assert row[k] == brute(x, samples[lang]), (x, lang)


def test_predictions_against_brute_force():
    """From phrases to lang_pred and score, by substring search alone."""
    r = random.Random(5)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(1, 6)))
    samples = {k: " ".join(word(a) for _ in range(n)) for k, a, n in (("b", "abcd", 300), ("a", "bcde", 200), ("c", "abcd", 40))}
    m = Model(samples, least=64)
    texts = [" ".join(word("abcdeé") for _ in range(r.randint(1, 60))) for _ in range(60)] + ["", "12", "é"]
    for x, (lang, score) in zip(texts, m.predict(texts), strict=True):
        plain = m.symbols(x)
        if not len(plain):
            assert (lang, score) == (UND, 0.0)
            continue
        cost = sorted((brute(x, samples[k]) * math.log2(max(len(samples[k]), 64)), k) for k in samples)
        assert lang == cost[0][1] and abs(score - (1 - cost[0][0] / cost[1][0])) < 1e-9


def test_every_letter_and_language_counts(spark):
    """A script of thousands of letters, and 200 languages in alphabets of their own."""
    r = random.Random(6)
    han = [chr(0x4E00 + i) for i in range(3000)]
    two = {"h1": han[:2000], "h2": han[1000:]}
    text = lambda a: "".join(r.choice(a) for _ in range(r.randint(30, 60)))
    m = Model({k: text(a * 1) + "".join(r.sample(a, len(a))) for k, a in two.items()})
    assert m.width > 3000 and (m.symbols("".join(han)) > 1).all()
    assert m.predict(["".join(han[:300]), "".join(han[-300:])])[0][0] == "h1" and m.predict(["".join(han[-300:])])[0][0] == "h2"
    own = {f"l{k:03}": [chr(0xAC00 + 40 * k + i) for i in range(20)] for k in range(200)}
    rows = [(1000 * k + i, text(a), lang) for k, (lang, a) in enumerate(own.items()) for i in range(6)]
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert len(got) == 1200 and all(x.lang_pred == want[x.doc_id] for x in got)


def test_samples_are_whole_texts(spark):
    rows = [(i, f"word{i} " * (10 if i % 3 else 20_000), "aa" if i < 60 else "bb") for i in range(64)]
    got = sample(spark.createDataFrame(rows + rows, "doc_id long, text string, lang string"), rows=5, chars=500)
    texts = {t: lang for _, t, lang in rows}
    whole = [t for t in texts if t in got[texts[t]]]
    assert set(got) == {"aa", "bb"} and sum(len(t) for t in whole) + len(whole) - 2 == sum(map(len, got.values())) and len(got["aa"]) <= 504
    only = sample(spark.createDataFrame([(1, "long " * 5000, "zz")], "doc_id long, text string, lang string"), rows=5, chars=500)
    assert only in ({}, {"zz": "long " * 5000})


def test_symbols():
    m = Model({"x": "ab é"})
    assert m.symbols("  A--b!!  É 1").tolist() == m.symbols("a b é").tolist()
    assert m.symbols("1 2 !").tolist() == []


def test_rows(spark):
    rows = [(i, "the cat and the dog sat on the mat " * 3, "en", "s") for i in range(40)]
    rows += [(100 + i, "der hund und die katze auf dem dach " * 3, "de", "s") for i in range(40)]
    odd = [(500, None, "en", "s"), (501, "12 !", None, "s"), (502, "", "de", None), (None, "und die katze", "de", "s"), (503, "DER HUND " * 30_000, None, None), (503, "DER HUND " * 30_000, None, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = language_id(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "en" and by[100 + i].lang_pred == "de" for i in range(40))
    assert all((by[i].lang_pred, by[i].score) == (UND, 0.0) for i in (500, 501, 502))
    assert by[503].lang_pred == by[None].lang_pred == "de" and not by[None].held_out
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert language_id(df.limit(0)).count() == 0
    one = language_id(spark.createDataFrame([(i, "abc", "xx") for i in range(9)], "doc_id long, text string, lang string")).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("xx", 1.0)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
