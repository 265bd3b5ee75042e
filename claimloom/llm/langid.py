"""Language identification by cross-parsing entropy against suffix automata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.common import table, worker_cache

UND = "und"
#: Symbols of a text: 0 parts words (whatever is no letter), 1 is a letter that no sample holds, others are letters in lower case.
GAP, UNKNOWN = 0, 1
LAST = 0x110000


def _letters() -> np.ndarray:
    """For each code point: its lower case (one code point), or 0 where it is no letter."""
    out = np.zeros(LAST, np.int32)
    for c in range(LAST):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text, by state; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Moves:
    """Transitions in three arrays: that of state s by symbol c lies at base[s] + c, if owner says s there. A state's row is laid over
    the gaps of others, so the arrays grow with the transitions, whatever the alphabet."""

    def __init__(self, rows: list[dict[int, int]], width: int):
        size = [len(r) for r in rows]
        used = bytearray(sum(size) * 2 + 4 * width + 64)
        base, low = np.zeros(len(rows), np.int32), width  # the first slot that may be free, after room for bases that would be negative
        for s in sorted((s for s, n in enumerate(size) if n > 1), key=lambda s: -size[s]):
            cs, tries = sorted(rows[s]), 0
            first, at = cs[0], low
            while True:
                at = used.find(0, at)
                if at < 0 or at + width >= len(used):
                    used.extend(bytes(len(used)))
                    at = used.find(0, low)
                    continue
                b = at - first
                if not any(used[b + c] for c in cs):
                    break
                at, tries = at + 1, tries + 1
            base[s] = b
            for c in cs:
                used[b + c] = 1
            if tries > 40:
                low += (at - low) // 2 + 1  # what is left behind is for the rows of one transition
        single = np.array([s for s, n in enumerate(size) if n == 1], np.int64)
        free = np.flatnonzero(np.frombuffer(used, np.uint8)[width:] == 0)[: len(single)] + width
        if len(free) < len(single):
            free = np.concatenate([free, len(used) + np.arange(len(single) - len(free))])
        base[single] = free - np.array([next(iter(rows[s])) for s in single.tolist()], np.int64)
        of = np.repeat(np.arange(len(rows)), size)
        c = np.fromiter((c for r in rows for c in r), np.int64, len(of))
        at = base[of] + c
        room = int(max(at.max(initial=0), base.max(initial=0)) + width + 1)
        self.base, self.owner, self.to = base, np.full(room, -1, np.int32), np.zeros(room, np.int32)
        self.owner[at], self.to[at] = of, np.fromiter((t for r in rows for t in r.values()), np.int32, len(of))
        self.root = np.zeros(width, np.int32)  # where a phrase that begins with a symbol stands; 0 if the sample doesn't hold it
        for c, t in rows[0].items():
            self.root[c] = t

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where the match ended, so that a phrase begins with this symbol."""
        at = self.base[state] + c
        hit = self.owner[at] == state
        return np.where(hit, self.to[at], self.root[c]), ~hit


class Model:
    """A suffix automaton per language over all letters of the samples. A phrase of a sample of n symbols costs log2(n) bits; samples
    of fewer than `least` symbols are taken as of that size, for else the smallest sample would have the cheapest phrases."""

    def __init__(self, samples: dict[str, str], least: int = 4096):
        fold = _letters()
        code = lambda x: fold[np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)]
        kept = [np.unique(code(x)) for x in samples.values()]
        kept = np.unique(np.concatenate(kept or [np.zeros(0, np.int32)]))
        kept = kept[kept > 0]
        self.width = len(kept) + 2
        place = np.full(LAST, UNKNOWN, np.int32)
        place[kept] = np.arange(2, self.width)
        self.symbol = np.where(fold > 0, place[fold], GAP).astype(np.int32)
        self.langs, self.moves, self.bits = [], [], []
        for k in sorted(samples):
            s = self.symbols(samples[k])
            if len(s):
                self.langs.append(k)
                self.moves.append(Moves(automaton(s.tolist()), self.width))
                self.bits.append(np.log2(max(len(s), least)))

    def symbols(self, text: str) -> np.ndarray:
        """Symbols with runs of gaps as one, and none at the ends."""
        s = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = s == GAP
        s = s[~(gap & np.concatenate([[True], gap[:-1]]))]
        return s[:-1] if len(s) and s[-1] == GAP else s

    def phrases(self, texts: list[np.ndarray], piece: int = 512, most: int = 1 << 21) -> np.ndarray:
        """Phrases that each text falls into, by language: each the longest match from where the last one ended; a symbol that the
        sample doesn't hold begins a phrase, is no part of a match and counts for one phrase more. Memory holds about `most` symbols' states."""
        out = np.zeros((len(texts), len(self.langs)))
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= most):
                size += len(texts[hi])
                hi += 1
            for lang, m in enumerate(self.moves):
                state = np.zeros(hi - lo, np.int32)
                for at in range(0, max(size, 1), most):  # more than one turn only for a single text
                    part = [t[at : at + most] for t in texts[lo:hi]]
                    n, state = self._parse(m, part, state, piece)
                    if not at:
                        n += [len(t) > 0 and m.root[t[0]] > 0 for t in part]  # the first phrase, unless a symbol unheard of begins it
                    n += [np.count_nonzero(m.root[t] == 0) for t in part]
                    out[lo:hi, lang] += n
            lo = hi
        return out

    @staticmethod
    def _parse(m: Moves, texts: list[np.ndarray], start: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases begin after the first, and the last state, of texts that are parsed from given states.

        All pieces of all texts are parsed side by side, a symbol at a time, as if each began at the root. Then each is parsed again from
        the state in which the piece before it ends, until it comes to a state that it had: the rest is as it was. That is
        done until no piece ends otherwise than the next one began, so the result is that of parsing from end to end."""
        size = np.array([len(t) for t in texts])
        pieces = -(-size // piece)
        own = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        flat = np.concatenate(texts)
        lo = np.repeat(np.cumsum(size) - size, pieces) + nth * piece
        n = np.minimum(piece, np.repeat(size, pieces) - nth * piece)
        begun = np.where(nth == 0, start[own], 0)
        count, end = np.zeros(len(own), np.int64), begun.copy()
        order = np.argsort(-n, kind="stable")
        seen = np.zeros((int(n.max(initial=0)), len(own)), np.int32)  # states by step; ~state where a phrase began
        alive, state = order, begun[order]
        for j in range(len(seen)):
            k = np.searchsorted(-n[alive], -j, side="left")
            alive, state = alive[:k], state[:k]
            state, miss = m.step(state, flat[lo[alive] + j])
            count[alive] += miss
            seen[j, alive] = np.where(miss, ~state, state)
            end[alive] = state
        later = np.flatnonzero(nth > 0)
        for turn in range(1 << 62):
            wrong = later[end[later - 1] != begun[later]]
            if not len(wrong):
                break
            if turn >= 4:  # a chain of pieces that depend on each other: one after another
                wrong = wrong[:1]
            begun[wrong] = end[wrong - 1]
            state, j = begun[wrong], 0
            while len(wrong):
                state, miss = m.step(state, flat[lo[wrong] + j])
                old = seen[j, wrong]
                count[wrong] += miss.astype(np.int64) - (old < 0)
                seen[j, wrong] = np.where(miss, ~state, state)
                j += 1
                on = state != np.where(old < 0, ~old, old)
                last = on & (n[wrong] == j)
                end[wrong[last]] = state[last]
                on &= ~last
                wrong, state = wrong[on], state[on]
        total = np.bincount(own, count, len(texts))
        final = start.copy()
        final[size > 0] = end[np.cumsum(pieces)[size > 0] - 1]
        return total, final

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        rows = [self.symbols(x or "") for x in texts]
        if not self.langs:
            return [(UND, 0.0)] * len(texts)
        cost = self.phrases(rows) * np.array(self.bits)
        out = []
        for c, s in zip(cost, rows, strict=True):
            if not len(s):
                out.append((UND, 0.0))
                continue
            best = int(c.argmin())
            rest = np.delete(c, best)
            out.append((self.langs[best], float(1 - c[best] / rest.min()) if len(rest) else 1.0))
        return out


def bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def sample(docs: DataFrame, rows: int = 96, chars: int = 60_000, usual: int = 2000) -> dict[str, str]:
    """Labelled text of every language: whole texts of at most `rows` documents, none held out, in the order of a hash of their ids, those
    of more than `usual` characters after all others and by length; of these as many as have `chars` characters together, and
    one at least. So what the driver gets of a language is bounded by that or its shortest text."""
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (bucket(F.col("doc_id")) != 2))
    fit = fit.select("doc_id", "lang", "text").where(F.col("text").rlike(r"\p{L}"))
    pick = fit.select("doc_id", "lang", F.char_length("text").alias("n"), F.greatest(F.char_length("text"), F.lit(usual)).alias("late"), F.xxhash64("doc_id").alias("h"))
    w = Window.partitionBy("lang").orderBy("late", "h", "doc_id")
    first = pick.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= rows)
    chosen = first.withColumn("total", F.sum("n").over(w)).where((F.col("rn") == 1) | (F.col("total") <= chars)).select("doc_id", "lang").distinct()
    got = fit.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min(F.struct(F.char_length("text"), "text"))["text"].alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.lang, zlib.crc32(str(r.doc_id).encode()), r.text)):
        out.setdefault(r.lang, []).append(r.text)
    return {k: " ".join(v) for k, v in out.items()}


def language_id(docs: DataFrame, rows: int = 96, chars: int = 60_000, keep: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every whole text; narrow, with the samples as a broadcast.

    Every language has a sample (see sample(): whole texts of at most `rows` documents and, but for the first, `chars` characters), which
    becomes a suffix automaton. A text's letters in lower case, with gaps between words, are cut into phrases, each the longest match with
    the sample from where the last ended (a letter that the sample doesn't hold counts twice); phrases times log2 of the sample's length are the text's cost in that language, and the
    least cost wins (ties: the first name). score is how far the cost lies under the second's, from 0 to 1; 1 where one
    language is known. Every letter of every sample has a symbol of its own; a worker holds about 2 MB for each language.

    lang_pred is `und`, score 0, if the text is null or has no letter, or no language can be learnt. Rows that repeat have each
    their row, null doc_ids too (held_out false); an empty table gives none. lang, source and other columns are no inputs of predictions;
    with keep, the columns of docs stand beside lang_pred and score (which replace any of those names) in place of doc_id and held_out.
    """
    spark = docs.sparkSession
    learnt = spark.sparkContext.broadcast(sample(docs, rows, chars))
    first = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep else ["doc_id", "held_out"]
    own = docs.select(*first) if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(bucket(F.col("doc_id").cast("long")) == 2, F.lit(False)).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache("langid")
        key = str(hash(tuple(sorted(learnt.value.items()))))
        if key not in kept:
            kept.clear()
            kept[key] = Model(learnt.value)
        m = kept[key]
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                lang, score = zip(*m.predict(part["text"].to_pylist()), strict=True)
                yield pa.record_batch([*(part[c] for c in first), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*first, "lang_pred", "score"])

    out = T.StructType([own.schema[c] for c in first]).add("lang_pred", "string").add("score", "double")
    return own.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
