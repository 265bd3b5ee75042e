"""Byte-level BPE encoding and decoding by recursive SQL, a DuckDB for each Python worker."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import table, tokenizer_path, worker_cache

#: Token-position rows of the words at hand, contracted until no pair of a word is in the merge table. Each turn joins the rows with
#: their right neighbours to the merge table, takes each word's leftmost pair of least rank, and writes the merged token over its
#: left place; words without a pair leave the recursion with `done`.
CONTRACT = """
WITH RECURSIVE bpe(g, w, pos, tok, done) AS (
    SELECT g, w, pos, tok, false FROM first
  UNION ALL (
    WITH pairs AS (
      SELECT g, w, pos, tok, CASE WHEN lead(w) OVER o = w THEN lead(tok) OVER o END AS ntok, lag(g) OVER o AS pg FROM bpe WHERE NOT done WINDOW o AS (ORDER BY g)),
    best AS (
      SELECT p.w, min(m.rank * 2147483648::BIGINT + p.pos) AS key, arg_min(p.g, m.rank * 2147483648::BIGINT + p.pos) AS at
      FROM pairs p JOIN merges m ON m.a = p.tok AND m.b = p.ntok GROUP BY p.w)
    SELECT p.g, p.w, p.pos, CASE WHEN p.g = b.at THEN (b.key // 2147483648)::INTEGER ELSE p.tok END, b.key IS NULL
    FROM pairs p LEFT JOIN best b ON b.w = p.w WHERE b.key IS NULL OR p.pg IS DISTINCT FROM b.at)
)
SELECT w, list(tok ORDER BY g) AS ids FROM bpe WHERE done GROUP BY w ORDER BY w
"""
#: The same for long rows of letters, where a turn contracts every pair of least rank, in the order from the left: of pairs that
#: overlap in a run the first, third and so on. No pair that a merge makes has a lower rank than the merge, so the order is the same.
CONTRACT_RUNS = """
WITH RECURSIVE bpe(w, pos, tok, done) AS (
    SELECT w, pos, tok, false FROM first
  UNION ALL (
    WITH pairs AS (
      SELECT w, pos, tok, lead(tok) OVER o AS ntok, row_number() OVER o AS i FROM bpe WHERE NOT done WINDOW o AS (PARTITION BY w ORDER BY pos)),
    ranked AS (
      SELECT p.*, m.rank, min(m.rank) OVER (PARTITION BY p.w) AS least FROM pairs p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.ntok),
    hits AS (SELECT *, coalesce(rank = least, false) AS hit FROM ranked),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY w, hit ORDER BY i) AS run FROM hits),
    chosen AS (SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, run ORDER BY i) % 2 = 1 AS taken FROM runs),
    marked AS (SELECT *, lag(taken) OVER (PARTITION BY w ORDER BY i) AS gone FROM chosen)
    SELECT w, pos, CASE WHEN taken THEN rank ELSE tok END, least IS NULL FROM marked WHERE gone IS NOT TRUE)
)
SELECT w, list(tok ORDER BY pos) AS ids FROM bpe WHERE done GROUP BY w ORDER BY w
"""
DECODE = "SELECT c.row, list(v.bytes ORDER BY c.pos) AS parts FROM coded c JOIN vocab v ON v.id = c.id GROUP BY c.row"


class Codec:
    """A vocabulary of ranks in DuckDB: vocab(id, bytes), merges(a, b, rank). A token's id is its rank."""

    def __init__(self, path: str, pattern: str, kept: int = 450_000, short: int = 48, piece: int = 256):
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        rows = [x.split() for x in open(path, "rb") if x.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.token = {r: t for t, r in self.ranks.items()}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False, "temp_directory": ""})
        parts = {t: self._before(t) for t in self.ranks if len(t) > 1}
        # every token comes from one pair of tokens of lower rank: then only these pairs ever meet, and words can be cut (see _long)
        self.plain = all(len(x) == 2 for x in parts.values())
        if self.plain:
            pairs = [(*x, t) for t, x in parts.items()]
        else:
            pairs = [(t[:i], t[i:], t) for t in parts for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, r = (pa.array([self.ranks[x] for x in c], pa.int32()) for c in zip(*pairs, strict=True))
        self._put("merges", pa.table({"a": a, "b": b, "rank": r}))
        self._put("vocab", pa.table({"id": pa.array(list(self.token), pa.int32()), "bytes": pa.array(list(self.token.values()), pa.binary())}))
        self.raw = {t: np.int32(r).tobytes() for t, r in self.ranks.items()}
        self.decimal = np.array([b"%d," % i if i in self.token else b"" for i in range(max(self.token) + 1)])
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.meet: dict[tuple[int, int], bool] = {}
        self.kept, self.short, self.piece = kept, short, piece

    def _before(self, token: bytes) -> list[bytes]:
        """What a token's bytes are merged to by ranks under its own."""
        parts, own = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(x + y, own), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= own:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _put(self, name: str, t: pa.Table) -> None:
        self.db.register("arrow_rows", t)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arrow_rows")
        self.db.unregister("arrow_rows")

    def _contract(self, words: list[bytes], sql: str) -> list[bytes]:
        size = np.array([len(w) for w in words])
        w, total = np.repeat(np.arange(len(words), dtype=np.int32), size), int(size.sum())
        g = np.arange(total, dtype=np.int64)
        pos = g - np.repeat(np.cumsum(size) - size, size)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        self._put("first", pa.table({"g": g, "w": w, "pos": pos, "tok": tok}))
        found, out = self.db.sql(sql).to_arrow_table()["ids"], []
        for ids in found.chunks:
            raw, begin = memoryview(ids.values.buffers()[1]).cast("B"), ((ids.offsets.to_numpy() + ids.values.offset) * 4).tolist()
            out += [bytes(raw[lo:hi]) for lo, hi in zip(begin, begin[1:], strict=False)]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (32 bits each), as the merge table gives them; a word that is a token is that token."""
        out: list = [self.raw.get(w, b"") for w in words]
        todo = [i for i, x in enumerate(out) if not x and words[i]]
        long = [i for i in todo if self.plain and len(words[i]) > self.piece]
        if len(long) < len(todo):
            todo = [i for i in todo if not (self.plain and len(words[i]) > self.piece)]
            for i, ids in zip(todo, self._contract([words[i] for i in todo], CONTRACT), strict=True):
                out[i] = ids
        for i in long:
            out[i] = self._long(words[i])
        return out

    def _meets(self, pairs: set[tuple[int, int]]) -> None:
        """Learns which pairs of tokens stay as they are when they stand side by side."""
        new = [p for p in pairs if p not in self.meet]
        if len(self.meet) + len(new) > 500_000:
            self.meet.clear()
            new = list(pairs)
        if new:
            found = self._contract([self.token[a] + self.token[b] for a, b in new], CONTRACT)
            self.meet.update((p, ids == np.array(p, np.int32).tobytes()) for p, ids in zip(new, found, strict=True))

    def _long(self, word: bytes) -> bytes:
        """Ids of a long word, by pieces.

        The merges of a word cross a place between two tokens only if those of these two alone do: what lies further off has no part in
        it until it crosses a place itself. So tokens are the word's ids if each two neighbours stay as they are, side by side. Pieces are
        contracted together; where two don't meet, some tokens on both sides are contracted as one piece, twice as many in each turn.
        """
        ints = lambda raw: np.frombuffer(raw, np.int32).tolist()
        parts = list(map(ints, self._contract([word[i : i + self.piece] for i in range(0, len(word), self.piece)], CONTRACT_RUNS)))
        reach = 8
        while len(parts) > 1:
            seams = [(a[-1], b[0]) for a, b in zip(parts, parts[1:], strict=False)]
            self._meets(set(seams))
            if all(self.meet[p] for p in seams):
                break
            now, again = [parts[0]], []  # parts, and which of them are to be contracted
            for p, part in zip(seams, parts[1:], strict=True):
                if self.meet[p]:
                    now.append(part)
                    continue
                if again and again[-1] == len(now) - 1:  # the left one is to be contracted anyway
                    now[-1] = now[-1] + part[:reach]
                else:
                    last = now.pop()
                    if last[:-reach]:
                        now.append(last[:-reach])
                    now.append(last[-reach:] + part[:reach])
                    again.append(len(now) - 1)
                if part[reach:]:
                    now.append(part[reach:])
            texts = [b"".join([self.token[t] for t in now[i]]) for i in again]
            for i, ids in zip(again, self._contract(texts, CONTRACT_RUNS), strict=True):
                now[i] = ints(ids)
            parts, reach = now, reach * 2
        return np.fromiter(chain.from_iterable(parts), np.int32).tobytes()

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes that each row of ids stands for: the ids join the vocabulary, and their bytes are put together in order."""
        size = np.array([len(x) for x in rows])
        at, total = np.repeat(np.arange(len(rows), dtype=np.int32), size), int(size.sum())
        if not total:
            return [b""] * len(rows)
        self._put("coded", pa.table({"row": at, "pos": np.arange(total, dtype=np.int64), "id": np.concatenate(rows).astype(np.int32)}))
        out = [b""] * len(rows)
        found = self.db.sql(DECODE).to_arrow_table()
        for row, parts in zip(found["row"].chunks, found["parts"].chunks, strict=True):
            text, begin = parts.values, parts.offsets.to_numpy()
            place = np.frombuffer(text.buffers()[1], np.int32)[text.offset + begin]
            data = memoryview(text.buffers()[2])
            for i, lo, hi in zip(row.to_pylist(), place[:-1].tolist(), place[1:].tolist(), strict=True):
                out[i] = bytes(data[lo:hi])
        return out

    def _learn(self, missing: set[str]) -> None:
        words = []
        for w in missing:
            if (v := self.old.get(w)) is not None:
                self.young[w] = v
            else:
                words.append(w)
        for lo in range(0, len(words), 40_000):
            part = words[lo : lo + 40_000]
            self.young.update(zip(part, self.encode_words([w.encode() for w in part]), strict=True))

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """Each text's ids, as decimals with commas and as an array: its words' ids one after another."""
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        get = self.young.get
        split = [self.find(x) for x in texts]
        found = [list(map(get, words)) for words in split]
        missing = {w for words, got in zip(split, found, strict=True) if None in got for w, v in zip(words, got, strict=True) if v is None}
        self._learn(missing)
        out = []
        for words, got in zip(split, found, strict=True):
            ids = np.frombuffer(b"".join(list(map(get, words)) if None in got else got), np.int32)
            out.append((self.decimal[ids].tobytes().replace(b"\0", b"")[:-1], ids))
        for w in missing:
            if len(w) > self.short:
                del self.young[w]
        return out

    def documents(self, texts: list[str], block: int = 1 << 18) -> Iterator[tuple[bytes, np.ndarray, list[bytes]]]:
        """Each text's ids, as encode() gives them, and the bytes that its ids decode to, in parts of at most `block` ids."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 8 * block):
                size += len(texts[hi])
                hi += 1
            coded = self.encode(texts[lo:hi])
            cut = [[ids[i : i + block] for i in range(0, len(ids), block)] for _, ids in coded]
            flat, back, total = list(chain.from_iterable(cut)), [], 0
            while len(back) < len(flat):
                end, total = len(back), 0
                while end < len(flat) and (end == len(back) or total + len(flat[end]) <= block):
                    total += len(flat[end])
                    end += 1
                back += self.decode(flat[len(back) : end])
            done = 0
            for (text, ids), own in zip(coded, cut, strict=True):
                yield text, ids, back[done : done + len(own)]
                done += len(own)
            lo = hi


def bpe_codes(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", root: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, ids (array), n_tokens and decoded (binary) of every whole text; with digests, ids_sha256 (of the ids' decimals joined
    by commas) and decoded_sha256 stand for ids and decoded, so that long results needn't leave the worker.

    The pattern's matches are the words. A worker's DuckDB (one thread, 300 MB, no temporary files) merges the distinct words of some
    texts that it doesn't remember by CONTRACT, words of over 256 bytes by pieces (see Codec._long), so that a word's time grows in
    proportion to its length; up to about 900,000 words are remembered. Every text is then decoded from its own ids by an ordered
    aggregation. Narrow: no shuffle, a lost task is done again from its input. A vocabulary with a token that no two
    tokens of lower rank make is contracted a pair at a time, long words too: right, but slow for these.

    Null text counts as empty: no ids. Each row gives a row, repeated rows and null doc_ids too; an empty table none.
    Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache("bpe")
        import public_tokenizers

        key = tokenizer_path(ranks, root), pattern or public_tokenizers.PATTERN
        c = kept.get(key) or kept.setdefault(key, Codec(*key))
        def sha(parts: list[bytes]) -> str:
            h = hashlib.sha256()
            for x in parts:
                h.update(x)
            return h.hexdigest()

        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                n, ids, back = [], [], []
                for text, own_ids, parts in c.documents(part["text"].to_pylist()):
                    n.append(len(own_ids))
                    ids.append(sha([text]) if digests else own_ids)
                    back.append(sha(parts) if digests else b"".join(parts))
                n = pa.array(n, pa.int64())
                if digests:
                    yield pa.record_batch([part["doc_id"], n, pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.record_batch([part["doc_id"], pa.array(ids, pa.list_(pa.int32())), n, pa.array(back, pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])

    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, n_tokens long, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    return bpe_codes(table(spark, sf_dir, "documents"), digests=True)
