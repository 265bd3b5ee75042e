"""Packing of whole corpora into fixed windows by lexical retrieval."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import table, tokenizer_path, worker_cache

#: Letters, of which each has one lower case character and none composes, and punctuation without the apostrophe.
LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next from 256 on."""
    plain, out, n = {*range(33, 127), *range(161, 173), *range(174, 256)}, [], 256
    for b in range(256):
        out.append(chr(b if b in plain else n))
        n += b not in plain
    return out


class Encoder:
    """White-space units of a text to their ids as little-endian bytes.

    For a tokenizer that drops white space and never joins what it parts, a text's ids are its units' ids one after another.
    A unit of plain letters and then punctuation is its two parts, in lower case, each of which the model merges by itself.
    Short units are remembered in two generations of about `kept`: when the young one is full, it takes the old one's place.
    """

    def __init__(self, path: str, kept: int = 300_000, short: int = 40):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.model, self.names = self.t.model, _byte_names()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.kept, self.short = kept, short

    def _part(self, part: bytes) -> bytes:
        ids = self.young.get(part) or self.old.get(part)
        if ids is None:
            word = part.decode() if part.isascii() else "".join([self.names[b] for b in part])
            ids = array("I", [x.id for x in self.model.tokenize(word)]).tobytes()
        self.young[part] = ids
        return ids

    def _learn(self, missing: set[bytes]) -> None:
        young, old, fresh = self.young, self.old, []
        for u in missing:
            ids = old.get(u)
            if ids is None:
                m = LETTERS.fullmatch(u.decode())
                if not m:
                    fresh.append(u)
                    continue
                ids = self._part(m[1].lower().encode())
                if m[2]:
                    ids += self._part(m[2].encode())
            young[u] = ids
        if fresh:
            found = self.t.encode_batch_fast([u.decode() for u in fresh], add_special_tokens=False)
            young.update((u, array("I", e.ids).tobytes()) for u, e in zip(fresh, found, strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [x.encode().split() for x in texts]  # bytes.split() parts at ASCII white space alone
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        young = self.young
        found = [list(map(young.get, units)) for units in split]
        missing = {u for units, ids in zip(split, found, strict=True) if None in ids for u, v in zip(units, ids, strict=True) if v is None}
        self._learn(missing)
        out = []
        for units, ids in zip(split, found, strict=True):
            whole = b"".join([young[u] if v is None else v for u, v in zip(units, ids, strict=True)] if None in ids else ids)
            out.append(np.frombuffer(whole, np.uint32))
        for u in missing:
            if len(u) > self.short:
                del young[u]
        return out


class Shard:
    """BM25 over the documents of one shard: postings sorted by term, each with its weight. Terms of at least a tenth of the documents
    have a dense row of weights too, which is added faster than postings are."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(docs)
        size = np.array([len(d) for d in docs], np.int64)
        most = max((int(d.max()) for d in docs if len(d)), default=0)
        kind = np.uint32 if (most + 1) * n < 1 << 32 else np.uint64  # what a shard's sort takes is most of a task's memory
        key = np.concatenate(docs).astype(kind)
        key *= kind(n)
        key += np.repeat(np.arange(n, dtype=kind), size)
        key, tf = np.unique(key, return_counts=True)
        term, self.doc = key // kind(n), (key % kind(n)).astype(np.int32)
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        self.lo, self.hi = first, first + df
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * size / max(size.mean(), 1))
        self.weight = (np.repeat(self.idf, df) * tf * (k1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.n = n
        often = np.flatnonzero(df * 10 >= n)
        self.row = np.full(len(df), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.float32)
        for r, t in enumerate(often):
            self.dense[r, self.doc[self.lo[t] : self.hi[t]]] = self.weight[self.lo[t] : self.hi[t]]

    def scores(self, ids: np.ndarray, query_terms: int | None = None) -> np.ndarray:
        """Every document's score for all terms of the query, or only the query_terms of largest tf * idf."""
        term, tf = np.unique(ids, return_counts=True)
        at = np.searchsorted(self.terms, term)
        if query_terms is not None:
            at = at[np.argsort(-tf * self.idf[at], kind="stable")[:query_terms]]
        row = self.row[at]
        out = np.zeros(self.n, np.float32)
        for r in row[row >= 0]:  # one after another, so that equal documents get equal sums
            out += self.dense[r]
        rare = at[row < 0]
        lo, n = self.lo[rare], self.hi[rare] - self.lo[rare]
        place = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        return out + np.bincount(self.doc[place], self.weight[place], self.n).astype(np.float32)


def pack_shard(docs: list[np.ndarray], window: int, query_terms: int | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length), together every id once.

    Whole windows are cut off long documents first. What is left of each seeds a window in turn: its BM25 neighbours that are still
    unused follow, best first (ties and strangers in input order), and the one that doesn't fit is cut; its rest seeds the next
    window. Only the last window stays short; its binary parts become sequences of powers of two, which need no padding.
    """
    rest = []
    for i, d in enumerate(docs):
        whole = len(d) // window * window
        for at in range(0, whole, window):
            yield [(i, at, window)]
        if len(d) > whole:
            rest.append((i, whole, len(d) - whole))
    if not rest:
        return
    index = Shard([docs[i][at:] for i, at, _ in rest])
    size = np.array([x[2] for x in rest])
    free = np.ones(len(rest), bool)
    seed, begun, following = 0, 0, 0  # the seed, how much of it is packed, and the first document that may be free
    now: list[tuple[int, int, int]] = []
    free[0] = False
    while True:
        i, at, n = rest[seed]
        now, room = [(i, at + begun, n - begun)], window - (n - begun)
        if room > 0:
            score = index.scores(docs[i][at:], query_terms)
            score[~free] = -1
            most = int(min(64, free.sum()))
            while room > 0 and most:
                part = np.argpartition(-score, most - 1)[:most] if most < len(score) else np.arange(len(score))
                order = part[np.lexsort((part, -score[part]))]
                for j in order[score[order] >= 0][:most]:
                    take = min(room, int(size[j]))
                    now.append((rest[j][0], rest[j][1], take))
                    free[j], score[j] = False, -1
                    room -= take
                    if not room:
                        break
                most = int(min(64, free.sum()))
        if room:
            break
        yield now
        doc, start, took = now[-1]
        j = int(j) if len(now) > 1 else seed
        if len(now) > 1 and took < size[j]:
            seed, begun = j, took
        else:
            while following < len(rest) and not free[following]:
                following += 1
            if following == len(rest):
                return
            seed, begun = following, 0
            free[seed] = False
    left = sum(x[2] for x in now)
    for bit in range(left.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            out, need = [], 1 << bit
            while need:
                i, at, n = now.pop(0)
                take = min(n, need)
                out.append((i, at, take))
                need -= take
                if take < n:
                    now.insert(0, (i, at + take, n - take))
            yield out


def pack(
    docs: DataFrame,
    window: int = 4096,
    end_id: int = 2,
    tokenizer: str = "word_bpe_49k.json",
    root: str | None = None,
    shard_tokens: int = 2_000_000,
    query_terms: int | None = None,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each input partition is dealt into shards of about `shard_tokens` tokens as it streams by (at least one document), so memory is
    bounded by a shard or the longest document, nothing is shuffled, and a lost task is done again from its input split.
    Within a shard, retrieval packing as in pack_shard(), by all terms of a seed, or by its query_terms of largest tf * idf. A seed
    finds neighbours of its own shard alone. sequence_id: partition, shard and number, so unique over all.

    The tokenizer must drop white space, as word_bpe_49k.json does. Null text counts as empty, which still has its end id.
    Rows that repeat are documents of their own with the same doc_id; doc_id may be null. An empty table gives no rows.
    Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("part"))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def packed(ids: list, docs: list[np.ndarray], base: int) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for k, seq in enumerate(pack_shard(docs, window, query_terms)):
            at = 0
            for i, start, n in seq:
                rows.append((ids[i], start, n, docs[i][start : start + n].tobytes(), len(docs[i]), base + k, at))
                at += n
            if len(rows) >= 2000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache("packing")
        path = tokenizer_path(tokenizer, root)
        e = kept.get(path) or kept.setdefault(path, Encoder(path))
        ids, held, total, base, end = [], [], 0, 0, np.array([end_id], "<u4")
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                if not base:
                    base = part["part"][0].as_py() << 40
                for i, x in zip(part["doc_id"].to_pylist(), e.encode(part["text"].to_pylist()), strict=True):
                    ids.append(i)
                    held.append(np.concatenate([x, end]))
                    total += len(x) + 1
                    if total >= shard_tokens:
                        yield from packed(ids, held, base)
                        ids, held, total, base = [], [], 0, base + (1 << 24)
        if held:
            yield from packed(ids, held, base)

    return own.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
