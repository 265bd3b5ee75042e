"""Token counts of whole texts by a public tokenizer, huge documents in overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import table, tokenizer_path, worker_cache

#: Between two of these no token of a byte-level tokenizer's split ever spans: after a character that is no white space and before
#: ASCII white space. The split's matches hold white space only at their start, so each ends before such a place whatever the text
#: around, and what follows is split alike from there; no special string holds white space.
STABLE = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")
#: The same place where one space parts two words: the text falls apart there into units that can be counted one by one.
UNITS = re.compile(r"(?<=\S)(?= \S)")
KEPT_UNITS, KEPT_CHARS = 400_000, 40


class Counter:
    """Counts tokens as tokenizers does by default, remembering a bounded number of short units."""

    def __init__(self, path: str, chunk: int = 32_768, overlap: int = 256):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, int] = {}

    def _learn(self, units: set[str]) -> None:
        if len(self.known) + len(units) > KEPT_UNITS:
            self.known.clear()
        new = list(units)
        for lo in range(0, len(new), 10_000):
            part = new[lo : lo + 10_000]
            self.known.update(zip(part, map(len, self.t.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        split = [UNITS.split(x) if len(x) <= self.chunk else None for x in texts]
        known, missing, out = self.known, set(), []
        for units in split:
            if units:
                missing.update(units)
        missing.difference_update(known)
        if len(known) + len(missing) > KEPT_UNITS and known:
            known.clear()
            missing = {u for units in split if units for u in units}
        long = [u for u in missing if len(u) > KEPT_CHARS]
        self._learn(missing)
        for x, units in zip(texts, split, strict=True):
            out.append(self.huge(x) if units is None else sum(map(known.__getitem__, units)))
        for u in long:
            known.pop(u, None)
        return out

    def _ends(self, text: str, lo: int, hi: int) -> tuple[list[int], list[int]]:
        e = self.t.encode(text[lo:hi], add_special_tokens=False).offsets
        return [a + lo for a, _ in e], [b + lo for _, b in e]

    @staticmethod
    def _cut(starts: list[int], ends: list[int], p: int) -> int | None:
        """How many tokens end by p, if none spans p."""
        n = sum(s < p for s in starts)
        return n if all(e <= p for e in ends[:n]) and all(s >= p for s in starts[n:]) else None

    def huge(self, text: str) -> int:
        """Overlapping chunks, each pair spliced at a stable place where both encodings have a boundary; without one the overlap
        doubles, and when it covers the chunk the chunk does."""
        n, lo, done, total = len(text), 0, 0, 0  # the current chunk's start; all before `done` is counted
        hi = min(self.chunk, n)
        own = self._ends(text, lo, hi)
        while hi < n:
            overlap, spliced = self.overlap, None
            while spliced is None:
                at = max(hi - overlap, done)
                to = min(at + self.chunk + overlap, n)
                nxt = self._ends(text, at, to)
                for m in reversed(list(STABLE.finditer(text, at + 1, hi))):
                    p = m.start()
                    if p > done and (a := self._cut(*own, p)) is not None and (b := self._cut(*nxt, p)) is not None:
                        spliced = p, a, b
                        break
                if spliced is None and at == done:
                    break
                overlap *= 2
            if spliced is None:  # no stable place in the whole chunk: make it longer
                lo, hi = (done, min(done + 2 * (hi - done), n))
                own, base = self._ends(text, lo, hi), 0
                continue
            p, a, _ = spliced
            before = 0 if lo == done else self._cut(*own, done)
            total += a - before
            done, lo, hi, own = p, at, to, nxt
        before = 0 if lo == done else self._cut(*own, done)
        return total + len(own[0]) - before


def token_counts(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", root: str | None = None, limit: int = 512, chunk: int = 32_768, overlap: int = 256
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every whole text; special strings inside texts count as
    the library's default has it, none are added.

    Texts over `chunk` characters are encoded in chunks that overlap, so memory is bounded by the chunk; others fall apart at
    single spaces into units whose counts a worker remembers (at most 400,000). Narrow: no shuffle, and nothing is kept on workers
    that a lost executor would take away.

    Null text counts as empty: 0 bytes and tokens. Each row gives a row, repeated rows and null doc_ids too; an empty table none.
    Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache("tokens")
        key = (tokenizer_path(tokenizer, root), chunk, overlap)  # as installed on this worker
        c = kept.get(key) or kept.setdefault(key, Counter(*key))
        for b in batches:
            yield pa.record_batch([b["doc_id"], b["n_bytes"], pa.array(c.counts(b["text"].to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return out.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
