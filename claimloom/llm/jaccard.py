"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), and its connected components."""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import table, worker_cache, written

WORDS = 5
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
NO_ID = 2**63 - 1  # stands for a null doc_id inside the join
BLOCK = 2_000_000  # elements that a task holds at once, but for a larger single document

# Two sets link when 100 * overlap >= 80 * union. So the overlap is at least least(n) of either size n; and of both sets' elements
# in the order of their hashes, the first n - least(n) + m hold m common ones (m at most either's own).


def least(n):
    return (4 * n + 4) // 5


def extra(n):
    """m for a set of n elements: each common prefix holds this many, so what shares fewer is out."""
    return 1 + n // 10


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of word 5-grams, in order."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and ASCII white space
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(w):
        return w
    n = max(len(w) - WORDS + 1, 1)
    h = np.full(n, min(len(w), WORDS), np.uint64)
    for k in range(min(WORDS, len(w))):
        h += w[k : k + n] * MIX[k]
    h ^= h >> np.uint64(31)
    h *= MIX[0]
    h ^= h >> np.uint64(29)
    h *= MIX[1]
    return np.unique(h ^ (h >> np.uint64(32)))


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.record_batch([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _bytes(column) -> list:
    return [memoryview(x.as_buffer()) for x in column]


def _dealt(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of elements by part, and where each part begins. The part depends on bits that the hash order doesn't."""
    part = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


REGION = "part int, single binary, docs binary, shared binary, ids binary, sizes binary, counts binary, digests binary"


def _region_rows(ids: list[int], size: list[int], digests: list[bytes], heads: list[np.ndarray], parts: int, turn: int) -> pa.RecordBatch:
    """The prefixes of a block's documents, dealt by hash: hashes that one document has with that document, others once and counted
    here, so no hash has more than a row from each block."""
    take = np.array([len(x) for x in heads], np.int64)
    h = np.concatenate(heads)
    own = np.repeat(np.arange(len(heads)), take)
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    same = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, bool)
    many = same | np.concatenate([same[1:], [False]]) if len(h) else same
    count = np.bincount(own[many], minlength=len(heads))
    shared, single, docs = h[many & ~same], h[~many], np.array(ids, np.int64)[own[~many]]
    so, sb = _dealt(single, parts)
    ho, hb = _dealt(shared, parts)
    cut = [(so[sb[p] : sb[p + 1]], ho[hb[p] : hb[p + 1]]) for p in range(parts)]
    rows = [(p, single[x].tobytes(), docs[x].tobytes(), shared[y].tobytes(), *[b""] * 4) for p, (x, y) in enumerate(cut)]
    p = turn % parts
    rows[p] = (*rows[p][:4], np.array(ids, np.int64).tobytes(), np.array(size, np.int32).tobytes(), count.astype(np.int32).tobytes(), b"".join(digests))
    return _batch(list(zip(*rows, strict=True)), REGION)


def _region(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    worker_cache("jaccard")
    rows, total, turn = [], 0, 0
    for b in batches:
        turn = turn or int(b["part"][0].as_py()) * 7919
        for i, t in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
            s = shingles(t.as_py())
            n = len(s)
            head = s[: min(n, n - least(n) + extra(n))].copy() if n else s
            rows.append((i, n, xxhash.xxh3_128_digest(s.tobytes()), head))
            total += len(head) + 1
            if total >= BLOCK // 3:
                yield _region_rows(*map(list, zip(*rows, strict=True)), parts, turn)
                rows, total, turn = [], 0, turn + 1
    if rows:
        yield _region_rows(*map(list, zip(*rows, strict=True)), parts, turn)


def _cat(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(_bytes(column)), kind)


COUNTS = "part int, docs binary, hits binary, ids binary, sizes binary, digests binary"
STAT = "doc long, size long, n long, low long, k long, digest binary, first boolean"


def _region_counts(t: pa.Table, parts: int) -> pa.Table:
    """How many of a document's prefix elements in this part another has too, and what the blocks say, dealt by document."""
    single, docs, shared = _cat(t["single"], np.uint64), _cat(t["docs"], np.int64), _cat(t["shared"], np.uint64)
    value, inverse, n = np.unique(single, return_inverse=True, return_counts=True)
    hit = n > 1
    if len(shared) and len(value):
        at = np.searchsorted(value, shared)
        at[at == len(value)] = 0
        hit[at[value[at] == shared]] = True
    ids, digests = _cat(t["ids"], np.int64), _cat(t["digests"], "V16")
    sizes, counts = _cat(t["sizes"], np.int32), _cat(t["counts"], np.int32)
    doc, k = np.unique(docs[hit[inverse]], return_counts=True)
    doc, k = np.concatenate([doc, ids]), np.concatenate([k.astype(np.int32), counts])
    dealt = lambda x: _dealt(x.view(np.uint64) * MIX[0] >> np.uint64(32), parts)
    (do, db), (io, ib) = dealt(doc), dealt(ids)
    cut = [(do[db[p] : db[p + 1]], io[ib[p] : ib[p + 1]]) for p in range(parts)]
    rows = [(p, doc[x].tobytes(), k[x].tobytes(), ids[y].tobytes(), sizes[y].tobytes(), digests[y].tobytes()) for p, (x, y) in enumerate(cut) if len(x)]
    return pa.Table.from_batches([_batch(list(zip(*rows, strict=True)) or [[]] * 6, COUNTS)])


def _summed(t: pa.Table) -> pa.Table:
    """For each set of each document of a part: its size and digest, and the document's largest and least size and count k."""
    ids, sizes, raw = _cat(t["ids"], np.int64), _cat(t["sizes"], np.int32).astype(np.int64), _cat(t["digests"], "V16")
    doc, at = np.unique(ids, return_inverse=True)
    n, low = np.zeros(len(doc), np.int64), np.full(len(doc), 2**31, np.int64)
    np.maximum.at(n, at, sizes)
    np.minimum.at(low, at[sizes > 0], sizes[sizes > 0])
    k = np.bincount(np.searchsorted(doc, _cat(t["docs"], np.int64)), _cat(t["hits"], np.int32), len(doc)).astype(np.int64)
    rows: dict[tuple[int, bytes], int] = {(int(i), x.tobytes()): j for j, (i, x) in enumerate(zip(at, raw, strict=True))}
    own, row = np.array([i for i, _ in rows], np.int64), np.array(list(rows.values()), np.int64)
    first = np.zeros(len(own), bool)
    first[np.unique(own, return_index=True)[1]] = True
    return pa.table({"doc": doc[own], "size": sizes[row], "n": n[own], "low": low[own], "k": k[own], "digest": [x for _, x in rows], "first": first})


MARKS, CHUNK = 1 << 25, 1 << 18  # bits in all (4 MB, whatever the data) and in a row


def _marked(t: pa.Table) -> pa.Table:
    bits = np.zeros(CHUNK, bool)
    bits[t["bit"].to_numpy() % CHUNK] = True
    return pa.table({"chunk": t["chunk"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _marks(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of ids by hash, of a fixed size: it holds every id, and others as it fills."""
    bit = ids.select(_bit(column).alias("bit")).distinct().withColumn("chunk", F.floor(F.col("bit") / CHUNK).cast("int"))
    out = np.zeros(MARKS // 8, np.uint8)
    for r in bit.groupBy("chunk").applyInArrow(_marked, "chunk int, bits binary").collect():
        out[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _bit(column: str):
    return F.pmod(F.xxhash64(column), F.lit(MARKS))


def _own_sets(batches: Iterator[pa.RecordBatch], marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sets of marked documents."""
    for b in batches:
        bit = b["bit"].to_numpy()
        for lo in range(0, b.num_rows, 500):
            at = lo + np.flatnonzero(marks[bit[lo : lo + 500] >> 3] & (128 >> (bit[lo : lo + 500] & 7)))
            if len(at):
                part = b.take(pa.array(at))
                sets = [shingles(t.as_py()).tobytes() for t in part["text"]]
                yield _batch([part["doc_id"], [len(s) // 8 for s in sets], sets], "doc long, n long, elements binary")


COUNTED = "part int, block int, hashes binary, counts binary"


def _block_counts(t: pa.Table, parts: int) -> pa.Table:
    h, n = np.unique(_cat(t["elements"], np.uint64), return_counts=True)
    order, begin = _dealt(h, parts)
    block = t["block"][0].as_py()
    rows = [(p, block, h[order[begin[p] : begin[p + 1]]].tobytes(), n[order[begin[p] : begin[p + 1]]].astype(np.int32).tobytes()) for p in range(parts)]
    return pa.Table.from_batches([_batch(list(zip(*rows, strict=True)), COUNTED)])


def _replies(t: pa.Table) -> pa.Table:
    """For each block, those of its hashes in this part that two documents or more have, with how many have them."""
    h, c = [np.frombuffer(x, np.uint64) for x in _bytes(t["hashes"])], [np.frombuffer(x, np.int32) for x in _bytes(t["counts"])]
    value, inverse = np.unique(np.concatenate(h), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(c), len(value)).astype(np.int64)
    rows, at = [], 0
    for block, x in zip(t["block"].to_pylist(), h, strict=True):
        own = total[inverse[at : at + len(x)]]
        at += len(x)
        rows.append((block, x[own > 1].tobytes(), np.minimum(own[own > 1], 2**31 - 1).astype(np.int32).tobytes()))
    return pa.Table.from_batches([_batch(list(zip(*rows, strict=True)), "block int, hashes binary, counts binary")])


STARS = "part int, hashes binary, docs binary, a binary, b binary"


def _stars(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each hash with its least document, and the links from that one to the others, each once."""
    if not len(h):
        z = np.zeros(0, np.int64)
        return h, z, z, z
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    lead = doc[first][np.cumsum(first) - 1]
    other = lead != doc
    pairs = np.unique(np.stack([lead[other], doc[other]], 1), axis=0)
    return h[first], doc[first], pairs[:, 0], pairs[:, 1]


def _prefixes(sets: pa.Table, replies: pa.Table, parts: int) -> pa.Table:
    """Of a block's sets, those of which enough elements are shared at all; and of each of these the rarest elements, as many as
    two linked sets must have one of in common, the ones that no other has left out."""
    shared, df = _cat(replies["hashes"], np.uint64), _cat(replies["counts"], np.int32)
    order = np.argsort(shared)
    shared, df = shared[order], df[order]
    hs, ds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for doc, raw in zip(sets["doc"].to_pylist(), _bytes(sets["elements"]), strict=True):
        s = np.frombuffer(raw, np.uint64)
        n = len(s)
        if not len(shared):
            break
        at = np.searchsorted(shared, s)
        at[at == len(shared)] = 0
        own = shared[at] == s
        k = int(own.sum())
        if k < least(n):
            continue
        take = n - least(n) + 1 - (n - k)  # the n - k that no other has come first
        x, d = s[own], df[at[own]]
        x = x[np.lexsort((x, d))[:take]]
        hs.append(x)
        ds.append(np.full(len(x), doc, np.int64))
    h, doc, a, b = _stars(np.concatenate(hs), np.concatenate(ds))
    order, begin = _dealt(h, parts)
    rows = [(p, h[order[begin[p] : begin[p + 1]]].tobytes(), doc[order[begin[p] : begin[p + 1]]].tobytes(), b"", b"") for p in range(parts)]
    p = int(sets["block"][0].as_py()) % parts if sets.num_rows else 0
    rows[p] = (*rows[p][:3], a.tobytes(), b.tobytes())
    return pa.Table.from_batches([_batch(list(zip(*rows, strict=True)), STARS)])


def _joined_stars(t: pa.Table) -> pa.Table:
    _, _, a, b = _stars(_cat(t["hashes"], np.uint64), _cat(t["docs"], np.int64))
    return pa.table({"a": np.concatenate([a, _cat(t["a"], np.int64)]), "b": np.concatenate([b, _cat(t["b"], np.int64)])})


class DivideSkip:
    """Inverted lists over the sets added so far, searched for the sets that share at least `need` elements with a query."""

    def __init__(self, heap_most: int = 20_000):
        self.lists: dict[int, array] = {}
        self.most, self.heap_most = 0, heap_most

    def add(self, number: int, elements: list[int]) -> None:
        """Numbers must rise."""
        lists = self.lists
        for e in elements:
            x = lists.get(e)
            if x is None:
                lists[e] = array("i", [number])
            else:
                x.append(number)
                if len(x) > self.most:
                    self.most = len(x)

    def search(self, elements: list[int], need: int) -> list[tuple[int, int]]:
        """(number, overlap) of all sets of overlap >= need. The longest lists are probed by bisection, for those sets that the
        others have often enough: need less the number of long lists."""
        get = self.lists.get
        found = [x for e in elements if (x := get(e)) is not None]
        if len(found) < need:
            return []
        found.sort(key=len)
        long = min(need - 1, int(need / (0.01 * math.log2(self.most + 1) + 1))) if self.most > 1 else 0
        while long and len(found[-long]) <= 8:  # short lists are cheaper merged
            long -= 1
        short, probed = found[: len(found) - long], found[len(found) - long :]
        merge = self._heap if sum(map(len, short)) <= self.heap_most else self._counted
        number, n = merge(short, need - long)
        for i, x in enumerate(probed):
            still = n + (long - i) >= need
            if not still.all():
                number, n = number[still], n[still]
            if not len(number):
                return []
            own = np.frombuffer(x, np.int32)
            at = np.searchsorted(own, number)
            at[at == len(own)] = 0
            n = n + (own[at] == number)
        keep = n >= need
        return list(zip(number[keep].tolist(), n[keep].tolist(), strict=True))

    @staticmethod
    def _counted(lists: list[array], want: int) -> tuple[np.ndarray, np.ndarray]:
        """The merge of very many entries, those of texts of some ten thousand words and more, for which a heap has no room: one count over them all."""
        n = np.bincount(np.concatenate([np.frombuffer(x, np.int32) for x in lists]))
        number = np.flatnonzero(n >= max(want, 1)).astype(np.int32)
        return number, n[number]

    @staticmethod
    def _heap(lists: list[array], want: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers on at least `want` lists, from a heap of the lists' heads that skips to where `want` of them can meet."""
        out, at = [], [0] * len(lists)
        heap = [(x[0] << 24) | i for i, x in enumerate(lists)]
        heapq.heapify(heap)
        while len(heap) >= want:
            top, popped = heap[0] >> 24, []
            while heap and heap[0] >> 24 == top:
                popped.append(heapq.heappop(heap) & 0xFFFFFF)
            if len(popped) >= want:
                out.append((top, len(popped)))
                to = top + 1
            else:
                for _ in range(min(want - 1 - len(popped), len(heap))):
                    popped.append(heapq.heappop(heap) & 0xFFFFFF)
                if not heap:
                    break
                to = heap[0] >> 24
            for i in popped:
                x = lists[i]
                j = at[i] = bisect_left(x, to, at[i])
                if j < len(x):
                    heapq.heappush(heap, (x[j] << 24) | i)
        return np.array([x[0] for x in out], np.int32), np.array([x[1] for x in out], np.int64)


def linked(overlap: int, n: int, m: int) -> bool:
    return 100 * overlap >= 80 * (n + m - overlap)


def components(docs: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """The component (its least document) of each set, over all links among them, and which sets lead. Sets of one document are linked.

    Sets come by size; each is looked up among the leaders so far. Jaccard distance is a metric, so a set that links with a
    leader's follower (within 0.2 of it) lies within 0.4 of the leader: a T-occurrence search at similarity 0.6 finds every leader
    that matters. A link with the leader joins its component, and then none of its followers, all in that component, needs a look.
    Only of leaders between 0.6 and 0.8 are the followers tried, those far enough out, until one links. A set that no leader links
    with leads. So a group of near copies costs a search for each set, not a pair for each two.
    """
    parent = list(range(len(docs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    first: dict[int, int] = {}
    for i, d in enumerate(docs):
        join(first.setdefault(d, i), i)
    order = sorted(range(len(docs)), key=lambda i: (len(sets[i]), docs[i]))
    index, leaders, followers = DivideSkip(), [], []
    for i in order:
        s = sets[i]
        n = len(s)
        elements = s.tolist()
        mine, far = None, []
        for number, overlap in index.search(elements, max(1, (3 * n + 4) // 5)):
            lead = leaders[number]
            m = len(sets[lead])
            d = 1 - overlap / (n + m - overlap)
            if linked(overlap, n, m):
                join(i, lead)
                if mine is None:
                    mine = number, d
            elif d <= 0.4 + 1e-9:
                far.append((number, d))
        for number, d in far:
            for j, dj in followers[number]:
                if dj >= d - 0.2 - 1e-9 and root(j) != root(i):
                    if linked(len(np.intersect1d(s, sets[j], assume_unique=True)), n, len(sets[j])):
                        join(i, j)
        if mine is None:
            index.add(len(leaders), elements)
            leaders.append(i)
            followers.append([])
        else:
            followers[mine[0]].append((i, mine[1]))
    low: dict[int, int] = {}
    for i, d in enumerate(docs):
        r = root(i)
        low[r] = min(d, low.get(r, d))
    return [low[root(i)] for i in range(len(docs))], leaders


FOUND = "cluster long, doc long, component long, n long, elements binary"


def _search(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by cluster and chunk; memory holds one chunk. Leaders keep their elements, if asked to."""
    at, docs, sets = None, [], []

    def done() -> pa.RecordBatch:
        comp, lead = components(docs, sets)
        leads = set(lead if keep else ())
        raw = [s.tobytes() if i in leads else None for i, s in enumerate(sets)]
        return _batch([[at[0]] * len(docs), docs, comp, [len(s) for s in sets], raw], FOUND)

    for b in batches:
        for cluster, chunk, doc, raw in zip(b["cluster"].to_pylist(), b["chunk"].to_pylist(), b["doc"].to_pylist(), b["elements"], strict=True):
            if (cluster, chunk) != at:
                if docs:
                    yield done()
                at, docs, sets = (cluster, chunk), [], []
            docs.append(doc)
            sets.append(np.frombuffer(raw.as_py(), np.uint64))
    if docs:
        yield done()


def _searched(sets: DataFrame, keep: bool = True) -> DataFrame:
    """The components within each cluster and chunk of sets."""
    dealt = sets.select("cluster", "chunk", "doc", "elements").repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", "doc")
    return dealt.mapInArrow(lambda b: _search(b, keep), FOUND)


def _chunked(sets: DataFrame, most: int, salt: int) -> tuple[DataFrame, int]:
    """sets with a chunk for each, in clusters cut at random so that a chunk has about `most` elements; and how many clusters are cut.
    What is broadcast is a row for each of these, so at most one for every `most` elements of all sets."""
    big = written(sets.groupBy("cluster").agg(F.sum("n").alias("total")).where(F.col("total") > most).select("cluster", F.ceil(F.col("total") / most).cast("int").alias("chunks")), "jaccard-big")
    own = sets.join(F.broadcast(big), "cluster", "left")
    return own.withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("doc", F.lit(salt)), F.col("chunks")), F.lit(0)).cast("long")).drop("chunks"), big.count()


def _clustered(lead: DataFrame, cluster: DataFrame, most: int) -> DataFrame:
    """rep and component: the components of sets (doc, n, elements), no two of different clusters (doc, cluster) being linked.

    A task takes a cluster, or of one that has more than `most` elements a chunk. Then the leaders of chunks that belong together are
    searched in the same way, until each cluster's leaders are one chunk or don't get fewer. So a large group of near copies becomes one
    component although no task saw it whole. What may still be missed is a link between sets that follow leaders of different
    components: so the cluster is cut again, by components (of which only large ones are cut), and the pairs of its chunks are
    searched, but for those of one component. That work grows with the square of a cluster's chunks that aren't yet known to belong together.
    """
    sets = lead.join(cluster, "doc").select("cluster", "doc", "n", "elements")
    if sets.groupBy("cluster").agg(F.sum("n").alias("total")).where(F.col("total") > most).isEmpty():
        found = _searched(sets.withColumn("chunk", F.lit(0)), keep=False)
        return written(found.groupBy(F.col("doc").alias("rep")).agg(F.min("component").alias("component")), "jaccard-components")
    sets = written(sets, "jaccard-sets")
    now, cut = _chunked(sets, most, 0)
    links = [written(_searched(now), "jaccard-found")]
    level, before = 0, None
    while cut:
        level += 1
        lead, cut = _chunked(links[-1].where("elements IS NOT NULL").select("cluster", "doc", "n", "elements"), most, level)
        count = lead.count()
        if cut and before is not None and count > 0.9 * before:
            break
        before = count
        links.append(written(_searched(lead), "jaccard-found"))
    links.append(written(_across(sets, links, most), "jaccard-across"))
    pairs = links[0].select(F.col("component").alias("a"), F.col("doc").alias("b"))
    for x in links[1:]:
        pairs = pairs.unionByName(x.select(F.col("component").alias("a"), F.col("doc").alias("b")))
    low = connected(pairs.where("a <> b"))
    return sets.select(F.col("doc").alias("rep")).distinct().join(low.withColumnRenamed("doc", "rep"), "rep", "left").select("rep", F.coalesce("cluster", "rep").alias("component"))


def _across(sets: DataFrame, links: list[DataFrame], most: int) -> DataFrame:
    """The components within each two chunks of clusters of more than `most` elements, see _clustered()."""
    pairs = links[0].select("component", "doc")
    for x in links[1:]:
        pairs = pairs.unionByName(x.select("component", "doc"))
    low = connected(pairs.where("component <> doc").select(F.col("component").alias("a"), F.col("doc").alias("b"))).select("doc", F.col("cluster").alias("comp"))
    big = sets.groupBy("cluster").agg(F.sum("n").alias("total")).where(F.col("total") > most).select("cluster")
    own = sets.join(F.broadcast(big), "cluster").join(low, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    own = written(own, "jaccard-parts")
    size = own.groupBy("cluster", "comp").agg(F.sum("n").alias("total"))
    rest = size.where(F.col("total") <= most).groupBy("cluster").agg(F.ceil(F.sum("total") / most).cast("int").alias("bins"))
    large = size.where(F.col("total") > most).select("cluster", "comp", F.ceil(F.col("total") / most).cast("int").alias("cuts"))
    own = own.join(F.broadcast(large), ["cluster", "comp"], "left").join(F.broadcast(rest), "cluster", "left")
    whole = F.col("cuts").isNotNull()
    piece = F.when(whole, F.pmod(F.xxhash64("doc"), F.col("cuts"))).otherwise(F.pmod(F.xxhash64("comp"), F.col("bins"))).cast("int")
    own = written(own.select("cluster", "doc", "elements", F.struct(F.when(whole, F.col("comp")).alias("of"), piece.alias("piece")).alias("part")), "jaccard-cut")
    parts = own.select("cluster", "part").distinct()
    a, b = parts.select("cluster", F.col("part").alias("x")), parts.select("cluster", F.col("part").alias("y"))
    pair = a.join(b, "cluster").where("x <= y AND (x.of IS NULL OR y.of IS NULL OR x.of <> y.of)").withColumn("chunk", F.monotonically_increasing_id())
    pair = written(pair, "jaccard-pairs")
    side = pair.select("cluster", "chunk", F.explode(F.array_distinct(F.array("x", "y"))).alias("part"))
    return _searched(own.join(side, ["cluster", "part"]), keep=False)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition to as few: each of its documents with the least it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for b in batches:
        for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(r, x) for x in parent if (r := root(x)) != x]
    if pairs:
        yield _batch(list(zip(*pairs, strict=True)), "a long, b long")


def connected(links: DataFrame, hub: int = 256) -> DataFrame:
    """doc, cluster (the least document reachable) of all documents in links (a, b).

    In every turn each link goes to the tasks of both its ends, and a task contracts what it has to stars around the least document.
    When a turn changes nothing, no document has two links but a star's middle, so the stars are the components. The links of a
    hub, a document that is the less of more than `hub` links (or a hundred thousandth of all, so that hubs are few), are salted among
    tasks, to each of which go the hub's links to lesser documents. A turn is one shuffle of some two rows for each
    link; turns grow with the logarithm of the longest chain. Every turn's links are a table in the shared folder.
    """
    links, before = written(links.mapInArrow(_contract, "a long, b long"), "links"), None
    while True:
        n, h = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, h) == before:
            break
        before = n, h
        most = max(hub, n // 100_000)
        hubs = links.groupBy("a").count().where(F.col("count") > most).select(F.col("a").alias("end"), F.ceil(F.col("count") / most).cast("int").alias("salts"))
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("end"), F.lit(True).alias("less")), F.struct(F.col("b").alias("end"), F.lit(False).alias("less")))).alias("e"), "a", "b")
        ends = ends.select("e.end", "e.less", "a", "b").join(F.broadcast(hubs), "end", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        to = F.when(F.col("less"), F.array(F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
        dealt = ends.select("end", F.explode(to).alias("salt"), "a", "b").repartition("end", "salt").select("a", "b")
        links = written(dealt.mapInArrow(_contract, "a long, b long"), "links")
    links = links.distinct()
    return links.select(F.col("b").alias("doc"), F.col("a").alias("cluster")).unionByName(links.select(F.col("a").alias("doc"), F.col("a").alias("cluster")).distinct())


def jaccard_components(docs: DataFrame, chunk: int = BLOCK // 4, marked_most: int = MARKS // 8) -> DataFrame:
    """doc_id, n_shingles, component_id: the classes of documents that links of Jaccard 0.8 or more on word 5-grams connect.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. A set is the distinct 5-grams, by a 64-bit hash; with fewer words the whole
    sequence is the one element; without words it is empty, and links with nothing (component_id: its own).

    1. Prefix rows: the elements of least hash, about 3/10 of each set, packed by part of the hash space. A document stays if so many
       of its own are another's too that a partner is possible (exact; see extra()). A hash is counted in the block first, so that one that a third
       of all documents share is a row for each block.
    2. Of survivors with equal sets (by a 128-bit digest) the least doc_id stands for all. Its set is made again from its text, found
       by a bitmap, so no text is shuffled; other sets that the bitmap lets through do no harm. Where so many stand for others that the
       bitmap would fill, texts are found by a join on doc_id.
    3. How many survivors have each element, asked and answered by block. Those with too few shared elements go; of the others the
       rarest elements, one of which linked sets must share, connect candidates: each hash's least document with the others.
    4. Connected candidates are clusters, which hold every link. A task takes a cluster at a time, or a chunk of a large one: see
       components() and _clustered().

    Parts of the hash space are as many as the input's partitions, or the session's shuffle partitions if these are more. Blocks of step 1 and 3 send
    a row to each part, so the number of these rows (not their bytes) grows faster than the data.

    Null text counts as empty. Rows that share a doc_id are one node with the larger n_shingles, linked by any of its rows; null
    doc_ids are one such node, after all others. One row for each doc_id; an empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    region = own.withColumn("part", F.spark_partition_id()).mapInArrow(lambda b: _region(b, parts), REGION)
    counts = region.groupBy("part").applyInArrow(lambda t: _region_counts(t, parts), COUNTS)
    stat = written(counts.groupBy("part").applyInArrow(_summed, STAT), "jaccard-stat")
    some = stat.where("size > 0 and k >= 1 + ((4 * low + 4) div 5) div 10")
    reps = written(some.groupBy("digest").agg(F.min("doc").alias("rep")), "jaccard-reps")
    member = some.select("doc", "digest").join(reps, "digest").select("doc", "rep")
    asked_for = own.select("doc_id", "text", _bit("doc_id").alias("bit"))
    if reps.count() <= marked_most:
        bits = _marks(reps, "rep")
    else:
        asked_for, bits = asked_for.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), np.full(MARKS // 8, 255, np.uint8)
    marks = spark.sparkContext.broadcast(bits)
    lead = written(asked_for.mapInArrow(lambda b: _own_sets(b, marks.value), "doc long, n long, elements binary").where("n > 0"), "jaccard-leads")
    total = lead.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK), min(parts, total // 200_000))
    lead = lead.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int"))
    asked = lead.groupBy("block").applyInArrow(lambda t: _block_counts(t, parts), COUNTED)
    answers = asked.groupBy("part").applyInArrow(_replies, "block int, hashes binary, counts binary")
    stars = lead.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda s, r: _prefixes(s, r, parts), STARS)
    links = stars.groupBy("part").applyInArrow(_joined_stars, "a long, b long")
    cluster = written(connected(links), "jaccard-clusters")
    return _labelled(stat, member, _clustered(lead, cluster, chunk))


def _labelled(stat: DataFrame, member: DataFrame, comp: DataFrame) -> DataFrame:
    """Every document with its component. A doc_id with several sets connects their components, which are then joined up."""
    of = member.join(comp, "rep", "left").select("doc", F.coalesce("component", "rep").alias("component"))
    low = of.groupBy("doc").agg(F.min("component").alias("component"), F.max("component").alias("most"))
    split = low.where("component <> most").select(F.col("component").alias("a"), F.col("most").alias("b"))
    out = stat.where("first").join(low.drop("most"), "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    if not split.isEmpty():
        pairs = of.join(low, "doc").select(low["component"].alias("a"), of["component"].alias("b")).where("a <> b").distinct()
        up = connected(pairs)
        out = out.join(up.select(F.col("doc").alias("component"), "cluster"), "component", "left").select("doc", "n", F.coalesce("cluster", "component").alias("component"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(null("doc").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
