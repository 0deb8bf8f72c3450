"""Jaccard join of word n-gram sets: pieces of sets that may link, each joined by a prefix tree."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from brasstide.llm.common import regrouped, small, written
from brasstide.llm.simhash import components

NGRAM = 3
#: Two sets link when SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (9, 10)
#: N-grams of the sets that meet in one piece; a larger group is dealt into blocks, all of which meet.
PIECE = 4_000_000
#: Words a task remembers the hash of.
REMEMBERED = 1_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs only give equal outputs."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def ngrams(text: str | None, known: _Words, size: int = NGRAM) -> np.ndarray:
    """A text's distinct word n-grams as ascending 64-bit hashes: the global order of all sets.

    A-Z in lower case, words parted at ASCII white space; fewer words than `size` are one n-gram,
    none give the empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space parts
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _mixed(out * _ODD[0] + h[k:k + len(out)] * _ODD[1] + _ODD[2])
    return np.unique(out)


@lru_cache(maxsize=1)
def _ranges() -> np.ndarray:
    """Least sizes of the size ranges, each reaching to half as much again."""
    out = [1]
    while out[-1] < 2 ** 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out)


def _budget(largest: int, share: tuple[int, int]) -> int:
    """Most elements by which two linking sets differ, the smaller of at most `largest`."""
    a, b = share
    return largest * (b - a) // a  # |A + B| - 2 |A & B|, with |B| <= |A| b / a


@lru_cache(maxsize=4096)
def _cuts(segments: int) -> np.ndarray:
    return np.array([(i << 64) // segments for i in range(1, segments)], dtype=np.uint64)


def meeting_keys(grams: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """Keys of a set, of which it shares at least one with every other set it links with.

    Sets meet by size range: that of the smaller one, which a larger one within reach of it joins.
    In a range whose sets differ by at most D elements when they link, hashes are cut into D + 2
    segments, so two segments at least are equal throughout. A key is a non-empty segment's content,
    or a pair of empty segments. Shared passages don't make keys equal, only nearly equal sets do.
    """
    n, (a, b) = len(grams), share
    starts = _ranges()
    own = int(np.searchsorted(starts, n, "right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams, dtype=np.uint64)])
    found = []
    for g in range(own, -1, -1):
        if n * a > (int(starts[g + 1]) - 1) * b and g < own:
            break
        differ = _budget(int(starts[g + 1]) - 1, share)
        if not differ:
            continue  # only equal sets link, and those count as one
        segments = differ + 2
        at = np.concatenate([[0], np.searchsorted(grams, _cuts(segments)), [n]])
        content = np.diff(sums[at])
        names = _mixed(np.arange(segments, dtype=np.uint64) + np.uint64(g << 40))
        full = np.diff(at) > 0
        found.append(_mixed(content[full] * _ODD[0] + names[full]))
        empty = names[~full]
        if len(empty) > 1:
            i, j = np.triu_indices(len(empty), 1)  # a handful: a segment holds nine n-grams on average
            found.append(_mixed(empty[i] * _ODD[1] + empty[j]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def _lists(arrays: list[np.ndarray]):
    import pyarrow as pa
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _each_text(batches: Iterator, make, rows_at_once: int = 2_000_000):
    """Per batch (column 0: carried, column 1: text) the sets, in slices of bounded n-grams."""
    known = _Words()
    for batch in batches:
        start, held, size = 0, [], 0
        for i in range(batch.num_rows):
            grams = ngrams(batch.column(1)[i].as_py(), known)
            held.append(grams)
            size += len(grams)
            if size > rows_at_once or i + 1 == batch.num_rows:
                yield make(batch.column(0).slice(start, i + 1 - start), held)
                start, held, size = i + 1, [], 0


def _digests(sets: list[np.ndarray]):
    import pyarrow as pa
    import xxhash
    return pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in sets], pa.binary())


def _keyed(share):
    def make(keys, sets):
        import pyarrow as pa
        return pa.RecordBatch.from_arrays(
            [keys, pa.array([len(g) for g in sets], pa.int64()), _digests(sets), _lists([meeting_keys(g, share) for g in sets])],
            names=["doc_id", "n", "node", "keys"])
    return lambda batches: _each_text(batches, make)


def _whole(batches: Iterator) -> Iterator:
    def make(keys, sets):
        import pyarrow as pa
        return pa.RecordBatch.from_arrays([_digests(sets), _lists(sets)], names=["node", "grams"])
    return _each_text(batches, make)


class _Node:
    """A run of the tree: `label` (ranks), what lies on the way to its end, and what hangs below."""
    __slots__ = ("label", "depth", "below", "kids", "sets", "least", "most", "group")

    def __init__(self, label, depth, size, length, group):
        self.label, self.depth, self.kids, self.sets = label, depth, {}, []
        self.least, self.most, self.group = size, length, group


class Tree:
    """Sets as ascending rank arrays in a compressed prefix tree; `find` gives those that link.

    A node knows the least size and the longest rank list below it, so a walk leaves a subtree as
    soon as the overlap so far plus the shorter remainder can't reach what that size asks for. It also
    knows whether all sets below belong to one component: a walk that belongs to it passes by.
    """

    def __init__(self, component: list[int], share: tuple[int, int]):
        self.root = _Node(np.zeros(0, np.int64), 0, 1 << 60, 0, None)
        self.component, self.share = component, share

    def top(self, i: int) -> int:
        c = self.component
        while c[i] != i:
            c[i] = c[c[i]]
            i = c[i]
        return i

    def _needed(self, x: int, y: int) -> int:
        a, b = self.share
        return -(-a * (x + y) // (a + b))  # b * shared >= a * (x + y - shared)

    def find(self, i: int, ranks: np.ndarray, size: int, held: np.ndarray, after: np.ndarray):
        """Link set i with the stored ones: `held[r]` tells its ranks, `after[r]` counts those from r on.

        Yields a stored set for each link that joins two components.
        """
        walk = [(self.root, 0)]
        while walk:
            node, shared = walk.pop()
            if node.group is not None and self.top(node.group) == self.top(i):
                continue
            if len(node.label):
                shared += int(np.count_nonzero(held[node.label]))
                left = int(after[node.label[-1] + 1])
            else:
                left = len(ranks)
            if shared + min(left, node.most - node.depth) < self._needed(size, node.least):
                continue
            for j, other in node.sets:
                if shared >= self._needed(size, other):
                    a, b = self.top(i), self.top(j)
                    if a != b:
                        self.component[max(a, b)] = min(a, b)
                        yield j
            walk.extend((kid, shared) for kid in node.kids.values())

    def add(self, i: int, ranks: np.ndarray, size: int) -> None:
        node, done = self.root, 0
        while True:
            node.least, node.most = min(node.least, size), max(node.most, len(ranks))
            if node.group is None:
                node.group = i if node is self.root and not node.kids and not node.sets else None
            elif self.top(node.group) != self.top(i):
                node.group = None
            if done == len(ranks):
                node.sets.append((i, size))
                return
            kid = node.kids.get(int(ranks[done]))
            if kid is None:
                kid = _Node(ranks[done:], len(ranks), size, len(ranks), i)
                kid.sets.append((i, size))
                node.kids[int(ranks[done])] = kid
                return
            reach = min(len(kid.label), len(ranks) - done)
            differ = np.flatnonzero(kid.label[:reach] != ranks[done:done + reach])
            same = int(differ[0]) if len(differ) else reach
            if same < len(kid.label):  # the run is cut: a node above takes its head
                upper = _Node(kid.label[:same], done + same, kid.least, kid.most, kid.group)
                kid.label = kid.label[same:]
                upper.kids[int(kid.label[0])] = kid
                node.kids[int(ranks[done])] = upper
                kid = upper
            node, done = kid, done + same


def linked(sets: list[np.ndarray], probes: list[bool], component: list[int], share: tuple[int, int] = SHARE):
    """Index pairs (i, j) that join components of the sets of one group; `component[i]` is the first
    index of i's component so far. Rows marked in `probes` only search, the others are stored too.

    The order of a tree is that of its group: n-grams of more sets first, then by hash, so similar
    sets share long paths. N-grams of a single set lie in no overlap and on no path.
    """
    sizes = [len(s) for s in sets]
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    shared = int((times > 1).sum())
    ranks, start = [], 0
    for n in sizes:
        own = np.sort(rank[place[start:start + n]])
        ranks.append(own[:np.searchsorted(own, shared)])
        start += n
    tree = Tree(component, share)
    held = np.zeros(shared + 1, dtype=bool)
    for i in sorted(range(len(sets)), key=lambda i: (bool(probes[i]), sizes[i])):
        own = ranks[i]
        held[own] = True
        after = np.concatenate([np.cumsum(held[::-1])[::-1], [0]])
        for j in tree.find(i, own, sizes[i], held, after):
            yield i, j
        held[own] = False
        if not probes[i]:
            tree.add(i, own, sizes[i])


def _joiner(share):
    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def same(table):
            out = np.ones(table.num_rows, dtype=bool)
            out[0] = False
            for c in ("h", "low", "high"):
                k = table.column(c).to_numpy()
                out[1:] &= k[1:] == k[:-1]
            return out

        for piece in regrouped(batches, same, 1):
            starts = np.flatnonzero(~same(piece))
            links = []
            for low, high in zip(starts, np.append(starts[1:], piece.num_rows)):
                rows = piece.slice(low, high - low)
                grams = rows.column("grams").combine_chunks()
                flat, at = grams.flatten().to_numpy().view(np.uint64), grams.offsets.to_numpy()
                sets = [flat[x:y] for x, y in zip(at - at[0], at[1:] - at[0])]
                first: dict = {}
                component = [first.setdefault(c, i) for i, c in enumerate(rows.column("component").to_pylist())]
                nodes = rows.column("node").to_pylist()
                links += [(nodes[i], nodes[j]) for i, j in linked(sets, rows.column("probe").to_pylist(), component, share)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"])
    return join


def _links(pieces: DataFrame, sets: DataFrame, share) -> DataFrame:
    """Links that the trees of all `pieces` (h, low, high, probe, component, node) find."""
    rows = pieces.join(sets, "node").select("h", "low", "high", "probe", "component", "node", "grams")
    dealt = rows.repartition("h", "low", "high").sortWithinPartitions("h", "low", "high")
    return dealt.mapInArrow(_joiner(share), "a binary, b binary")


def _blocks(total):
    return F.greatest(F.ceil(total / F.lit(PIECE)), F.lit(1)).cast("int")


def _meetings(rows: DataFrame) -> DataFrame:
    """(h, node, n): the distinct sets that share a key, with one key of all that the same sets share."""
    keys = rows.select("node", "n", F.explode("keys").alias("h"))
    by_key = keys.groupBy("h").agg(F.count(F.lit(1)).alias("sets"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                   F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("sets > 1")
    kept = written(by_key.groupBy("sets", "x", "y").agg(F.min("h").alias("h")).select("h"), "ngram-keys")
    return written(keys.join(small(kept, kept.count()), "h"), "ngram-meetings")


def _together(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces of all sets that chains of shared keys connect, where one piece can hold them, so that
    each is sent once; and the rows of `met` whose sets are too many for that."""
    first = met.groupBy("h").agg(F.min("node").alias("b"))
    chains = components(met.join(first, "h").select(F.col("node").alias("a"), "b"), "ngram-chains")
    nodes = met.select("node", "n").distinct().join(chains, "node")
    sizes = nodes.groupBy("root").agg(F.sum("n").alias("total"))
    nodes = written(nodes.join(sizes, "root").select("node", "root", (F.col("total") <= PIECE).alias("fits")), "ngram-nodes")
    whole = nodes.where("fits").select(F.xxhash64("root").alias("h"), F.lit(0).alias("low"), F.lit(0).alias("high"),
                                       F.lit(False).alias("probe"), F.col("node").alias("component"), "node")
    return whole, written(met.join(nodes.where("not fits").select("node"), "node", "left_semi"), "ngram-parts")


def _first_round(met: DataFrame, sets: DataFrame, share) -> DataFrame:
    """Links found where each set goes to its fullest key alone, the largest groups dealt into blocks by chance
    and, as long as there are such, dealt and joined once more."""
    sizes = met.groupBy("h").agg(F.count(F.lit(1)).alias("sets"))
    picked = met.join(sizes, "h").groupBy("node", "n").agg(F.max(F.struct("sets", "h"))["h"].alias("h"))
    picked = written(picked.where(F.col("h").isNotNull()), "ngram-picks")
    blocks = picked.groupBy("h").agg(_blocks(F.sum("n")).alias("blocks"))
    dealt = written(picked.join(blocks, "h"), "ngram-picks")
    rounds = 1 if (dealt.agg(F.max("blocks")).first()[0] or 0) <= 1 else 3
    found, component = None, None
    for k in range(rounds):
        rows = dealt if k == 0 else dealt.where("blocks > 1")
        rows = rows.withColumn("low", F.pmod(F.xxhash64(F.lit(k), "node"), F.col("blocks")).cast("int"))
        rows = _with_components(rows, component).select("h", "low", F.lit(0).alias("high"), F.lit(False).alias("probe"), "component", "node")
        links = written(_links(rows, sets, share), "ngram-links")
        found = links if found is None else found.unionByName(links)
        if k + 1 < rounds:
            component = components(found, "ngram-components")
    return found


def _with_components(rows: DataFrame, component: DataFrame | None) -> DataFrame:
    """`rows` with `component`: the root of their node, itself where it has no link."""
    if component is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(component, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")


def _last_round(met: DataFrame, sets: DataFrame, component: DataFrame, share) -> DataFrame:
    """Links between sets that share a key and lie in different components so far: all that are left.

    Of a key's sets those outside its largest component are stored in trees, block by block, and all
    its sets search each block, in pieces of bounded size.
    """
    rows = written(_with_components(met, component), "ngram-rows")
    parts = rows.groupBy("h", "component").agg(F.sum("n").alias("n"))
    open_keys = (parts.groupBy("h").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("total"),
                                        F.max(F.struct("n", "component")).alias("largest")).where("parts > 1")
                 .select("h", F.col("largest.component").alias("main"), _blocks(F.col("total") - F.col("largest.n")).alias("lows"),
                         _blocks(F.col("total")).alias("highs")))
    left = written(rows.join(open_keys, "h"), "ngram-rows")
    low, high = (F.pmod(F.xxhash64(F.lit(s), "node"), F.col(c)).cast("int") for s, c in ((2, "lows"), (3, "highs")))

    def every(c):
        return F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    stored = left.where("component <> main").withColumn("low", low).select(
        "h", "low", every("highs").alias("high"), F.lit(False).alias("probe"), "component", "node")
    asking = left.withColumn("high", high).where((F.col("component") == F.col("main")) | (F.col("lows") > 1)).select(
        "h", every("lows").alias("low"), "high", F.lit(True).alias("probe"), "component", "node")
    return written(_links(stored.unionByName(asking), sets, share), "ngram-links")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id): size of each row's n-gram set, and the least id reachable by links.

    Equal sets count as one row from the start. Sets that can link share a key (`meeting_keys`); keys
    that the same sets share count once, and sets that share none are done. The others go to one piece with all
    that chains of keys connect them to, and a prefix tree links what links there. Where such a chain
    is too large for a piece, each set goes to one group first; then keys whose sets lie in
    different components yet are joined in full. No group is capped: see `_last_round`. Rows without words have
    empty sets, linked with nothing; a null id counts as larger than all others and stays null; rows
    of one id are rows of their own; an empty table gives no rows. Only `key` and `text` are read.
    N-grams are compared by 64-bit hashes, sets by 128-bit digests.
    """
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    rows = written(texts.mapInArrow(_keyed(share), f"doc_id {kind}, n bigint, node binary, keys array<bigint>"), "ngram-sets")
    distinct = written(rows.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("first")), "ngram-distinct")
    once = rows.where(F.size("keys") > 0).dropDuplicates(["node"]).select("node", "n", "keys")
    met = _meetings(written(once, "ngram-once"))
    asked = written(met.select("node").distinct().join(distinct, "node").select("node", "first"), "ngram-asked")
    ids = asked.select(F.col("first").alias("asked_id")).distinct()
    sets = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("asked_id")), "left_semi")
    sets = written(sets.mapInArrow(_whole, "node binary, grams array<bigint>")
                   .join(asked.select("node"), "node", "left_semi").dropDuplicates(["node"]), "ngram-grams")
    whole, parts = _together(met)
    links = written(_links(whole, sets, share), "ngram-links")
    if not parts.isEmpty():
        links = links.unionByName(_first_round(parts, sets, share))
        links = links.unionByName(_last_round(parts, sets, components(links, "ngram-components"), share))
    found = components(links, "ngram-components")
    rooted = distinct.join(found, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
