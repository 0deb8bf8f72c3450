"""SimHash near-duplicates: fingerprints, bit-sliced comparison of buckets, and components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, functions as F

from brasstide.llm.common import regrouped, written

RADIUS = 3
#: Rows of one bucket that are compared in one piece; larger buckets are dealt out in pairs of blocks.
BLOCK = 4096
#: Shingle hashes whose bits are counted at once, within a long text and over short ones.
SLICE = 20_000
#: Rows a comparison task holds at once, beside one bucket.
PIECE = 65536


def _prints(batches: Iterator) -> Iterator:
    from array import array

    import numpy as np
    import pyarrow as pa
    import xxhash
    digest = xxhash.xxh64_intdigest

    for batch in batches:
        ones = np.zeros((batch.num_rows, 64), dtype=np.uint32)
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        hashes, rows, starts = array("Q"), [], []

        def count():
            """Adds the set bits of the hashes held so far to their texts' counts; a text may come in several parts."""
            if hashes:
                bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[rows] += np.add.reduceat(bits, starts, axis=0, dtype=np.uint32)
            return array("Q"), [], []

        for i, text in enumerate(batch.column(1)):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space parts
            if not words:
                continue
            sizes[i] = max(1, len(words) - 2)
            for at in range(0, int(sizes[i]), SLICE):
                part = words[at:at + SLICE + 2]
                rows.append(i)
                starts.append(len(hashes))
                grams = zip(part, part[1:], part[2:]) if len(words) > 2 else [part]
                hashes.extend(digest(b" ".join(g), 42) for g in grams)
                if len(hashes) >= SLICE:
                    hashes, rows, starts = count()
        count()
        prints = np.packbits(2 * ones.astype(np.int64) > sizes[:, None], axis=1, bitorder="little").reshape(-1).view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of the 3-word shingles of each whole text, as a signed long.

    A-Z are lower-cased and words parted at ASCII white space. Under three words the sequence is
    the only shingle; without words (null, empty) the fingerprint is zero. Repeats weigh again.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(_prints, f"doc_id {kind}, fp bigint")


def bands(rows: int, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Masks as lists of bit positions: prints within `radius` agree on all bits of one mask at least.

    The 64 bits are cut into b blocks; `radius` differing bits leave b - radius blocks alone. b is
    the least for which a bucket of evenly spread prints stays small, so buckets don't grow with the table.
    """
    b = radius + 1
    while b < 2 * radius + 2 and rows > 64 * 2 ** (64 * (b - radius) / b):
        b += 1
    edges = [round(64 * i / b) for i in range(b + 1)]
    blocks = [tuple(range(edges[i], edges[i + 1])) for i in range(b)]
    assert len(blocks) == b and comb(b, radius) >= 1
    return [tuple(x for i in keep for x in blocks[i]) for keep in combinations(range(b), b - radius)]


def near_pairs(prints, group_end, radius: int, order):
    """Index pairs (i, j), i < j, in one group and at most `radius` bits apart, shift by shift.

    `prints` (uint64) are sorted by group; `group_end[i]` is one past the last row of i's group.
    Bit planes lie vertically: word w of plane k holds bit k of rows 64w to 64w + 63. At shift d all
    rows i meet row i + d at once: each plane's XOR enters saturating carry-save counters (ones,
    twos, fours), and after every eight planes the words in which no row is within the radius are
    abandoned. `order` lists the planes, those that differ most within a group first.
    """
    import numpy as np
    n = len(prints)
    words = -(-n // 64)
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.zeros((64, (words + 1) * 64), dtype=np.uint8)
    planes[:, :n] = bits.T
    planes = np.packbits(planes, axis=1, bitorder="little").view("<u8")
    reach = np.zeros((words + 1) * 64, dtype=np.int64)
    reach[:n] = group_end - np.arange(n)  # row i meets i + 1 ... i + reach - 1
    furthest = int(reach.max()) if n else 0
    word_reach = reach.reshape(-1, 64).max(axis=1)
    one = np.uint64
    for d in range(1, furthest):
        at = np.flatnonzero(word_reach > d)
        if not len(at):
            break
        alive = np.packbits(reach.reshape(-1, 64)[at] > d, axis=1, bitorder="little").view("<u8").reshape(-1)
        hop, turn = divmod(d, 64)
        left = np.minimum(at + hop, words)
        right = np.minimum(at + hop + 1, words)
        ones = np.zeros(len(at), dtype="<u8")
        twos, fours, over = ones.copy(), ones.copy(), ones.copy()
        for k, plane in enumerate(order):
            p = planes[plane]
            other = p[left] if not turn else (p[left] >> one(turn)) | (p[right] << one(64 - turn))
            carry = p[at] ^ other
            ones, carry = ones ^ carry, ones & carry
            twos, carry = twos ^ carry, twos & carry
            over |= fours & carry
            fours ^= carry
            if k % 8 == 7:
                close = alive & ~_beyond(ones, twos, fours, over, radius)
                stay = np.flatnonzero(close)
                if len(stay) < len(at):
                    at, left, right = at[stay], left[stay], right[stay]
                    ones, twos, fours, over, close = ones[stay], twos[stay], fours[stay], over[stay], close[stay]
                alive = close
                if not len(at):
                    break
        if len(at):
            lane = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, bit = np.nonzero(lane)
            i = at[w] * 64 + bit
            yield i, i + d


def _beyond(ones, twos, fours, over, radius: int):
    """Lanes whose count (ones + 2 twos + 4 fours, or eight and more) exceeds the radius, for radius 0 to 7."""
    out = over.copy()
    higher = ~(ones ^ ones)  # lanes equal to the radius so far, from the highest digit on
    for digit, weight in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & weight:
            higher = higher & digit
        else:
            out |= higher & digit
            higher = higher & ~digit
    return out


def roots(n: int, pairs) -> "object":
    """Least index linked to each of n rows by the pair arrays."""
    import numpy as np
    label = np.arange(n)

    def contract(a, b):
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                flat = label[label]
                if (flat == label).all():
                    break
                label[:] = flat

    held, size = [], 0
    for a, b in pairs:
        held.append((a, b))
        size += len(a)
        if size > 500_000:
            contract(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held, size = [], 0
    if held:
        contract(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
    return label


def _linker(masks: list[tuple[int, ...]], radius: int):
    def link(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def same(table):
            keys = [table.column(c).to_numpy() for c in ("band", "value", "low", "high")]
            out = np.ones(table.num_rows, dtype=bool)
            out[0] = False
            for k in keys:
                out[1:] &= k[1:] == k[:-1]
            return out

        for piece in regrouped(batches, same, PIECE):
            joined = same(piece)
            starts = np.flatnonzero(~joined)
            ends = np.append(starts[1:], piece.num_rows)
            end = np.repeat(ends, ends - starts)
            prints = piece.column("fp").to_numpy().astype("<i8").view("<u8")
            in_band = set(masks[int(piece.column("band")[0].as_py())])
            order = [k for k in range(64) if k not in in_band] + sorted(in_band)
            label = roots(len(prints), near_pairs(prints, end, radius, order))
            moved = np.flatnonzero(label != np.arange(len(label)))
            signed = prints.view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[label[moved]])], names=["a", "b"])
    return link


def links(prints: DataFrame, rows: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): a forest over the distinct prints that joins all that a chain of links joins.

    Every pair within `radius` meets in a bucket of one band, or in one pair of its blocks; from
    each only a spanning forest comes out, never all pairs. No bucket is cut short: one larger than
    2 * BLOCK is dealt into blocks by hash and every two blocks meet in a piece of their own.
    """
    masks = bands(rows, radius)
    value = F.lit(0).cast("bigint")
    keys = []
    for b, mask in enumerate(masks):
        bit_mask = sum(1 << k for k in mask)
        signed = bit_mask - (1 << 64) if bit_mask >> 63 else bit_mask
        value = F.col("fp").bitwiseAND(F.lit(signed).cast("bigint"))
        keys.append(F.struct(F.lit(b).alias("band"), value.alias("value")))
    banded = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.band", "k.value")
    sizes = (banded.groupBy("band", "value").count().where(F.col("count") > 1)
             .withColumn("blocks", F.when(F.col("count") > 2 * BLOCK, F.ceil(F.col("count") / BLOCK)).otherwise(1).cast("int"))
             .drop("count"))
    shared = banded.join(sizes, ["band", "value"])  # drops buckets of one print, too
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (shared.withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("band", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp"))
    spread = dealt.repartition("band", "value", "low", "high").sortWithinPartitions("band", "value", "low", "high", "fp")
    return spread.mapInArrow(_linker(masks, radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node of each connected component, for every node on an edge.

    Rounds of large and small stars: each moves a node's neighbours to its least neighbour, by an
    aggregation (combined before the shuffle) and a join on the node, whose hot nodes Spark splits.
    Each round is stored in the shared folder. Ends when a round changes no edge.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of `docs`; component_id is the least reachable id.

    Equal fingerprints collapse to one before any comparison. Texts without words share the zero
    print and link like any other; a null id counts as larger than all others; an empty table
    gives no rows. Only `key` and `text` are read.
    """
    rows = written(fingerprints(docs, key, text), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    n = prints.count()
    found = components(links(prints.select("fp"), n, radius))
    rooted = prints.join(found, prints.fp == found.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """`docs` with one document of each component: its least id. Rows without an id all stay, as do
    repeated rows of a kept id that carry one text; of differing texts under one id all rows stay
    if the id is the least of any of their components."""
    found = classes(docs, key, text, radius)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept_id")).distinct()
    dropped = (found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("kept_id")).distinct()
               .join(kept, "kept_id", "left_anti"))
    return docs.join(dropped, docs[key] == dropped["kept_id"], "left_anti")
