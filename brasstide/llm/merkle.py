"""Merkle manifest of a table: trees of fan-out 8 with few stored levels, and proofs made by recomputing the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from brasstide.llm.common import written

FAN = 8
#: Levels from one stored level to the next; what lies between is recomputed for each proof.
STRIDE = 3
SPAN = FAN ** STRIDE
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    """`strata[s]` holds the nodes of level s * STRIDE of every group's tree as (tree, at, node, total):
    position `at` among `total` nodes; a finished tree keeps its subroot. `top` likewise for the
    one tree over the subroots, `root` its hash (None for an empty table)."""
    leaves: DataFrame
    strata: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def leaf(columns: list[Column]) -> Column:
    """SHA-256 in lowercase hex of the columns one after another: `-` for a null, else bytes, colon, value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]), 256)


def _indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (tree, ...) with `at`, the place in its tree by `order`, and `total`, the tree's rows.

    Sorted by range and stored with the writer's row numbers; a tree's places follow from the
    counts of its rows in each part file, a table of one row per file and tree.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    stored = written(ranged.withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    part = F.shiftright("row", 33)
    counts = stored.groupBy("tree", part.alias("part")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    by_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("tree", "part", (before - F.col("first")).alias("base"), F.sum("n").over(by_tree).alias("total"))
    return (stored.withColumn("part", part).join(bases, ["tree", "part"])
            .withColumn("at", F.col("row") + F.col("base")).drop("part", "row", "base"))


def _raised(nodes: Column, total: Column) -> Column:
    """The one node above an aligned run of at most SPAN nodes, STRIDE levels up or at the top of its tree."""
    def level(a):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / FAN).cast("int")),
                           lambda i: F.sha2(F.array_join(F.slice(a, i * FAN + 1, FAN), ""), 256))
    for k in range(STRIDE):
        nodes = F.when(total > FAN ** k, level(nodes)).otherwise(nodes)
    return nodes[0]


def _strata(nodes: DataFrame) -> list[DataFrame]:
    """Stored levels from `nodes` (tree, at, node, total) up to one node a tree."""
    found = [nodes]
    while (found[-1].agg(F.max("total")).first()[0] or 0) > 1:
        low = found[-1]
        runs = low.groupBy("tree", F.floor(F.col("at") / SPAN).alias("at"), "total").agg(
            F.array_sort(F.collect_list(F.struct("at", "node"))).alias("run"))  # at most SPAN rows
        raised = runs.select("tree", "at", _raised(F.col("run.node"), F.col("total")).alias("node"),
                             F.ceil(F.col("total") / SPAN).alias("total"))
        found.append(written(raised, "merkle-level"))
    return found


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = COLUMNS,
             claims: dict[str, Column] | None = None) -> Manifest:
    """Leaves and stored levels of `docs`: one tree per value of `group`, leaves by ascending `key`.

    A null group comes first, then groups by UTF-8 bytes; null keys come before others, and rows of
    one key by their hash, so equal rows may stand in any order. `claims` replaces columns in the
    second hash of each row, `claim`, which `proofs` folds in the leaf's place. Only hashes, keys and
    groups are stored and shuffled. An empty table has a manifest without rows or root.
    """
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    plain = [F.col(c) for c in columns]
    changed = [(claims or {}).get(c, F.col(c)) for c in columns]
    hashed = docs.select(tree.alias("tree"), F.col(key).alias("doc_id"), leaf(plain).alias("node"), leaf(changed).alias("claim"))
    leaves = _indexed(written(hashed.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves"),
                      ["doc_id", "node", "tie"]).drop("tie")
    leaves = written(leaves, "merkle-leaves")
    strata = _strata(leaves.select("tree", "at", "node", "total"))
    subroots = strata[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    named = written(_indexed(subroots, ["name"]), "merkle-subroots")
    top = _strata(named.select("tree", "at", "node", "total"))
    root = top[-1].select("node").first()
    return Manifest(leaves, strata, [named, *top[1:]], root[0] if root else None)


def _walk(nodes: list[str], total: int):
    """Per node of an aligned run: the joined siblings left and right of its path, level by level."""
    from hashlib import sha256
    lefts: list[list[str]] = [[] for _ in nodes]
    rights: list[list[str]] = [[] for _ in nodes]
    level, step = nodes, 1
    for _ in range(STRIDE):
        if total <= 1:
            break
        for i in range(len(nodes)):
            at = i // step
            low = at - at % FAN
            lefts[i].append("".join(level[low:at]))
            rights[i].append("".join(level[at + 1:low + FAN]))
        level = [sha256("".join(level[k:k + FAN]).encode()).hexdigest() for k in range(0, len(level), FAN)]
        total, step = -(-total // FAN), step * FAN
    return lefts, rights


_PATH = "tree string, at bigint, subroot string, lefts array<string>, rights array<string>"


def _paths_below(run, above):
    """Paths of one aligned run's nodes: their siblings inside it, then the path of the node above."""
    import pyarrow as pa
    run, up = run.sort_by("at"), above.to_pylist()[0]
    lefts, rights = _walk(run.column("node").to_pylist(), run.column("total")[0].as_py())
    n = run.num_rows
    return pa.table({"tree": run.column("tree"), "at": run.column("at"), "subroot": pa.array([up["subroot"]] * n, pa.string()),
                     "lefts": pa.array([x + up["lefts"] for x in lefts], pa.list_(pa.string())),
                     "rights": pa.array([x + up["rights"] for x in rights], pa.list_(pa.string()))})


def _folded(run, above):
    """Of one aligned run's leaves: hash of the proof, and the root that the claimed leaf folds to."""
    from hashlib import sha256

    import pyarrow as pa
    run, up = run.sort_by("at"), above.to_pylist()[0]
    lefts, rights = _walk(run.column("node").to_pylist(), run.column("total")[0].as_py())
    proof, fold = [], []
    for claim, left, right in zip(run.column("claim").to_pylist(), lefts, rights):
        digest = sha256()
        for a, b in zip(left + up["lefts"], right + up["rights"]):
            digest.update(a.encode() + b.encode())
            claim = sha256(f"{a}{claim}{b}".encode()).hexdigest()
        proof.append(digest.hexdigest())
        fold.append(claim)
    return pa.table({"doc_id": run.column("doc_id"), "leaf": run.column("node"), "subroot": pa.array([up["subroot"]] * run.num_rows, pa.string()),
                     "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(fold, pa.string())})


def _meet(nodes: DataFrame, paths: DataFrame, task, schema: str) -> DataFrame:
    """Aligned runs of stored nodes with the path of the stored node above each."""
    run = F.floor(F.col("at") / SPAN).alias("run")
    return nodes.groupBy("tree", run).cogroup(paths.groupBy("tree", F.col("at").alias("run"))).applyInArrow(task, schema)


def _down(strata: list[DataFrame], paths: DataFrame) -> DataFrame:
    """Paths of the nodes of strata[1], from those of the trees' single nodes: level by level, from the top."""
    for nodes in strata[-2:0:-1]:
        paths = _meet(nodes, paths, _paths_below, _PATH)
    return paths


def proofs(found: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    Between two stored levels nothing is kept: a task takes an aligned run of at most SPAN nodes,
    hashes the levels between anew, hands each node its siblings joined to the path of the stored
    node above, and drops them. Paths go from the root down, one row per stored node; of leaves
    only hashes come out. `proof_sha256` hashes all siblings from the leaf's level to the root.
    A tree of one leaf has it as subroot; the proof then begins at the tree over the subroots.
    """
    none = F.array().cast("array<string>")
    spark = found.leaves.sparkSession
    start = spark.createDataFrame([("", 0, "")], "tree string, at bigint, subroot string").select(
        "*", none.alias("lefts"), none.alias("rights"))
    top = _down(found.top, start)
    if len(found.top) > 1:
        top = _meet(found.top[0].select("tree", "at", "node", "total"), top, _paths_below, _PATH)
    names = found.top[0].select("at", F.col("name").alias("tree"), F.col("node").alias("subroot"))
    paths = top.select("at", "lefts", "rights").join(names, "at").select(
        "tree", F.lit(0).cast("bigint").alias("at"), "subroot", "lefts", "rights")
    key = found.leaves.schema["doc_id"].dataType.simpleString()
    out = _meet(found.leaves, _down(found.strata, paths), _folded,
                f"doc_id {key}, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(found.root).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == root).alias("verified"))
