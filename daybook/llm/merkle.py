"""A Merkle manifest of a dataset, with a proof for each row, by time-forward processing.

Leaves are numbered within their source by a distributed sort. Digests then travel to their parents as
messages in a priority queue ordered by node label: Spark's sorted shuffle is its external part, which
brings the messages of a round block by block in label order, and a heap holds the few that a block's own
nodes send. A node is done when all messages of its label have been taken. The reversed sweep takes the
labels from the root down, and delivers to each child what its proof has above it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, stream_groups

#: Children of a node, and the levels of a round: a block is a subtree of ARITY ** ROUND_LEVELS leaves.
ARITY, ROUND_LEVELS = 16, 2
#: A row of the tree of one round: the tree it belongs to, its place, its digest, the places of that tree.
NODE = "g string, idx long, digest string, n long"
MESSAGE = "g string, block long, suffix array<string>, about array<string>"


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def height(n: int, arity: int = ARITY) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def forward(digests: list[str], levels: int, arity: int = ARITY) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The digest at the top of a block, and the children of each of its nodes by label (level, place)."""
    queue = [(1, i // arity, i, d) for i, d in enumerate(digests)] if levels else []  # sorted, thus a heap
    children: dict[tuple[int, int], list[str]] = {}
    top = digests[0]
    while queue:
        label = queue[0][:2]
        own = children[label] = []
        while queue and queue[0][:2] == label:
            own.append(heapq.heappop(queue)[3])
        top = digest_of(own)
        if label[0] < levels:
            heapq.heappush(queue, (label[0] + 1, label[1] // arity, label[1], top))
    return top, children


def backward(children: dict[tuple[int, int], list[str]], levels: int, suffix: list[str], arity: int = ARITY) -> dict[int, list[str]]:
    """The proof of each leaf of a block: from its own run up to the root, the siblings before and after."""
    sent = {(levels, 0): suffix}
    for level, place in sorted(children, reverse=True):
        above, run = sent.pop((level, place)), children[level, place]
        for k in range(len(run)):
            sent[level - 1, place * arity + k] = ["".join(run[:k]), "".join(run[k + 1 :]), *above]
    return {place: proof for (_, place), proof in sent.items()}


def fold_proof(digest: str, proof: list[str]) -> str:
    """The root that a digest and its proof give."""
    for before, after in zip(proof[::2], proof[1::2], strict=True):
        digest = digest_of([before, digest, after])
    return digest


def _levels(n: int, arity: int, most: int) -> int:
    return height(n, arity) if n <= arity**most else most


def _raised(arity: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for (g, block), block_rows in stream_groups(batches, ["g", "block"]):
            n = int(block_rows["n"].iloc[0])
            rows.append((g, int(block), forward(block_rows["digest"].tolist(), _levels(n, arity, most), arity)[0], -(-n // arity**most)))
        yield pd.DataFrame(rows, columns=["g", "idx", "digest", "n"])

    return run


def _lowered(arity: int, most: int, give):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (g, _), rows in stream_groups(batches, ["g", "block"]):
            message, nodes = rows.iloc[0], rows.iloc[1:]
            levels = _levels(int(nodes["n"].iloc[0]), arity, most)
            _, children = forward(nodes["digest"].tolist(), levels, arity)
            proofs = backward(children, levels, list(message["suffix"]), arity)
            yield give(g, nodes, [proofs[i] for i in range(len(nodes))], list(message["about"]))

    return run


def _give_messages(g, nodes: pd.DataFrame, proofs: list[list[str]], about: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"g": g, "block": nodes["idx"], "suffix": proofs, "about": [about] * len(nodes)})


def _give_trees(g, nodes: pd.DataFrame, proofs: list[list[str]], about: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"g": nodes["name"], "block": 0, "suffix": proofs, "about": [[d, *about] for d in nodes["digest"]]})


def _give_leaves(with_proofs: bool):
    def give(g, nodes: pd.DataFrame, proofs: list[list[str]], about: list[str]) -> pd.DataFrame:
        subroot, root = about
        folded = [fold_proof(d, p) for d, p in zip(nodes["tampered"], proofs, strict=True)]
        out = pd.DataFrame({"name": nodes["name"], "leaf": nodes["digest"], "subroot": subroot, "root": root, "proof_sha256": [digest_of(p) for p in proofs], "folded_root": folded, "verified": [f == root for f in folded]})
        return out.assign(proof=proofs) if with_proofs else out

    return give


class Tree:
    """The trees of all groups g of leaves (g, digest, others), placed in the order of some columns."""

    def __init__(self, spark: SparkSession, leaves: DataFrame, order: list[str], arity: int, most: int):
        self.spark, self.arity, self.most, self.block = spark, arity, most, arity**most
        self.rounds = [materialise(spark, self._placed(leaves, order), "leaves")]
        self.roots = []
        most_leaves = self.rounds[0].agg(F.max("n")).first()[0] or 0
        while most_leaves:
            tops = materialise(spark, self._in_blocks(self.rounds[-1]).mapInPandas(_raised(arity, most), NODE), "nodes")
            self.roots.append(tops.where("n = 1").select("g", "digest"))
            most_leaves = -(-most_leaves // self.block)
            if most_leaves == 1:
                break
            self.rounds.append(tops.where("n > 1"))

    def _placed(self, leaves: DataFrame, order: list[str]) -> DataFrame:
        """Leaves with their place in the group and the group's size; no task gets a whole group."""
        keys = ["g", *order]
        rows = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
        rows = materialise(self.spark, rows, "sorted")
        runs = rows.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
        group = Window.partitionBy("g")
        runs = runs.withColumns({"before": F.sum("k").over(group.orderBy("part")) - F.col("k"), "n": F.sum("k").over(group)})
        return rows.join(runs, ["g", "part"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "k", "before")

    def _in_blocks(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", F.floor(F.col("idx") / self.block).cast("long")).repartition("g", "block").sortWithinPartitions("g", "block", "idx")

    def tops(self) -> DataFrame:
        """The root of each group."""
        out = self.spark.createDataFrame([], "g string, digest string")
        for roots in self.roots:
            out = out.unionByName(roots)
        return out

    def deliver(self, start: DataFrame, give, schema: str) -> DataFrame:
        """The reversed sweep: start has a message (g, suffix, about) for each group's root; give makes rows
        of a block of leaves, their proofs and the message's other content."""
        sent = self.spark.createDataFrame([], MESSAGE)
        for k in range(len(self.rounds) - 1, -1, -1):
            nodes = self.rounds[k]
            ends = nodes.where((F.col("n") <= self.block) & (F.col("idx") == 0)).select("g")
            messages = sent.unionByName(start.join(ends, "g").select("g", F.lit(0).cast("long").alias("block"), "suffix", "about"))
            here = nodes.unionByName(messages.withColumns({"idx": F.lit(-1).cast("long"), "n": F.lit(0).cast("long")}), allowMissingColumns=True)
            block = F.coalesce("block", F.floor(F.col("idx") / self.block).cast("long"))
            here = here.withColumn("block", block).repartition("g", "block").sortWithinPartitions("g", "block", "idx")
            sent = here.mapInPandas(_lowered(self.arity, self.most, give if k == 0 else _give_messages), schema if k == 0 else MESSAGE)
            if k:
                sent = materialise(self.spark, sent, "suffixes")
        return sent


def manifest(
    spark: SparkSession, docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: dict[str, Column] | None = None, with_proofs: bool = False, arity: int = ARITY, round_levels: int = ROUND_LEVELS,
) -> DataFrame:
    """One row for each row of docs: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the sha256 of the columns' fields. Each group's leaves, by ascending key, make a tree of runs of
    arity nodes; the groups' roots, by group (null first, then bytewise), make the tree whose root is that of
    the dataset. tampered gives expressions for columns whose values are to be verified in place of the
    stored ones. A proof is the siblings level by level; with_proofs adds it as an array of what stands
    before and after the node in each level, for fold_proof.

    Null keys come first. Rows that share a key are ordered by their leaves, equal rows as they come: they are
    alike. A null is a field of its own, unlike an empty string. A dataset of one row is its own root with an
    empty proof; an empty one gives no rows. Other columns are ignored.
    """
    held = {c: docs[c] for c in columns}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit("-")).alias("g"), docs[key].alias("key"), docs[key].cast("string").alias("name"),
        leaf_digest(list(held.values())).alias("digest"), leaf_digest(list({**held, **(tampered or {})}.values())).alias("tampered"),
    )
    leaves = materialise(spark, leaves, "digests").withColumn("row", F.monotonically_increasing_id())  # texts are read once
    groups = Tree(spark, leaves, ["key", "digest", "row"], arity, round_levels)
    whole = Tree(spark, groups.tops().select(F.lit("").alias("g"), "digest", F.col("g").alias("name")), ["name"], arity, round_levels)
    none = F.array().cast("array<string>")
    start = whole.tops().select("g", none.alias("suffix"), F.array("digest").alias("about"))
    roots = materialise(spark, whole.deliver(start, _give_trees, MESSAGE), "roots")
    schema = "name string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<string>" * with_proofs
    found = groups.deliver(roots.drop("block"), _give_leaves(with_proofs), schema)
    return found.withColumn("name", F.col("name").cast(docs.schema[key].dataType)).withColumnRenamed("name", key)
