"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf: a digest of all its columns. The rows of one group (a language) are the leaves of a tree in the order
of their identifiers, and the roots of the groups are the leaves of one more tree, whose root stands for the dataset.

A node is labelled (tree, level, index), so that sorting by label puts every node before its parent. Nodes send
messages forward along that order: a child's digest to its parent on the way up, a parent's proof suffix to its children
on the reversed sweep. The queue of messages is external. Between tasks it is a shuffle keyed and sorted by label:
a task owns a block, the subtree over `span` consecutive nodes, pops its messages in order of the label and sends on one digest,
so each round of shuffles climbs as many levels as a block is high and moves a `span`-th of the rows of the round before. Inside
a block, whose size does not grow with the data, the queue is a heap. The reversed sweep opens the blocks from the
top down, each with the suffix that the round above has delivered to its root, and ends with the leaves, where the suffix is the
whole proof. Only counts of rounds reach the driver.

Defined results: a null column is written `-`, which no value is; a null identifier comes before all others and a null
group before all groups; rows that share an identifier are ordered by their leaf, and equal rows are leaves of their own; a lone leaf is the
root of its tree; an empty table gives no rows; texts of any length are hashed whole; columns other than those named are ignored,
whatever their names. Groups are compared by their UTF-8 bytes. One group may hold all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import written
from .common import numbered

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT, SPAN_LEVELS = 2, 10
#: One step of a proof: the digests left and right of the node in its run, either may be empty.
Step = tuple[str, str]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as its length in bytes, a colon and itself; `-` if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def climb(digests: Sequence[str], levels: int, fan_out: int = FAN_OUT) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The root of a block and, for each node above its leaves, the digests of its children.

    The heap holds (level, index of the parent, place in its run, digest), so that the messages of the next node are always
    on top; a node that has them all is hashed and sends its digest on.
    """
    queue = [(1, i // fan_out, i % fan_out, d) for i, d in enumerate(digests)]  # in order: a heap
    runs: dict[tuple[int, int], list[str]] = {}
    if not levels:
        return digests[0], runs
    while True:
        level, index = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, index):
            run.append(heappop(queue)[3])
        runs[level, index] = run
        node = digest("".join(run))
        if level == levels:
            return node, runs
        heappush(queue, (level + 1, index // fan_out, index % fan_out, node))


def descend(runs: dict[tuple[int, int], list[str]], levels: int, suffix: list[Step], count: int, fan_out: int = FAN_OUT) -> list[list[Step]]:
    """The proof of each leaf of a block, from the suffix of its root: the sweep of `climb` reversed."""
    proofs: list[list[Step]] = [suffix] * count
    queue = [(-levels, 0, suffix)] if levels else []
    while queue:
        level, index, suffix = heappop(queue)
        run = runs[-level, -index]
        for place in range(len(run)):
            own = [("".join(run[:place]), "".join(run[place + 1 :])), *suffix]
            child = -index * fan_out + place
            if level == -1:
                proofs[child] = own
            else:
                heappush(queue, (level + 1, -child, own))
    return proofs


def fold(node: str, proof: Sequence[Step]) -> str:
    """The root that a leaf and its proof lead to."""
    for left, right in proof:
        node = digest(left + node + right)
    return node


def _written_steps(proof: list[Step]) -> str:
    return "/".join(f"{left},{right}" for left, right in proof)


def _read_steps(text: str | None) -> list[Step]:
    return [tuple(step.split(",")) for step in text.split("/")] if text else []  # type: ignore[misc]


def _levels(nodes: int, fan_out: int, most: int) -> int:
    """How many levels lie above so many nodes, up to `most`."""
    levels = 0
    while nodes > 1 and levels < most:
        nodes, levels = -(-nodes // fan_out), levels + 1
    return levels


def _blocks(nodes: DataFrame, fan_out: int, span_levels: int) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_at") / fan_out**span_levels).cast("long"))


def climbed(nodes: DataFrame, fan_out: int = FAN_OUT, span_levels: int = SPAN_LEVELS) -> list[DataFrame]:
    """Rounds of nodes (tree, _at, n, node), the given ones first; the last has one node a tree, its root. All are stored."""

    def block(table):
        import pyarrow as pa

        order = table.column("_at").to_numpy().argsort()
        digests = table.column("node").take(pa.array(order)).to_pylist()
        n = table.column("n")[0].as_py()
        root, _ = climb(digests, _levels(n, fan_out, span_levels), fan_out)
        above = -(-n // fan_out**span_levels)
        return pa.table({"tree": table.column("tree")[:1], "_at": table.column("_block")[:1], "n": pa.array([above], pa.int64()), "node": [root]})

    rounds = [nodes]
    while rounds[-1].where("n > 1").limit(1).count():
        level = _blocks(rounds[-1], fan_out, span_levels)
        rounds.append(written(level.groupBy("tree", "_block").applyInArrow(block, "tree string, _at long, n long, node string")))
    return rounds


def _swept(nodes: DataFrame, suffixes: DataFrame, give: Callable, schema: str, fan_out: int, span_levels: int) -> DataFrame:
    """One round of the reversed sweep over the blocks of `nodes`.

    `suffixes` has a row (tree, _at, proof, ...) for the root of each block; `give` makes a block's result of its nodes, their
    proofs and that row.
    """

    def block(left, right):
        left = left.take(left.column("_at").to_numpy().argsort())
        digests = left.column("node").to_pylist()
        levels = _levels(left.column("n")[0].as_py(), fan_out, span_levels)
        _, runs = climb(digests, levels, fan_out)
        above = right.to_pylist()[0]
        return give(left, descend(runs, levels, _read_steps(above["proof"]), len(digests), fan_out), above)

    below = _blocks(nodes, fan_out, span_levels)
    return below.groupBy("tree", "_block").cogroup(suffixes.withColumnRenamed("_at", "_block").groupBy("tree", "_block")).applyInArrow(block, schema)


def _strings(values: Sequence[str]):
    import pyarrow as pa

    return pa.array(values, pa.string())


def delivered(rounds: list[DataFrame], suffixes: DataFrame, fan_out: int = FAN_OUT, span_levels: int = SPAN_LEVELS) -> DataFrame:
    """The suffixes (tree, _at, proof, subroot, root) of the blocks of the first round, from those of the trees' roots. Each round is stored."""

    def give(nodes, proofs, above):
        import pyarrow as pa

        n = len(proofs)
        return pa.table({
            "tree": nodes.column("tree"), "_at": nodes.column("_at"), "proof": _strings([_written_steps(p) for p in proofs]),
            "subroot": _strings([above["subroot"]] * n), "root": _strings([above["root"]] * n),
        })

    for nodes in reversed(rounds[1:-1]):
        suffixes = written(_swept(nodes, suffixes, give, "tree string, _at long, proof string, subroot string, root string", fan_out, span_levels))
    return suffixes


def manifest(rows: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", tampered: dict[str, Column] | None = None,
             tampered_where: Column | None = None, fan_out: int = FAN_OUT, span_levels: int = SPAN_LEVELS, with_proof: bool = False) -> DataFrame:
    """One row for each row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked for, the proof.

    The proof lists the digests `left,right` of the node's run for each level, from the leaf up, joined by `/`.
    `tampered` replaces columns in the rows where `tampered_where` holds: their folded_root is recomputed from the changed leaf and
    the proof of the original.
    """
    columns = list(columns)
    own = [F.col(f"`{c}`") for c in columns]
    other = [(tampered or {}).get(c, F.col(f"`{c}`")) for c in columns]
    where = F.lit(False) if tampered_where is None else F.coalesce(tampered_where, F.lit(False))
    group = F.col(f"`{group_col}`").cast("string")
    leaves = rows.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),  # null before all others
        leaf(*own).alias("node"), F.when(where, leaf(*other)).alias("changed"),
    )
    placed = written(numbered(written(leaves), ["tree"], ["doc_id", "node"]))
    rounds = climbed(placed, fan_out, span_levels)
    subroots = written(numbered(written(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "node")), ["tree"], ["group"]))
    tops = climbed(subroots, fan_out, span_levels)

    def give_top(nodes, proofs, above):
        import pyarrow as pa

        return pa.table({
            "tree": nodes.column("group"), "_at": pa.array([0] * len(proofs), pa.int64()), "proof": _strings([_written_steps(p) for p in proofs]),
            "subroot": nodes.column("node"), "root": _strings([above["root"]] * len(proofs)),
        })

    def give_leaf(nodes, proofs, above):
        import pyarrow as pa

        n, root = len(proofs), above["root"]
        folded = [fold(node if new is None else new, proof) for node, new, proof in zip(nodes.column("node").to_pylist(), nodes.column("changed").to_pylist(), proofs, strict=True)]
        out = {
            "doc_id": nodes.column("doc_id"), "leaf": nodes.column("node"), "subroot": _strings([above["subroot"]] * n), "root": _strings([root] * n),
            "proof_sha256": _strings([digest("".join(left + right for left, right in proof)) for proof in proofs]),
            "folded_root": _strings(folded), "verified": pa.array([f == root for f in folded], pa.bool_()),
        }
        return pa.table(out | ({"proof": _strings([_written_steps(p) for p in proofs])} if with_proof else {}))

    suffix = "tree string, _at long, proof string, subroot string, root string"
    top = tops[-1].select("tree", "_at", F.lit("").alias("proof"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    heads = written(_swept(subroots, delivered(tops, top, fan_out, span_levels), give_top, suffix, fan_out, span_levels))
    kind = leaves.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof string" * with_proof
    return _swept(placed, delivered(rounds, heads, fan_out, span_levels), give_leaf, schema, fan_out, span_levels)
