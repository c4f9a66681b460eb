"""Merkle manifest of a table: a tree of its rows per group, a tree over the groups, and a proof for every row.

A leaf is the SHA-256 of a row's fields. The leaves of a group, in order, form a tree of ``ARITY`` children a node (the
last node of a level may have fewer); what is left is the group's root. The groups' roots, in order of the group, form
the top tree in the same way; what is left of it is the root of the manifest. Digests are joined as lowercase hex.

1. Rows are sorted into ranges of about ``ROWS`` rows. Places in a group come from the counts of each range, so a group that holds
   most of the table is cut like any other. A range is a *leaf partition*.
2. Blocks of ``ARITY ** DEEP`` nodes become whole subtrees by array functions, and so on with what is left of each block: two or three
   shuffles of digests for any table. All nodes are written once.
3. Octopus multiproof: from its leaves' coordinates alone, a leaf partition works out the smallest set of nodes that its proofs
   need and that its own leaves do not give (``missing``). These are fetched in one join for all partitions.
4. Each partition derives the interior that its leaves share, and writes out the proofs of its rows from it. A proof is folded again
   from the row's leaf, or from another leaf where the row is said to have been changed.

Result: one row for each row of the table, repeated rows included (they are leaves side by side; equal keys are ordered by
leaf). NULL keys come first in a group, the NULL group first of all. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.stored import stored, stored_table

ARITY = 3
#: Levels of a block that one shuffle builds: 2,187 digests of 64 bytes.
DEEP = 7
#: Rows of a leaf partition.
ROWS = 20_000
#: Tree names: the trees of the groups and the tree over their roots.
GROUP, TOP = 0, 1


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(column: Column | str, text: bool) -> Column:
    """A field of a leaf: ``-`` for NULL, else its size in bytes, a colon and the value."""
    value = F.col(column) if isinstance(column, str) else column
    value = value if text else value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(fields: dict[str, Column]) -> Column:
    """The digest of a row: its fields (by type name "text" or "number" in the key's end) one after the other."""
    return F.sha2(F.concat(*(field(c, name.endswith(":text")) for name, c in fields.items())), 256)


def depth(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def depth_of(n: str) -> Column:
    """depth() of a column: the powers of the arity below n."""
    powers = [ARITY**k for k in range(64) if ARITY**k < 1 << 63]
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < F.col(n)))


def missing(leaves: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The nodes (level, places) that the proofs of these leaves of a tree of ``n`` need and that the leaves themselves do not give."""
    known, out = np.unique(leaves), []
    for level in range(depth(n)):
        parents = np.unique(known // ARITY)
        children = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append((level, np.setdiff1d(children[children < n], known, assume_unique=True)))
        known, n = parents, -(-n // ARITY)
    return out


def placed(frame: DataFrame, groups: list[str], order: list[str], count: int) -> tuple[DataFrame, DataFrame]:
    """``frame`` sorted into ranges and written, with its range (``part``) and its place in its group (``place``), and the runs.

    A run (part, groups, n, first, start) is what a range holds of a group: rows, first row number and places before it.
    """
    keys = [*groups, *order]
    spread = frame.withColumn("spread", F.rand(11))  # equal rows need not share a range
    ranged = spread.repartitionByRange(max(1, -(-count // ROWS)), *keys, "spread").sortWithinPartitions(*keys, "spread")
    rows = stored_table(ranged.drop("spread").withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("part", *groups).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    runs = stored(runs.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))))
    return rows, runs


def with_places(rows: DataFrame, runs: DataFrame, groups: list[str]) -> DataFrame:
    on = F.col("rows.part") == F.col("runs.part")
    for g in groups:
        on = on & F.col(f"rows.{g}").eqNullSafe(F.col(f"runs.{g}"))
    joined = rows.alias("rows").join(runs.alias("runs"), on)
    return joined.select("rows.*", (F.col("rows.at") - F.col("runs.first") + F.col("runs.start")).alias("place"))


def parents(digests: Column) -> Column:
    """The digests of the next level."""
    starts = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / ARITY).cast("int"))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(digests, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def tree(leaves: DataFrame, tree_name: int, most: int) -> DataFrame:
    """(tree, group, level, place, digest) of all nodes; ``leaves`` has group, n (leaves of the group), place and digest.

    ``most`` is the largest n. A round builds ``DEEP`` levels of each block in one row.
    """
    nodes = leaves.select("group", "n", "place", "digest", depth_of("n").alias("levels"))
    out = nodes.select(F.lit(tree_name).alias("tree"), "group", F.lit(0).alias("level"), "place", "digest")
    base = 0
    while base < depth(most):
        block = F.floor(F.col("place") / ARITY**DEEP).cast("long").alias("block")
        sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
        blocks = nodes.filter(F.col("levels") > base).groupBy("group", "n", "levels", block).agg(sorted_.alias("level_0"))
        for k in range(DEEP):
            blocks = blocks.withColumn(f"level_{k + 1}", F.when(F.col("levels") > base + k, parents(F.col(f"level_{k}"))).otherwise(F.array().cast("array<string>")))
        found = F.array(*(F.struct(F.lit(base + k).alias("level"), F.pow(F.lit(ARITY), DEEP - k).cast("long").alias("width"), F.col(f"level_{k}").alias("digests")) for k in range(1, DEEP + 1)))
        each = blocks.select("group", "n", "levels", "block", F.explode(found).alias("x"))
        above = each.select("group", "n", "levels", F.col("x.level").alias("level"), F.col("block"), F.col("x.width").alias("width"), F.posexplode("x.digests").alias("i", "digest"))
        above = stored_table(above.select("group", "n", "levels", "level", (F.col("block") * F.col("width") + F.col("i")).alias("place"), "digest"))
        out = out.union(above.select(F.lit(tree_name), "group", "level", "place", "digest"))
        base += DEEP
        nodes = above.filter(F.col("level") == base)
    return out


def needed(runs: DataFrame) -> DataFrame:
    """(part, tree, group, level, place) of the nodes that each leaf partition fetches.

    ``runs`` has part, rank (of the group in the top tree), n, start, size (leaves of the group) and groups (leaves of the top tree). A partition's
    runs are one group of the shuffle: as many rows as it has groups.
    """

    def coordinates(batch: pd.DataFrame) -> pd.DataFrame:
        part, top = int(batch["part"].iloc[0]), int(batch["groups"].iloc[0])
        out = [(part, TOP, 0, depth(top), 0)]
        for rank, n, start, size in batch[["rank", "n", "start", "size"]].itertuples(index=False):
            for level, places in missing(np.arange(start, start + n), size):
                out.extend((part, GROUP, rank, level, p) for p in places.tolist())
        for level, places in missing(batch["rank"].to_numpy(), top):
            out.extend((part, TOP, 0, level, p) for p in places.tolist())
        return pd.DataFrame(out, columns=["part", "tree", "group", "level", "place"])

    return runs.groupBy("part").applyInPandas(coordinates, "part long, tree int, group long, level int, place long")


class Known:
    """The nodes of one tree that a partition knows: its own leaves, what it fetched, and what follows from both."""

    def __init__(self, leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int):
        self.levels, self.sizes = [dict(leaves)], [n]
        own = sorted(leaves)
        for level in range(depth(n)):
            now, above = self.levels[-1], {}
            now.update((place, digest) for (at, place), digest in fetched.items() if at == level)
            for parent in dict.fromkeys(i // ARITY for i in own):
                above[parent] = digest_of([now[i] for i in self.children(level, parent)])
            own = list(above)
            self.levels.append(above)
            self.sizes.append(-(-self.sizes[-1] // ARITY))
        self.tails: list[dict[int, str]] = [{} for _ in self.levels]

    def children(self, level: int, parent: int) -> range:
        return range(parent * ARITY, min(parent * ARITY + ARITY, self.sizes[level]))

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def proof(self, place: int, level: int = 0) -> str:
        """The siblings on the way up from a node; what nodes share is joined once."""
        if level == len(self.levels) - 1:
            return ""
        parent, now = place // ARITY, self.levels[level]
        tails = self.tails[level + 1]
        if parent not in tails:
            tails[parent] = self.proof(parent, level + 1)
        return "".join([now[i] for i in self.children(level, parent) if i != place]) + tails[parent]

    def fold(self, place: int, digest: str) -> str:
        """The root with another digest at ``place`` of the leaves."""
        for level in range(len(self.levels) - 1):
            now = self.levels[level]
            digest = digest_of([digest if i == place else now[i] for i in self.children(level, place // ARITY)])
            place //= ARITY
        return digest


#: Columns of proofs(), after those of the key.
PROVED = ["leaf", "subroot", "root", "proof", "folded_root"]


def prove(rows: dict[str, list], fetched: dict[str, list]) -> dict[str, list]:
    """The proofs of the rows of one leaf partition (group, size, groups, place, leaf, changed)."""
    trees: dict[tuple[int, int], dict[tuple[int, int], str]] = {}
    for tree_name, group, level, place, digest in zip(*(fetched[c] for c in ("tree", "group", "level", "place", "digest")), strict=True):
        trees.setdefault((tree_name, group), {})[level, place] = digest
    top_size = rows["groups"][0]
    root = trees[TOP, 0][depth(top_size), 0]
    members: dict[int, dict[int, str]] = {}
    sizes = dict(zip(rows["group"], rows["size"], strict=True))
    for group, place, leaf in zip(rows["group"], rows["place"], rows["leaf"], strict=True):
        members.setdefault(group, {})[place] = leaf
    below = {g: Known(leaves, trees.get((GROUP, g), {}), sizes[g]) for g, leaves in members.items()}
    top = Known({g: known.root for g, known in below.items()}, trees[TOP, 0], top_size)
    ends = {g: top.proof(g) for g in below}
    out: dict[str, list] = {c: [] for c in PROVED}
    for group, place, leaf, changed in zip(rows["group"], rows["place"], rows["leaf"], rows["changed"], strict=True):
        known = below[group]
        out["leaf"].append(leaf)
        out["subroot"].append(known.root)
        out["root"].append(root)
        out["proof"].append(digest_of([known.proof(place), ends[group]]))
        out["folded_root"].append(top.root if changed in (None, leaf) else top.fold(group, known.fold(place, changed)))
    return out


def proofs(leaves: DataFrame) -> DataFrame:
    """Key columns, leaf, subroot, root, proof and folded_root of every row of ``leaves``.

    ``leaves`` has group, key (its order in the group), leaf and changed (the leaf to fold instead, or NULL).
    """
    leaves = stored_table(leaves)  # sorting samples its input first
    rows, runs = placed(leaves, ["group"], ["key", "leaf"], leaves.count())
    sizes = runs.groupBy("group").agg(F.sum("n").alias("size"))
    # groups in order: their own ranges, and a rank for each
    groups_rows, groups_runs = placed(sizes, [], ["group"], runs.count())
    ranked = stored_table(with_places(groups_rows, groups_runs, []).select("group", "size", F.col("place").alias("rank")))
    groups, most = (int(x or 0) for x in ranked.agg(F.count("*"), F.max("size")).first())
    same = F.col("runs.group").eqNullSafe(F.col("ranked.group"))
    runs = stored(runs.alias("runs").join(ranked.alias("ranked"), same).select("runs.*", "ranked.size", "ranked.rank", F.lit(groups).alias("groups")))
    on = (F.col("rows.part") == F.col("runs.part")) & F.col("rows.group").eqNullSafe(F.col("runs.group"))
    place = (F.col("at") - F.col("first") + F.col("start")).alias("place")
    found = stored_table(rows.alias("rows").join(runs.alias("runs"), on).select("rows.part", "key", "leaf", "changed", F.col("rank").alias("group"), "size", "groups", place))

    below = tree(found.select("group", F.col("size").alias("n"), "place", F.col("leaf").alias("digest")), GROUP, most)
    names = ranked.select(F.col("rank").alias("group"), "size")
    roots = below.join(names, "group").filter(depth_of("size") == F.col("level")).select(F.lit(0).cast("long").alias("group"), F.lit(groups).cast("long").alias("n"), F.col("group").alias("place"), "digest")
    nodes = below.union(tree(stored_table(roots), TOP, groups))
    fetched = needed(runs).join(nodes, ["tree", "group", "level", "place"])

    schema = f"key {leaves.schema['key'].dataType.simpleString()}, " + ", ".join(f"{c} string" for c in PROVED)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"key": left.column("key"), **{c: pa.array([], pa.string()) for c in PROVED}})
        return pa.table({"key": left.column("key"), **prove(left.to_pydict(), right.to_pydict())})

    return found.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(run, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents (doc_id, source, lang, n_chars, text): a tree for each source, and what becomes of tampered texts.

    Where 2 divides the CRC-32 of the decimal doc_id, tampering takes the line feeds out of the text; a row without doc_id or text
    is not tampered with. ``verified`` says whether the folded root equals the root.
    """
    number = F.col("doc_id").cast("long")

    def leaf(text: Column) -> Column:
        return leaf_of({"doc_id:number": number, "source:text": F.col("source"), "lang:text": F.col("lang"), "n_chars:number": F.col("n_chars").cast("long"), "text:text": text})

    tampered = (F.crc32(number.cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    changed = F.when(tampered, leaf(F.translate("text", "\n", "")))
    leaves = docs.select(F.col("source").alias("group"), number.alias("key"), leaf(F.col("text")).alias("leaf"), changed.alias("changed"))
    return proofs(leaves).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
