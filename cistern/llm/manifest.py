"""A Merkle manifest of a dataset as postorder append logs.

Leaves are hashes of rows. Leaves of a group follow each other by id; every two consecutive nodes become a parent, a last one
by itself too, until one is left. Groups' roots, in the order of the groups, are the leaves of one more such tree.

A builder has an aligned block of 2**HEIGHT leaves and appends nodes in the order in which they are complete: each leaf, and
behind it the nodes that it completes; nodes that the end of the group cuts short come last. So the number of nodes before any
node follows from the sizes of complete subtrees alone (`position`): leaf i stands at 2 * i - ones(i), where ones(i) is the
number of set bits of i. Nothing is searched: a proof reads the siblings of a leaf at their positions. Roots of blocks are the
leaves of the next tier, so tiers are few (each has a 2**HEIGHT-th of the rows) and no task holds more than a block. A
log is a row for each block, written as a table.

A null in a leaf's columns counts as `-`. Null groups are a group of their own, before all others; null ids come first in
their group. Rows of one id are ordered by their hash, equal rows in any order. Very long texts are hashed whole. An empty
table gives an empty manifest. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cistern.sources.scratch import stage

#: Of a block's tree.
HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields: their size in bytes and their value each."""
    cells = []
    for f in fields:
        text = f.cast("string")
        cells.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*cells), 256)


def hashed(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def ones(i: int) -> int:
    return i.bit_count()


def height_of(n: int) -> int:
    """Of the tree of n leaves."""
    return (n - 1).bit_length()


def position(n: int, height: int, index: int) -> int:
    """Where the log of a tree of n leaves has the index-th node of a height.

    A complete node stands behind its last leaf, after the nodes of smaller heights that this leaf completes. Incomplete
    nodes, one of each height above the trailing zeros of n, come behind all complete ones.
    """
    last = (index + 1 << height) - 1
    if last < n:
        return 2 * last - ones(last) + height
    zeros = (n & -n).bit_length() - 1
    return 2 * n - ones(n) + height - zeros - 1


def append_log(leaves: list[str], height: int) -> list[str]:
    """The nodes of a tree of the given height over the leaves, in the order in which they are complete."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(height + 1)]  # nodes of each height without a parent so far
    for leaf in leaves:
        node, h = leaf, 0
        while True:
            log.append(node)
            open_[h].append(node)
            if h == height or len(open_[h]) < 2:
                break
            node, open_[h], h = hashed(open_[h]), [], h + 1
    for h in range(height):
        if open_[h]:
            node, open_[h] = hashed(open_[h]), []
            log.append(node)
            open_[h + 1].append(node)
    return log


def _ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `i`, their place in their group by the order, and `n`, the size of the group.

    Rows are ranged by group and order, so a hot group is in many ranges; a row's place is that in its range and the
    number of the group's rows in earlier ones. rows is a stored table: its ranges are the same if a task runs again.
    """
    ranged = stage(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    held = ranged.groupBy(group, "_part").agg(F.count("*").alias("_held"))
    over = Window.partitionBy(group)
    before = F.sum("_held").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_held").over(over).alias("n"))
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    placed = ranged.withColumn("_at", place).join(held, [group, "_part"])
    return placed.withColumn("i", F.col("_at") + F.col("_before")).drop("_part", "_at", "_held", "_before")


LOG = "g string, block long, leaves long, log binary, root string"


def _builder(most: int):
    """most: the height of a block."""

    def built(key: tuple, table: pa.Table) -> pa.Table:
        """The log of a block: its nodes' hex, 64 bytes each. table: (g, i, n, hash)."""
        order = np.argsort(table["i"].to_numpy(), kind="stable")
        leaves = table["hash"].take(pa.array(order)).to_pylist()
        n = table["n"][0].as_py()
        # A group of one block has a tree of its own height; else the last block is as high as the others.
        log = append_log(leaves, height_of(n) if n <= 1 << most else most)
        return pa.table(
            {
                "g": [key[0].as_py()],
                "block": pa.array([key[1].as_py()], pa.int64()),
                "leaves": pa.array([n], pa.int64()),
                "log": pa.array(["".join(log).encode()], pa.binary()),
                "root": [log[-1]],
            }
        )

    return built


def append_logs(leaves: DataFrame, most: int = HEIGHT) -> list[DataFrame]:
    """Tiers of logs (g, block, leaves, log, root), stored tables. leaves: (g, i, n, hash); n: leaves of the tier in the group."""
    tiers = []
    while True:
        keyed = leaves.select("g", F.shiftright("i", most).alias("block"), "i", "n", "hash")
        tiers.append(stage(keyed.groupBy("g", "block").applyInArrow(_builder(most), LOG), "log"))
        more = tiers[-1].where(F.col("leaves") > 1 << most)
        if not more.take(1):
            return tiers
        leaves = more.select("g", F.col("block").alias("i"), F.ceil(F.col("leaves") / (1 << most)).alias("n"), F.col("root").alias("hash"))


def _block_of(leaves: int, block: int, most: int) -> tuple[int, int]:
    """(leaves, height) of a block of a tier of so many leaves."""
    return min(1 << most, leaves - (block << most)), height_of(leaves) if leaves <= 1 << most else most


def siblings(log: bytes, n: int, height: int, i: int) -> Iterator[tuple[str, str]]:
    """(side, hash) of the sibling of each node from leaf i of a block's log up; side: L, R, or N for none."""
    for h in range(height):
        other = (i >> h) ^ 1
        if other << h >= n:
            yield "N", ""
        else:
            at = 64 * position(n, h, other)
            yield "L" if other < i >> h else "R", log[at : at + 64].decode()


def packed(steps: Iterator[tuple[str, str]]) -> str:
    return "".join(side + node for side, node in steps)


def unpacked(path: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(path):
        size = 0 if path[at] == "N" else 64
        yield path[at], path[at + 1 : at + 1 + size]
        at += 1 + size


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its siblings give."""
    for side, node in unpacked(path):
        leaf = hashed([node, leaf] if side == "L" else [leaf, node] if side == "R" else [leaf])
    return leaf


def _paths_below(most: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """(g, block, subroot, path) of the blocks whose roots are leaves of this one; path: all siblings up to the root."""
        row = {c: table[c][0].as_py() for c in table.column_names}
        n, height = _block_of(row["leaves"], row["block"], most)
        paths = [packed(siblings(row["log"], n, height, i)) + row["path"] for i in range(n)]
        first = row["block"] << most
        return pa.table(
            {
                "g": [row["g"]] * n,
                "block": pa.array(range(first, first + n), pa.int64()),
                "subroot": [row["subroot"]] * n,
                "path": paths,
            },
            schema=pa.schema([("g", pa.string()), ("block", pa.int64()), ("subroot", pa.string()), ("path", pa.string())]),
        )

    return run


PATHS = "g string, block long, subroot string, path string"


def block_paths(tiers: list[DataFrame], above: DataFrame, most: int = HEIGHT) -> DataFrame:
    """(g, block, subroot, path) of the blocks of the lowest tier. above: (g, path), the path of each group's root."""
    tops = []
    for k, tier in enumerate(tiers):
        own = tier.where(F.col("leaves") <= 1 << most).select("g", "block", F.col("root").alias("subroot"))
        tops.append(own.join(above, "g"))
    paths = tops[-1]
    for tier, top in zip(tiers[:0:-1], tops[-2::-1], strict=True):
        rows = tier.join(paths, ["g", "block"])
        paths = rows.groupBy("g", "block").applyInArrow(_paths_below(most), PATHS).unionByName(top)
    return paths


PROOFS = "g string, id long, leaf string, tampered string, subroot string, proof string, folded_root string"


def _proven(most: int):
    def run(key: tuple, leaves: pa.Table, logs: pa.Table) -> pa.Table:
        """Of each leaf (g, block, i, id, hash, tampered): its siblings, read from the log, and the root that they give."""
        if not len(leaves):
            return pa.table({name: [] for name in ("g", "id", "leaf", "tampered", "subroot", "proof", "folded_root")}).cast(_PROOFS)
        log, upper, subroot = logs["log"][0].as_py(), logs["path"][0].as_py(), logs["subroot"][0].as_py()
        n, height = _block_of(logs["leaves"][0].as_py(), logs["block"][0].as_py(), most)
        proofs, folded = [], []
        for i, leaf, bad in zip(leaves["i"].to_pylist(), leaves["hash"].to_pylist(), leaves["tampered"].to_pylist(), strict=True):
            path = packed(siblings(log, n, height, i & (1 << most) - 1)) + upper
            proofs.append(hashed([node for _, node in unpacked(path)]))
            folded.append(fold(bad or leaf, path))
        return pa.table(
            [leaves["g"], leaves["id"], leaves["hash"], leaves["tampered"], pa.array([subroot] * len(leaves)), pa.array(proofs), pa.array(folded)],
            schema=_PROOFS,
        )

    return run


_PROOFS = pa.schema([("g", pa.string()), ("id", pa.int64()), *((c, pa.string()) for c in ("leaf", "tampered", "subroot", "proof", "folded_root"))])


class Manifest:
    """Leaves, logs of all groups, and the log of the groups' roots."""

    def __init__(self, leaves: DataFrame, most: int = HEIGHT):
        """leaves: (g, id, hash, tampered); g orders the groups bytewise; tampered: the hash to fold instead, or null; most: the height of a block."""
        self.most = most
        # Equal rows are told apart, so that a group of them can be ranged; stored, the numbers stay.
        rows = stage(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
        self.leaves = stage(_ranked(rows, "g", "id", "hash", "tie").drop("tie"), "ranked")
        self.tiers = append_logs(self.leaves, most)
        roots = None
        for tier in self.tiers:
            own = tier.where(F.col("leaves") <= 1 << most).select("g", "root")
            roots = own if roots is None else roots.union(own)
        top = stage(roots.select(F.lit("").alias("all"), F.col("g").alias("name"), F.col("root").alias("hash")), "roots")
        self.groups = stage(_ranked(top, "all", "name").withColumnRenamed("all", "g"), "ranked")
        self.top = append_logs(self.groups, most)
        last = self.top[-1].where(F.col("leaves") <= 1 << most).first()
        self.root = last["root"] if last else None

    def proofs(self) -> DataFrame:
        """(g, id, leaf, tampered, subroot, proof, folded_root) of every leaf."""
        root = self.top[0].select("g").distinct().select("g", F.lit("").alias("path"))
        upper = block_paths(self.top, root, self.most)
        kept = self.groups.select("g", F.shiftright("i", self.most).alias("block"), "i", "name")
        rows = self.top[0].join(upper, ["g", "block"])
        above = kept.groupBy("g", "block").cogroup(rows.groupBy("g", "block")).applyInArrow(_group_paths(self.most), "g string, path string")
        logs = self.tiers[0].join(block_paths(self.tiers, above, self.most), ["g", "block"])
        leaves = self.leaves.withColumn("block", F.shiftright("i", self.most))
        return leaves.groupBy("g", "block").cogroup(logs.groupBy("g", "block")).applyInArrow(_proven(self.most), PROOFS)


def _group_paths(most: int):
    def run(key: tuple, groups: pa.Table, logs: pa.Table) -> pa.Table:
        """(g, path) of the groups whose roots are the leaves of a block of the upper tree."""
        log, upper = logs["log"][0].as_py(), logs["path"][0].as_py()
        n, height = _block_of(logs["leaves"][0].as_py(), logs["block"][0].as_py(), most)
        paths = [packed(siblings(log, n, height, i & (1 << most) - 1)) + upper for i in groups["i"].to_pylist()]
        return pa.table([groups["name"], pa.array(paths, pa.string())], ["g", "path"])

    return run


def document_manifest(docs: DataFrame, most: int = HEIGHT) -> Manifest:
    """Of documents by language. A row is to be tampered with where TAMPERED divides the CRC of its id."""
    other = leaf_hash(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS))
    turned = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    g = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return Manifest(
        docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("id"), leaf_hash(*map(F.col, FIELDS)).alias("hash"), F.when(turned, other).alias("tampered")),
        most,
    )


def manifest_rows(docs: DataFrame, most: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    manifest = document_manifest(docs, most)
    root = F.lit(manifest.root).cast("string")
    return manifest.proofs().select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        root.alias("root"),
        F.col("proof").alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def check_sql(levels: int = 36) -> str:
    """The same rows in SQL. levels: more than any tree has; groups that have come to one node stay as they are."""
    cell = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(cell.format(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"

    # CRC-32 of the id's digits: a byte is taken in, then eight bits are shifted out (-1 each).
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = (
        f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), "
        "lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END), 4294967295)"
    )
    parts = [
        f"""leaves AS MATERIALIZED (
            SELECT doc_id, g, h, CASE WHEN doc_id IS NOT NULL AND crc % {TAMPERED} = 0 THEN bad ELSE h END AS f,
                row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i
            FROM (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("n_chars")} AS h, {leaf("(n_chars + 1)")} AS bad, {crc} AS crc FROM documents))""",
        "a0 AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
    ]

    def raised(tree: str) -> None:
        for k in range(levels):
            parts.append(
                f"""{tree}{k + 1} AS MATERIALIZED (
                SELECT g, i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (any_value(n) + 1) // 2 AS n FROM {tree}{k} WHERE n > 1 GROUP BY g, i // 2
                UNION ALL SELECT g, i, h, n FROM {tree}{k} WHERE n = 1)"""
            )

    raised("a")
    parts.append(f"b0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS name FROM a{levels})")
    raised("b")
    # Each leaf's node climbs: with its sibling where there is one, by itself at an odd end, not at all at the root.
    parts.append("c0 AS MATERIALIZED (SELECT doc_id, g, i, h, f, '' AS p FROM leaves)")

    def climbed(tree: str, k: int, at: int) -> None:
        parts.append(
            f"""c{at + 1} AS MATERIALIZED (
            SELECT c.doc_id, c.g, CASE WHEN t.n > 1 THEN c.i // 2 ELSE c.i END AS i, c.h, c.p || coalesce(s.h, '') AS p,
                CASE WHEN t.n = 1 THEN c.f WHEN c.i % 2 = 1 THEN sha256(s.h || c.f) ELSE sha256(c.f || coalesce(s.h, '')) END AS f
            FROM c{at} c JOIN {tree}{k} t ON t.i = c.i {"AND t.g = c.g" if tree == "a" else ""}
            LEFT JOIN {tree}{k} s ON s.i = xor(c.i, 1) AND t.n > 1 {"AND s.g = c.g" if tree == "a" else ""})"""
        )

    for k in range(levels):
        climbed("a", k, k)
    parts.append(f"c{levels + 1} AS MATERIALIZED (SELECT c.doc_id, c.g, b.i, c.h, c.p, c.f FROM c{levels} c JOIN b0 b ON b.name = c.g)")
    for k in range(levels):
        climbed("b", k, levels + 1 + k)
    return f"""WITH {", ".join(parts)}
        SELECT c.doc_id, c.h AS leaf, a.h AS subroot, b.h AS root, sha256(c.p) AS proof_sha256, c.f AS folded_root, c.f = b.h AS verified
        FROM c{2 * levels + 1} c JOIN a{levels} a ON a.g = c.g CROSS JOIN b{levels} b"""
