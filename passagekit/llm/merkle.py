"""Merkle manifest of a dataset with a witness for every row.

Leaves of a group (a source) stand in a fixed order. Every three consecutive nodes become
one by SHA-256; the last run of a level may be shorter. What remains is the group's root,
and the groups' roots make the root of the dataset by the same rule.

Witnesses are kept while leaves are appended. A node that is appended joins the open run
of its level. When the run is complete, each of its members, which is the root of a
subtree with partial witnesses below it, gets the siblings it has in this run; that
extends the witnesses of all leaves of the subtree at once, because they share the part
above their subtree. The completed run is appended as a node of the next level.

A group is cut into aligned blocks whose number of leaves is a power of three, so that a
block's root is a node of the tree. A task appends the leaves of one block at a time. The roots of
the blocks are appended in further blocks until one node is left; then the witnesses of
block roots are handed down and extend those of the blocks' leaves. Only rows of fixed
size are shuffled (digests, one witness per block), and no group is in one task.

Defined results: null fields have a coding of their own; rows that share an id are ordered
by their digests; a null source is a group and comes first; a null id comes first and its
row is not tampered with; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from passagekit.llm.common import CRC_STEPS_SQL, crc32_sql, table
from passagekit.plans.registry import query
from passagekit.scale import broadcast_if_small, row_index, stage

# Fixed values of the result contract.
FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Levels of a block; it has FANOUT to this power of leaves.
BLOCK_LEVELS = 6


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above ``leaves`` leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FANOUT), levels + 1
    return levels


class Node:
    """A subtree's root. ``up`` is the rest of the witness of all leaves below it."""

    __slots__ = ("digest", "up", "place", "run")

    def __init__(self, digest_: str):
        self.digest, self.up, self.place, self.run = digest_, None, 0, None


class Appender:
    """Appends nodes; each completed run extends the witnesses of its members."""

    def __init__(self, levels: int):
        self.open: list[list[Node]] = [[] for _ in range(levels + 1)]
        self.levels = levels

    def append(self, node: Node, level: int = 0) -> None:
        run = self.open[level]
        run.append(node)
        if len(run) == FANOUT and level < self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent, digests = Node(digest([n.digest for n in run])), [n.digest for n in run]
        for place, node in enumerate(run):
            node.up, node.place, node.run = parent, place, digests
        self.append(parent, level + 1)

    def close(self) -> Node:
        """Complete the open runs, shorter ones too; returns the root."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        (root,) = self.open[self.levels]
        return root


def witness(node: Node) -> list[tuple[list[str], list[str]]]:
    """The siblings left and right of the path from ``node`` to the root, level by level."""
    steps = []
    while node.up is not None:
        steps.append((node.run[:node.place], node.run[node.place + 1:]))
        node = node.up
    return steps


def folded(leaf: str, steps: Sequence[tuple[list[str], list[str]]]) -> str:
    """The root that follows from a leaf and its witness."""
    for left, right in steps:
        leaf = digest([*left, leaf, *right])
    return leaf


def packed(steps: Sequence[tuple[list[str], list[str]]]) -> bytes:
    """A witness as bytes: per step the two numbers of siblings, then their digests."""
    return b"".join(bytes([len(a), len(b)]) + bytes.fromhex("".join([*a, *b])) for a, b in steps)


def unpacked(data: bytes) -> list[tuple[list[str], list[str]]]:
    steps, at = [], 0
    while at < len(data):
        left, right = data[at], data[at + 1]
        hexes = data[at + 2:at + 2 + 32 * (left + right)].hex()
        all_ = [hexes[i:i + 64] for i in range(0, len(hexes), 64)]
        steps.append((all_[:left], all_[left:]))
        at += 2 + 32 * (left + right)
    return steps


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of all fields: a dash for null, else the bytes' number, a colon and the bytes."""
    coded = [
        F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-"))
        for f in fields
    ]
    return F.sha2(F.concat(*coded), 256)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Rows of one block (grp, block) next to each other, in the order of ``pos``."""
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block after another; a block has a bounded number of rows."""
    key, held = None, []
    for batch in batches:
        keys = list(zip(batch.column("grp").to_pylist(), batch.column("block").to_pylist()))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            if held and keys[start] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _levels(n: int, block_levels: int) -> int:
    """Levels that one block of a group of ``n`` nodes is raised."""
    return min(height(n), block_levels)


def _placed(nodes: DataFrame, order: Sequence[str], block_levels: int) -> DataFrame:
    """A stored table: ``nodes`` (grp, ...) with pos in the group, its size n, and block."""
    indexed = row_index(nodes, ["grp", *order], "at")
    groups = broadcast_if_small(indexed.groupBy("grp").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    pos = F.col("at") - F.col("first")
    block = F.expr(f"pos div {FANOUT**block_levels}L")
    return stage(indexed.join(groups, "grp").withColumn("pos", pos).withColumn("block", block).drop("at", "first"), "tree-nodes")


def _raised(nodes: DataFrame, block_levels: int) -> DataFrame:
    """The roots of all blocks: a stored table of nodes for the next round."""
    span = FANOUT**block_levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_block(batches):
            n, block = rows["n"][0].as_py(), rows["block"][0].as_py()
            made = Appender(_levels(n, block_levels))
            for node in rows["node"].to_pylist():
                made.append(Node(node))
            yield pa.RecordBatch.from_pylist([{
                "grp": rows["grp"][0].as_py(), "node": made.close().digest, "pos": block, "n": -(-n // span), "block": block // span,
            }], _NODES)

    narrow = nodes.select("grp", "block", "pos", "n", "node")
    return stage(_blocks(narrow).mapInArrow(run, "grp string, node string, pos long, n long, block long"), "tree-nodes")


_NODES = pa.schema([("grp", pa.string()), ("node", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("block", pa.int64())])


def rounds(nodes: DataFrame, block_levels: int) -> list[DataFrame]:
    """Tables of nodes, from the leaves to those with one node per group."""
    tables = [nodes]
    while tables[-1].where(F.col("n") > 1).limit(1).count():
        # A group that has its root stays as it is: a block of one node is raised by no level.
        tables.append(_raised(tables[-1], block_levels))
    return tables


def _witnesses(rows: pa.Table, block_levels: int) -> tuple[list[Node], bytes]:
    """The appended nodes of a block, and the witness of the block's root (its first row)."""
    rest, body = rows["path"][0].as_py(), rows.slice(1)
    made = Appender(_levels(body["n"][0].as_py(), block_levels))
    leaves = [Node(node) for node in body["node"].to_pylist()]
    for leaf in leaves:
        made.append(leaf)
    made.close()
    return leaves, rest


def handed_down(nodes: DataFrame, above: DataFrame, block_levels: int) -> DataFrame:
    """(grp, pos, path): the witnesses of ``nodes``, from those of their blocks' roots.

    ``above`` (grp, pos, path) has one row per block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_block(batches):
            leaves, rest = _witnesses(rows, block_levels)
            paths = pa.array([packed(witness(leaf)) + rest for leaf in leaves], pa.binary())
            body = rows.slice(1)
            yield from pa.table([body["grp"], body["pos"], paths], schema=_PATHS).combine_chunks().to_batches()

    both = _with_paths(nodes.select("grp", "block", "pos", "n", "node"), above)
    return stage(_blocks(both).mapInArrow(run, "grp string, pos long, path binary"), "tree-paths")


_PATHS = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("path", pa.binary())])


def _with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` and, as the first row of each block, the path of the block's root."""
    heads = above.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path")
    return nodes.unionByName(heads, allowMissingColumns=True)


def manifest(
    leaves: DataFrame, group_col: str = "source", order: Sequence[str] = ("doc_id",), leaf_col: str = "leaf",
    check_col: str | None = None, block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """``leaves`` with subroot, root, proof_sha256 and folded_root.

    ``leaf_col`` holds the digests of the rows. ``folded_root`` is the root that follows
    from ``check_col``, where that is not null, or else from the leaf, and the witness.
    """
    out = ("subroot", "root", "proof_sha256", "folded_root")
    kept = [c for c in leaves.columns if c.lower() not in out]
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    check = F.col(check_col) if check_col else F.lit(None).cast("string")
    order_by = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    start = leaves.select(
        group.alias("grp"), *order_by, F.col(leaf_col).alias("node"), check.alias("check"), F.struct(*kept).alias("row")
    )
    nodes = _placed(stage(start, "tree-leaves"), [*(f"o{i}" for i in range(len(order))), "node"], block_levels)
    nodes = nodes.drop(*(f"o{i}" for i in range(len(order))))
    tables = rounds(nodes, block_levels)
    # The groups' roots, as the leaves of the tree above: one row per group.
    roots = tables[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "node")
    upper = _placed(roots, ["of"], block_levels)
    above = rounds(upper, block_levels)
    top = above[-1].select("grp", "pos", F.lit(b"").alias("path"))
    for level in reversed(above[:-1]):
        top = handed_down(level, top, block_levels)
    subroots = upper.select("pos", "of", F.col("node").alias("subroot")).join(top.select("pos", "path"), "pos")
    root = above[-1].select(F.col("node").alias("root"))
    paths = subroots.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "path")
    for level in reversed(tables[1:-1]):
        paths = handed_down(level, paths, block_levels)
    result = T.StructType([
        nodes.schema["grp"], nodes.schema["row"], T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType()),
    ])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_block(batches):
            leaves, rest = _witnesses(rows, block_levels)
            shared, body = unpacked(rest), rows.slice(1)
            proofs, folds = [], []
            for leaf, changed in zip(leaves, body["check"].to_pylist()):
                steps = [*witness(leaf), *shared]
                proofs.append(digest([x for left, right in steps for x in (*left, *right)]))
                folds.append(folded(leaf.digest if changed is None else changed, steps))
            columns = [body["grp"], body["row"], pa.array(proofs, pa.string()), pa.array(folds, pa.string())]
            yield from pa.table(columns, names=result.names).combine_chunks().to_batches()

    found = _blocks(_with_paths(nodes, paths)).mapInArrow(finish, result)
    small = broadcast_if_small(subroots.select(F.col("of").alias("grp"), "subroot"))
    # The root of everything is one row.
    whole = root.first()
    placed = found.join(small, "grp").withColumn("root", F.lit(whole.root if whole else None).cast("string"))
    return placed.select("row.*", *out)


def _tree_sql(name: str, start: str) -> str:
    """The nodes of all levels, and their siblings in a run, from (g, p, n, node)."""
    return f"""{name}(lvl, g, p, n, node) AS (
  SELECT 0, g, p, n, node FROM ({start})
  UNION ALL
  SELECT lvl + 1, g, p // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(node, '' ORDER BY p)) FROM {name}
  WHERE n > 1 GROUP BY lvl, g, p // {FANOUT}, n),
{name}_sib AS (
  SELECT a.lvl, a.g, a.p, coalesce(string_agg(b.node, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r
  FROM {name} a JOIN {name} b ON a.lvl = b.lvl AND a.g = b.g AND a.p // {FANOUT} = b.p // {FANOUT}
  WHERE a.n > 1 GROUP BY a.lvl, a.g, a.p),
"""


def _path_sql(name: str, tree: str, start: str) -> str:
    """Every row's fold and proof up to the root of ``tree``, from (id, g, p, acc, proof)."""
    return f"""{name}(id, lvl, g, p, acc, proof) AS (
  SELECT id, 0, g, p, acc, proof FROM ({start})
  UNION ALL
  SELECT x.id, x.lvl + 1, x.g, x.p // {FANOUT}, sha256(s.l || x.acc || s.r), x.proof || s.l || s.r
  FROM {name} x JOIN {tree}_sib s ON s.lvl = x.lvl AND s.g = x.g AND s.p = x.p),
{name}_end AS (SELECT id, g, arg_max(acc, lvl) AS acc, arg_max(proof, lvl) AS proof FROM {name} GROUP BY id, g),
"""


def _leaf_sql(text: str) -> str:
    values = [text if name == "text" else name for name in FIELDS]
    coded = [f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')" for v in values]
    return f"sha256({' || '.join(coded)})"


SQL = f"""
WITH RECURSIVE {CRC_STEPS_SQL},
marked AS (
  SELECT {', '.join(FIELDS)}, row_number() OVER () AS id, coalesce('=' || source, '') AS g,
         coalesce({crc32_sql("digits")} % 2 = 0 AND text IS NOT NULL AND doc_id IS NOT NULL, FALSE) AS hit
  FROM (SELECT *, hex(coalesce(doc_id::VARCHAR, '')) AS digits FROM documents), crc_steps),
hashed AS (
  SELECT id, doc_id, g, {_leaf_sql("text")} AS leaf, CASE WHEN hit THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed FROM marked),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM hashed),
{_tree_sql("tree", "SELECT g, p, n, leaf AS node FROM leaves")}
subroots AS (
  SELECT g AS of, '' AS g, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n, node FROM tree WHERE n = 1),
{_tree_sql("top", "SELECT g, p, n, node FROM subroots")}
{_path_sql("inner", "tree", "SELECT id, g, p, coalesce(changed, leaf) AS acc, '' AS proof FROM leaves")}
{_path_sql("outer", "top", "SELECT e.id, s.g, s.p, e.acc, e.proof FROM inner_end e JOIN subroots s ON s.of = e.g")}
root AS (SELECT node FROM top WHERE n = 1)
SELECT doc_id, leaf, s.node AS subroot, root.node AS root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = root.node AS verified
FROM leaves JOIN subroots s ON s.of = leaves.g JOIN outer_end e ON e.id = leaves.id, root
""".replace("inner", "inner_path").replace("outer", "outer_path")


@query("op12_merkle", SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, witness and the check of a tampered copy for every document."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(name) for name in FIELDS]
    tampered = [F.replace(F.col("text"), F.lit("\n"), F.lit("")) if name == "text" else F.col(name) for name in FIELDS]
    hit = F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    leaves = docs.select(
        "doc_id", "source", leaf_digest(fields).alias("leaf"), F.when(hit, leaf_digest(tampered)).alias("tampered")
    )
    made = manifest(leaves, check_col="tampered")
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return made.select(*columns, (F.col("folded_root") == F.col("root")).alias("verified"))
