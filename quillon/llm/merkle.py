"""Merkle manifest of a table: subroots by language, a root, a proof a row, and its fold.

A leaf is the SHA-256 of a row's fields; each level makes every two consecutive
nodes one (an odd last node becomes the hash of itself) until one is left.

1. Leaves are hashed in the JVM.  They are numbered in their language over ranges
   of (language, doc_id, leaf), so no task orders a language.
2. Blocks of 1024 consecutive leaves (``LEVELS``) are reduced where they lie, one row a
   block, whatever share of all rows a language has.
3. Block roots make the upper tree.  While it has more than ``TOP`` nodes, it is
   reduced in blocks as well; what is left is built by the driver, and the paths
   above each node (at most ``TOP`` rows) are broadcast.
4. Each block puts the siblings inside it before the path above it, hashes the
   proofs and folds every leaf (the changed one, where it was tampered with) to a
   root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut

#: Levels that a block reduces; it has 2 ** LEVELS leaves.
LEVELS = 10
#: Nodes of the upper tree that the driver may hold.
TOP = 4096
#: Rows are tampered with where this divides the crc32 of the id.
TAMPER = 7

_LONE, _RIGHT, _LEFT = 0, 1, 2
_STEP = 65  # a step of a path: where the sibling is, and its digest as hex text


def digest(*parts: bytes) -> bytes:
    """SHA-256 of the concatenated parts, as lower-case hex text."""
    return sha256(b"".join(parts)).hexdigest().encode()


def depth(n: int) -> int:
    """Levels above ``n`` nodes."""
    return (n - 1).bit_length()


def tower(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes and the ``levels`` levels above them."""
    out = [nodes]
    for _ in range(levels):
        x = out[-1]
        out.append([digest(*x[k : k + 2]) for k in range(0, len(x), 2)])
    return out


def steps(levels: list[list[bytes]], i: int) -> bytes:
    """The path of node ``i`` through all levels but the last."""
    out = []
    for level in levels[:-1]:
        other = i ^ 1
        if other < len(level):
            out.append(bytes([_RIGHT if other > i else _LEFT]) + level[other])
        else:
            out.append(bytes(_STEP))
        i >>= 1
    return b"".join(out)


def siblings(path: bytes) -> list[tuple[int, bytes]]:
    return [(path[k], path[k + 1 : k + _STEP]) for k in range(0, len(path), _STEP)]


def proof(path: bytes) -> bytes:
    """Hash of a path's siblings, from the leaf up."""
    return digest(*(x for side, x in siblings(path) if side != _LONE))


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a node and its path make."""
    for side, x in siblings(path):
        node = digest(node) if side == _LONE else digest(node, x) if side == _RIGHT else digest(x, node)
    return node


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def _leaf(n_chars: Column) -> Column:
    fields = [_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """``(g, doc_id, leaf, changed)``: language with null first, digests, the tampered one if it differs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    lang = F.col("lang").cast("string")
    tampered = (crc_mod(F.col("doc_id"), TAMPER) == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        F.when(lang.isNull(), "0").otherwise(F.concat(F.lit("1"), lang)).alias("g"),
        "doc_id",
        _leaf(F.col("n_chars")).alias("leaf"),
        F.when(tampered, _leaf(F.col("n_chars") + 1)).alias("changed"),
    )


def _numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``i``, the place in the language, and ``n``, the language's leaves."""
    order = ["g", "doc_id", "leaf"]
    ranges = cut(leaves.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("g", "range").agg(F.count("*").alias("c"))  # a row a range and language in it
    whole = Window.partitionBy("g")
    before = F.sum("c").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("g", "range", F.coalesce(before, F.lit(0)).alias("start"), F.sum("c").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy("g", "range").orderBy("doc_id", "leaf")) - 1 + F.col("start")
    return ranges.join(starts, ["g", "range"]).select("g", place.cast("long").alias("i"), "n", F.col("leaf").alias("node"), "doc_id", "changed")


_BLOCKS = "g string, block long, n long, height long, nodes binary, ids array<long>, changed array<string>, root string"


def _pack(levels: int):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        """One row for a block of nodes: (g, i, n, node, doc_id, changed)."""
        rows = rows.sort_by("i")
        nodes = rows.column("node").to_pylist()
        n = rows.column("n")[0].as_py()
        height = min(levels, depth(n))
        return pa.table(
            {
                "g": pa.array([key[0].as_py()], pa.string()),
                "block": pa.array([key[1].as_py()], pa.int64()),
                "n": pa.array([n], pa.int64()),
                "height": pa.array([height], pa.int64()),
                "nodes": pa.array([bytes.fromhex("".join(nodes))], pa.binary()),
                "ids": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "changed": pa.array([rows.column("changed").to_pylist()], pa.list_(pa.string())),
                "root": pa.array([tower([x.encode() for x in nodes], height)[-1][0].decode()], pa.string()),
            }
        )

    return pack


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    dealt = nodes.select("g", F.shiftright("i", levels).alias("block"), "i", "n", "node", "doc_id", "changed")
    return cut(dealt.groupBy("g", "block").applyInArrow(_pack(levels), _BLOCKS), "blocks")


def _inner(row: dict) -> list[list[bytes]]:
    """The tower of a block."""
    raw = row["nodes"]
    return tower([raw[k : k + 32].hex().encode() for k in range(0, len(raw), 32)], row["height"])


def _driven(rows: list) -> list[tuple]:
    """``(g, i, path, subroot, root)`` of all nodes of a small upper tree."""
    langs: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["g"].encode(), r["i"])):
        langs.setdefault(r["g"], []).append(r["node"].encode())
    towers = {g: tower(nodes, depth(len(nodes))) for g, nodes in langs.items()}
    upper = tower([t[-1][0] for t in towers.values()], depth(len(towers)))
    out = []
    for k, (g, t) in enumerate(towers.items()):
        above = steps(upper, k)
        out += [(g, i, steps(t, i) + above, t[-1][0].decode(), upper[-1][0].decode()) for i in range(len(t[0]))]
    return out


_PATHS = "g string, i long, path binary, subroot string, root string"


def _spread(size: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Paths of the members of blocks (of ``size``) whose own paths are known."""
        for batch in batches:
            for row in batch.to_pylist():
                inner = _inner(row)
                n = len(inner[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["g"]] * n, pa.string()),
                        pa.array([row["block"] * size + k for k in range(n)], pa.int64()),
                        pa.array([steps(inner, k) + row["path"] for k in range(n)], pa.binary()),
                        pa.array([row["subroot"]] * n, pa.string()),
                        pa.array([row["root"]] * n, pa.string()),
                    ],
                    names=["g", "i", "path", "subroot", "root"],
                )

    return spread


def paths(spark: SparkSession, nodes: DataFrame, top: int = TOP, levels: int = LEVELS) -> DataFrame:
    """``(g, i, path, subroot, root)`` for every node ``(g, i, n, node)``; ``n`` nodes a group."""
    count, widest = nodes.agg(F.count("*"), F.max("n")).first()
    if count <= top:
        rows = _driven(nodes.select("g", "i", "node").collect())
        return F.broadcast(spark.createDataFrame(rows, _PATHS))
    if widest == 1:  # very many languages: their subroots are the nodes of one more tree
        subroots = _numbered(nodes.select(F.lit("").alias("g"), F.col("g").alias("doc_id"), F.col("node").alias("leaf"), F.lit(None).cast("string").alias("changed")))
        subroots = cut(subroots.select("g", "i", "n", "node", F.col("doc_id").alias("lang")), "subroots")
        above = paths(spark, subroots.select("g", "i", "n", "node"), top, levels).select("i", "path", "root")
        return subroots.join(above, "i").select(F.col("lang").alias("g"), F.lit(0).cast("long").alias("i"), "path", F.col("node").alias("subroot"), "root")
    empty = {"doc_id": F.lit(None).cast("long"), "changed": F.lit(None).cast("string")}
    blocks = _blocks(nodes.withColumns(empty), levels)
    return _joined(spark, blocks, top, levels).mapInArrow(_spread(1 << levels), _PATHS)


def _joined(spark: SparkSession, blocks: DataFrame, top: int, levels: int) -> DataFrame:
    """Blocks with the paths of their roots."""
    up = F.shiftright(F.col("n") + ((1 << levels) - 1), levels)
    roots = blocks.select("g", F.col("block").alias("i"), up.alias("n"), F.col("root").alias("node"))
    above = paths(spark, roots, top, levels).withColumnRenamed("i", "block")
    return blocks.drop("root").join(above, ["g", "block"])


_ROWS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs and folds of the leaves of blocks."""
    for batch in batches:
        for row in batch.to_pylist():
            levels, changed = _inner(row), row["changed"]
            proofs, folded = [], []
            for k, leaf in enumerate(levels[0]):
                path = steps(levels, k) + row["path"]
                proofs.append(proof(path).decode())
                folded.append(fold(leaf if changed[k] is None else changed[k].encode(), path).decode())
            n, root = len(proofs), row["root"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()),
                    pa.array([x.decode() for x in levels[0]]),
                    pa.array([row["subroot"]] * n),
                    pa.array([root] * n),
                    pa.array(proofs),
                    pa.array(folded),
                    pa.array([x == root for x in folded]),
                ],
                names=[x.split()[0] for x in _ROWS.split(", ")],
            )


def manifest(docs: DataFrame, top: int = TOP, levels: int = LEVELS) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row of ``docs``.

    Reads doc_id, source, lang, n_chars and text; other columns may be there.
    Null fields are hashed as ``-``.  Rows without lang make a language of their
    own, the first one; in a language rows without doc_id come first, and rows of
    one doc_id are ordered by their leaves (equal rows have equal leaves, in any
    order).  A row alone in its table is leaf, subroot and root at once, and its
    proof is the hash of nothing.  An empty table gives an empty result.
    """
    leaves = cut(leaves_of(docs), "leaves")
    blocks = _blocks(_numbered(leaves), levels)
    return _joined(docs.sparkSession, blocks, top, levels).mapInArrow(_finish, _ROWS)
