"""Operator 11: a Merkle manifest of a table, with an inclusion proof for every row.

A row's leaf is the hash of its columns.  The leaves of a source, in order of
doc_id, are the base of a tree of fan-out ``FAN``; the sources' roots, in order of
source, are the base of one more.  Hashes are lowercase hex and are hashed as such.

Leaves are ranked by one range sort and a running count of its partitions.  Blocks
of ``Shape.block`` consecutive leaves of a source are then reduced, ``deep`` levels at
once, a block in a task.  What remains, about a node for each block, is reduced
again in the same way until it has at most ``most`` nodes (a table of so many
sources that their roots alone are more is ranked once more, as one tree).  The
driver builds the tree above these nodes and broadcasts each one's path to the
root, at most ``most`` paths of a few kilobytes.  Tasks put the paths inside their
block before it: a row's proof is its siblings in its block, then its block's path.

Rows of a null source are a source of their own, before all others; within a
source, a null doc_id goes first and rows that repeat a doc_id go by leaf.  Any
other null column is part of the leaf.  A single row's root is its leaf and its
proof is empty.  Repeated rows return one row each.  An empty table gives no rows.
Columns other than ``COLUMNS`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_of, small_side, staged

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16


class Shape(NamedTuple):
    """``deep`` levels are reduced at once; the driver builds the upper tree from at most ``most`` nodes."""

    deep: int = 3
    most: int = 4096

    @property
    def block(self) -> int:
        return FAN**self.deep



Path = list[tuple[bytes, bytes]]


def leaf_hash(columns: Iterable[Column]) -> Column:
    """Hash of a row: each value as its length in bytes, a colon and the value; null as a dash."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def climb(nodes: list[bytes], levels: int | None = None) -> list[list[bytes]]:
    """All levels from ``nodes`` up: ``levels`` more, or as many as leave one node."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        below = out[-1]
        out.append([sha(b"".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    return out


def siblings(levels: list[list[bytes]], place: int) -> Path:
    """(hashes before, hashes after) within the run of the node above each level but the last."""
    path = []
    for level in levels[:-1]:
        first = place - place % FAN
        path.append((b"".join(level[first:place]), b"".join(level[place + 1 : first + FAN])))
        place //= FAN
    return path


def folded(digest: bytes, path: Path) -> bytes:
    """The root that a node's hash and path lead to."""
    for before, after in path:
        digest = sha(before + digest + after)
    return digest


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with place (from 0, by ``order`` within grp) and size (rows of grp).

    One range sort; of its partitions only a count for each grp in them is put in order.
    """
    keys = ["grp", *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts_of(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    ranked = staged(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()), "merkle-ranked")
    part = F.shiftright("at", 33)  # the partition's number stands above 33 bits
    runs = ranked.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = staged(runs.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")), "merkle-runs")
    both = ranked.withColumn("part", part).join(small_side(counted), ["grp", "part"])
    return both.withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def blocks(nodes: DataFrame, shape: Shape):
    return nodes.withColumn("block", F.floor(F.col("place") / shape.block)).groupBy("grp", "block")


def levels_of(table: pa.Table, shape: Shape) -> list[list[bytes]]:
    """All levels of a block whose rows are in order: to its root if it is the whole tree, else ``deep`` of them."""
    return climb([d.hex().encode() for d in table["digest"].to_pylist()], None if table["size"][0].as_py() <= shape.block else shape.deep)


def reduced(nodes: DataFrame, shape: Shape) -> DataFrame:
    """(grp, place, size, digest) of the node above each block of ``nodes``."""

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        top = bytes.fromhex(levels_of(table, shape)[-1][0].decode())
        size = -(-table["size"][0].as_py() // shape.block)
        return pa.table({"grp": [key[0].as_py()], "place": [key[1].as_py()], "size": [size], "digest": [top]}, pa.schema([("grp", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())]))

    return blocks(nodes.select("grp", "place", "size", "digest"), shape).applyInArrow(reduce, "grp string, place long, size long, digest binary")


def upper(nodes: DataFrame, sources: bool) -> dict[tuple[str, int], tuple[Path, bytes]]:
    """(path to the root, hash of its own tree's root) of each node, which are groups' (``sources``) or of one tree."""
    rows: dict[str, list] = {}
    for r in nodes.select("grp", "place", "digest").collect():
        rows.setdefault(r.grp, []).append((r.place, bytes(r.digest).hex().encode()))
    groups = sorted(rows, key=str.encode)
    trees = [climb([d for _, d in sorted(rows[g])]) for g in groups]
    above = climb([t[-1][0] for t in trees])
    out = {}
    for k, (g, tree) in enumerate(zip(groups, trees, strict=True)):
        over = siblings(above, k) if sources else []
        out |= {(g, place): (siblings(tree, place) + over, tree[-1][0]) for place in range(len(tree[0]))}
    return out


_PATH = "array<struct<before:binary,after:binary>>"
_STEP = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
_NODE = pa.schema([("grp", pa.string()), ("place", pa.int64()), ("path", _STEP), ("subroot", pa.binary())])


def _plain(path: Path) -> list[dict]:
    return [{"before": b, "after": a} for b, a in path]


def below(nodes: DataFrame, over: DataFrame | dict, each, kind: str, shape: Shape) -> DataFrame:
    """``each(table of a block, its levels, path of the node above, subroot)`` for every block of ``nodes``.

    ``over`` has the paths of the nodes above: those that the driver made go to all tasks, a table's to their block's task.
    """
    if isinstance(over, dict):
        shared = nodes.sparkSession.sparkContext.broadcast(over)

        def finish(key: tuple, table: pa.Table) -> pa.Table:
            path, subroot = shared.value[key[0].as_py(), key[1].as_py()]
            table = table.sort_by("place")
            return each(table, levels_of(table, shape), path, subroot)

        return blocks(nodes, shape).applyInArrow(finish, kind)

    def finish_both(key: tuple, table: pa.Table, top: pa.Table) -> pa.Table:
        table, row = table.sort_by("place"), top.to_pylist()[0]
        return each(table, levels_of(table, shape), [(s["before"], s["after"]) for s in row["path"]], row["subroot"])

    return blocks(nodes, shape).cogroup(over.groupBy("grp", "place")).applyInArrow(finish_both, kind)


def paths(nodes: DataFrame, shape: Shape, sources: bool = True) -> DataFrame | dict:
    """Path to the root and subroot of every node: a table (grp, place, path, subroot), or a dictionary of at most ``most`` of them."""
    if nodes.limit(shape.most + 1).count() <= shape.most:
        return upper(nodes, sources)
    if nodes.where("size > 1").isEmpty():  # a node for each of very many sources: they are one tree from here on
        one = placed(nodes.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "name")
        one = staged(one, "merkle-sources")
        over = paths(staged(reduced(one, shape), "merkle-blocks"), shape, sources=False)

        def renamed(table: pa.Table, levels: list, path: Path, subroot: bytes) -> pa.Table:
            names, leaves = table["name"].to_pylist(), levels[0]
            rows = [(siblings(levels, k) + path, d) for k, d in enumerate(leaves)]
            return pa.table([names, [0] * len(names), [_plain(p) for p, _ in rows], [d for _, d in rows]], _NODE)

        return staged(below(one, over, renamed, f"grp string, place long, path {_PATH}, subroot binary", shape), "merkle-paths")
    over = paths(staged(reduced(nodes, shape), "merkle-blocks"), shape, sources)

    def longer(table: pa.Table, levels: list, path: Path, subroot: bytes) -> pa.Table:
        rows = [_plain(siblings(levels, k) + path) for k in range(table.num_rows)]
        return pa.table([table["grp"], table["place"], rows, [subroot] * len(rows)], _NODE)

    return staged(below(nodes, over, longer, f"grp string, place long, path {_PATH}, subroot binary", shape), "merkle-paths")


def leaves(docs: DataFrame, other: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, grp (source in a form that sorts null first), place, size, digest; and tampered: the leaf with the columns
    of ``other`` in place of the row's own, where ``where`` holds."""
    doc_id, source = (F.col(c) for c in COLUMNS[:2])
    changed = F.lit(None).cast("binary") if where is None else F.when(where, F.unhex(leaf_hash((other or {}).get(c, F.col(c)) for c in COLUMNS)))
    grp = F.coalesce(F.concat(F.lit(":"), source.cast("string")), F.lit(""))
    rows = docs.select(doc_id, grp.alias("grp"), F.unhex(leaf_hash(F.col(c) for c in COLUMNS)).alias("digest"), changed.alias("tampered"))
    return staged(placed(staged(rows, "merkle-leaves"), "doc_id", "digest"), "merkle-places")


def manifest(docs: DataFrame, other: dict[str, Column] | None = None, where: Column | None = None, proofs: bool = True, shape: Shape = Shape()) -> DataFrame:
    """A row's doc_id, leaf, subroot, root, proof_sha256, folded_root and, with ``proofs``, its proof (before, after for each level).

    ``folded_root`` is what the row's proof leads to from the row as it is, or as it would be with the columns of ``other``
    where ``where`` holds; it differs from root if that changes the row.
    """
    base = leaves(docs, other, where)
    over = paths(staged(reduced(base, shape), "merkle-blocks"), shape)
    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (f", proof {_PATH}" if proofs else "")

    def finish(table: pa.Table, levels: list, path: Path, subroot: bytes) -> pa.Table:
        suffix = b"".join(x for step in path for x in step)
        root, rows = None, []
        for k, (own, tampered) in enumerate(zip(levels[0], table["tampered"].to_pylist(), strict=True)):
            inner = siblings(levels, k)
            root = root or folded(own, inner + path)
            found = folded(tampered.hex().encode() if tampered else own, inner + path)
            proof = hashlib.sha256(b"".join(x for step in inner for x in step) + suffix).hexdigest()
            rows.append((own.decode(), subroot.decode(), root.decode(), proof, found.decode(), *([_plain(inner + path)] if proofs else [])))
        columns = [pa.array(c) for c in zip(*rows, strict=True)]
        if proofs:
            columns[-1] = columns[-1].cast(_STEP)
        return pa.Table.from_arrays([table["doc_id"].combine_chunks().cast(pa.int64()), *columns], [f.split()[0] for f in kind.replace("before:binary,", "").split(", ")])

    return below(base, over, finish, kind, shape).withColumn("verified", F.col("folded_root") == F.col("root"))


def leads_to(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to, as a column."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s["before"].cast("string"), d, s["after"].cast("string")), 256))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return manifest(docs, {"text": F.translate("text", UPPER, LOWER)}, fifth, proofs=False)


def _level(k: int) -> str:
    """Level k + 1 from level k, with the siblings of every node of level k; a tree of one node is finished."""
    return f"""
r{k} AS (SELECT grp, place // 16 AS up, list(d ORDER BY place) AS ds, any_value(size) AS size FROM n{k} GROUP BY grp, place // 16),
s{k} AS (SELECT n.grp, n.place, CASE WHEN n.size > 1 THEN array_to_string(ds[1 : n.place % 16], '') ELSE '' END AS l, CASE WHEN n.size > 1 THEN array_to_string(ds[n.place % 16 + 2 :], '') ELSE '' END AS r FROM n{k} n JOIN r{k} r ON n.grp = r.grp AND n.place // 16 = r.up),
n{k + 1} AS (SELECT grp, up AS place, (size + 15) // 16 AS size, CASE WHEN size > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM r{k}),"""


def _folds(k: int, grp: str, place: str) -> str:
    """One more step of every row's fold and proof."""
    return f"""
f{k + 1} AS (SELECT f.* EXCLUDE (t, p), CASE WHEN s.l = '' AND s.r = '' AND n.size = 1 THEN t ELSE sha256(s.l || t || s.r) END AS t, p || s.l || s.r AS p FROM f{k} f JOIN s{k} s ON s.grp = {grp} AND s.place = {place} JOIN n{k} n ON n.grp = s.grp AND n.place = s.place),"""


#: Levels of the SQL for a source and for all sources: up to 16 ** 5 of either.
_UP = 5
_field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_leaf = lambda text: f"sha256({' || '.join(_field(c) for c in COLUMNS[:-1])} || {_field(text)})"
OP11_SQL = (
    f"""
WITH b AS (SELECT doc_id, coalesce(':' || source, '') AS grp, {_leaf("text")} AS leaf, {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS low,
  list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(substring(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
    lambda c, x: list_reduce(range(8), lambda a, i: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END), xor(c, x)), 4294967295) AS crc FROM documents),
base AS (SELECT doc_id, grp, leaf, CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN low ELSE leaf END AS t, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY grp) AS size FROM b WINDOW w AS (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf)),
n0 AS (SELECT grp, place, size, leaf AS d FROM base),"""
    + "".join(_level(k) for k in range(_UP))
    + f"""
n{_UP + 1} AS (SELECT '' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS place, count(*) OVER () AS size, d, grp AS name FROM n{_UP}),"""
    + "".join(_level(k) for k in range(_UP + 1, 2 * _UP + 1))
    + f"""
f0 AS (SELECT doc_id, grp, leaf, place, t, '' AS p FROM base),"""
    + "".join(_folds(k, "f.grp", f"f.place // {16**k}") for k in range(_UP))
    + f"""
f{_UP + 1} AS (SELECT f.* EXCLUDE place, n.place, n.d AS subroot FROM f{_UP} f JOIN n{_UP + 1} n ON f.grp = n.name),"""
    + "".join(_folds(k, "''", f"f.place // {16 ** (k - _UP - 1)}") for k in range(_UP + 1, 2 * _UP + 1))
    + f"""
root AS (SELECT d AS root FROM n{2 * _UP + 1})
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, t AS folded_root, t = root AS verified FROM f{2 * _UP + 1} CROSS JOIN root
"""
)
