"""A manifest of a table as a Merkle tree, and the proof that each of its rows hands over, by supersteps of messages between the tree's nodes.

A row is a leaf; the leaves of a group, in order, are combined two by two, level by level, to the group's subroot, and the subroots likewise to the root. The
tree is worked by vertices that stand ``STRIDE`` levels apart, each for the at most 2 ** STRIDE nodes below it:

* Up: in each superstep children message their digests to their parent's vertex; a vertex that has them all hashes the levels between and sends its own digest
  on in the next superstep. A group with one node left is done.
* Down: in each superstep a vertex sends every child the digests beside its way through those levels, ahead of what the vertex was sent itself. Leaves
  so get the siblings on their whole way to the root, fold them, and compare.

Supersteps are RDD jobs over pair keys (group, number of the vertex); a key gathers at most 2 ** STRIDE messages, so there is no hot key whatever the groups' sizes. Each
superstep's vertices are written to the shared folder before the next, which bounds the lineage and survives lost executors. The driver
holds counts and the root. Leaves are numbered in two levels: ranges of the order are counted first, and rows are only ordered inside one; rows alike in all
columns are told apart by a number that was written with them.

Edge cases: a null in any column is told apart from an empty text; rows without doc_id come first in their group and are never tampered with; a null
group comes first; repeated rows are leaves of their own; an odd node at a level's end is hashed alone; a group of one row has its leaf for subroot, and a
table of one group its subroot for root; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlake.llm.common import fresh_path, joinable, materialize, remove_at_exit

#: Levels of the tree between a vertex and its parent.
STRIDE = 5
#: Rows that are ordered in one task at least, and vertices worked in one, about.
ROWS, VERTICES = 1 << 14, 1 << 14

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest(*parts: bytes) -> bytes:
    """Of digests as hexadecimal text, one after the other."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def climb(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each of so many levels and of the one above them, from consecutive nodes of the lowest."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def beside(tree: list[list[bytes]], place: int) -> bytes:
    """The way from a place on the lowest level: for each level a byte, 0 where the node stands alone, 1 or 2 with the digest to its left or right."""
    out = []
    for nodes in tree[:-1]:
        other = place ^ 1
        out.append(b"\0" if other >= len(nodes) else (b"\1" if other < place else b"\2") + nodes[other])
        place >>= 1
    return b"".join(out)


def siblings(way: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(way):
        side = way[at]
        yield side, way[at + 1 : at + 33] if side else b""
        at += 33 if side else 1


def fold(node: bytes, way: bytes) -> bytes:
    for side, other in siblings(way):
        node = digest(node) if not side else digest(other, node) if side == 1 else digest(node, other)
    return node


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    return (n - 1).bit_length()


def _vertices(children: RDD, nodes: int) -> RDD:
    """((group, vertex), (size of the level, its children in order)) of children ((group, number), (size of the level, digest))."""
    parts = max(1, -(-nodes // VERTICES), min(nodes >> STRIDE, children.ctx.defaultParallelism))
    sent = children.map(lambda c: ((c[0][0], c[0][1] >> STRIDE), (c[0][1], *c[1])))
    return sent.groupByKey(parts).mapValues(lambda got: (next(iter(got))[1], [d for _, _, d in sorted(got)]))


def _levels(n: int) -> int:
    return min(STRIDE, height(n))


def _forward(vertex: tuple) -> tuple:
    (group, number), (n, nodes) = vertex
    levels = _levels(n)
    return (group, number), (-(-n >> levels) if levels else n, climb(nodes, levels)[-1][0])


def _written(spark, rdd: RDD, name: str) -> RDD:
    path = fresh_path(spark, name)
    rdd.saveAsPickleFile(path)
    remove_at_exit(spark, path)
    return spark.sparkContext.pickleFile(path)


def ways(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, i, way) of leaves (g, i, n, node) numbered from 0 in groups of n, and (g, top): what stands beside each leaf's way to its group's top, and that."""
    spark = leaves.sparkSession
    most, nodes = leaves.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    now = leaves.select("g", "i", "n", "node").rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]))))
    steps: list[RDD] = []
    sizes: list[int] = []
    left = most
    while True:  # up; a group that is done climbs no further levels
        sizes.append(nodes)
        steps.append(_written(spark, _vertices(now, nodes), "merkle-vertices"))
        if left <= 1 << STRIDE:
            break
        left, nodes = -(-left >> STRIDE), max(1, -(-nodes >> STRIDE))
        now = steps[-1].map(_forward)
    tops = steps[-1].map(_forward).map(lambda v: (v[0][0], v[1][1]))
    sent: RDD | None = None
    for level, known in reversed(list(enumerate(steps))):  # down
        if sent is None:
            held = known.mapValues(lambda v: (v, b""))
        else:
            held = known.join(sent, max(1, -(-sizes[level] // VERTICES), min(sizes[level] >> STRIDE, known.ctx.defaultParallelism)))
        sent = held.flatMap(_told)
        if level:
            sent = _written(spark, sent, "merkle-ways")
    kind = "g long, i long, way binary"
    return spark.createDataFrame(sent.map(lambda c: (c[0][0], c[0][1], bytearray(c[1]))), kind), spark.createDataFrame(tops.map(lambda t: (t[0], bytearray(t[1]))), "g long, top binary")


def _told(vertex: tuple) -> Iterable[tuple]:
    (group, number), ((n, nodes), above) = vertex
    tree = climb(nodes, _levels(n))
    return [((group, (number << STRIDE) + k), beside(tree, k) + above) for k in range(len(nodes))]


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with i, from 0 in the order of the columns order within those of group, and n, the rows there; order tells all rows of a group apart."""
    n = rows.count()
    parts = max(1, -(-n // max(ROWS, 8 * math.isqrt(n))))
    dealt = rows.repartitionByRange(parts, *group, *order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "ordered-leaves", keep=True)
    counts = dealt.groupBy(*group, "part").agg(F.count("*").alias("in_part"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("in_part").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"of_{c}") for c in group], F.col("part").alias("of_part"), before.alias("offset"), F.sum("in_part").over(w).alias("n"))
    inside = dealt.withColumn("inside", F.row_number().over(Window.partitionBy(*group, "part").orderBy(*order)) - 1)
    same = F.col("part") == F.col("of_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return inside.join(joinable(offsets, "offsets"), same).select(*rows.columns, (F.col("inside") + F.col("offset")).cast("long").alias("i"), "n")


_PROOFS = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string"


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            way = r["way"] + r["above"]
            out.append((r["doc_id"], r["leaf"], r["subroot"].hex(), r["root"].hex(), "".join(d.hex() for side, d in siblings(way) if side), fold(bytes.fromhex(r["told"]), way).hex()))
        names = [c.split(" ")[0] for c in _PROOFS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(zip(*out, strict=True))] if out else [pa.array([], pa.int64()), *[pa.array([], pa.string())] * 5], names)


def manifest(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root) of rows (doc_id, grp, leaf, told).

    leaf is a row's digest, told the digest that is claimed for it; folded_root is the root that told gives with the siblings of the untampered leaf, and proof
    those siblings, from the leaf's level up.
    """
    rows = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    groups = materialize(rows.groupBy("grp").agg(F.lit(0).alias("all")), "groups")
    order = numbered(groups, ["all"], ["grp"]).select(F.col("grp").alias("of_grp"), F.col("i").alias("g"), F.col("n").alias("n_groups"))
    order = materialize(order, "group-numbers")
    placed = numbered(rows, ["grp"], ["doc_id", "leaf", "tie"]).join(order, F.col("grp").eqNullSafe(F.col("of_grp")))
    placed = materialize(placed.select("doc_id", "leaf", "told", "g", "i", "n"), "numbered-leaves")
    below, tops = ways(placed.select("g", "i", "n", F.unhex("leaf").alias("node")))
    tops = materialize(tops, "subroots")
    subroots = order.join(tops, "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.col("n_groups").alias("n"), F.col("top").alias("node"))
    above, root = ways(subroots)
    above = materialize(above, "ways-of-subroots")
    top = root.first()
    known = above.select(F.col("i").alias("of_g"), F.col("way").alias("above")).join(tops.select(F.col("g").alias("of_top"), F.col("top").alias("subroot")), F.col("of_g") == F.col("of_top"))
    known = materialize(known.select("of_g", "above", "subroot"), "known-subroots")
    sent = below.select(F.col("g").alias("w_g"), F.col("i").alias("w_i"), "way")
    joined = placed.join(sent, (F.col("g") == F.col("w_g")) & (F.col("i") == F.col("w_i"))).join(known, F.col("g") == F.col("of_g"))
    return joined.select("doc_id", "leaf", "told", "way", "above", "subroot", F.lit(bytes(top["top"]) if top else b"").alias("root")).mapInArrow(_proofs, _PROOFS)


def op13_merkle_manifest(docs: DataFrame) -> DataFrame:
    """The contract's columns for each row of docs (doc_id, source, lang, n_chars, text), whose leaves are grouped by lang."""
    values = [F.col(c) for c in FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    forged = [v + 1 if c == "n_chars" else v for c, v in zip(FIELDS, values, strict=True)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("grp"), leaf(*values).alias("leaf"), F.when(tampered, leaf(*forged)).alias("forged"))
    proofs = manifest(rows.select("doc_id", "grp", "leaf", F.coalesce("forged", "leaf").alias("told")))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value}), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


#: The checksum's table and its fold over the digits of a number.
_CRC_SQL = "list_transform(range(256), lambda i: list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_FOLDED_SQL = "CASE WHEN s.h IS NULL THEN sha256(p.told) WHEN p.i % 2 = 1 THEN sha256(s.h || p.told) ELSE sha256(p.told || s.h) END, p.proof || coalesce(s.h, '')"
OP13_SQL = f"""WITH RECURSIVE c AS (SELECT {_CRC_SQL} AS t),
d AS (SELECT row_number() OVER () AS r, *, xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM documents, c),
h AS (SELECT r, doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf_sql('n_chars + 1')} END AS forged FROM d),
o AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents)),
l AS (SELECT r, doc_id, g, leaf, coalesce(forged, leaf) AS told, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM h JOIN o ON h.lang IS NOT DISTINCT FROM o.lang),
u AS (SELECT g, 0 AS v, i, n, leaf AS h FROM l UNION ALL SELECT g, v + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY g, v, i // 2, n),
w AS (SELECT u.g AS i, o.n, 0 AS v, h FROM u JOIN o USING (g) WHERE u.n = 1 UNION ALL SELECT i // 2, (n + 1) // 2, v + 1, sha256(string_agg(h, '' ORDER BY i)) FROM w WHERE n > 1 GROUP BY v, i // 2, n),
p AS (SELECT r, g, 0 AS v, i, n, told, '' AS proof FROM l UNION ALL SELECT r, p.g, p.v + 1, p.i // 2, (p.n + 1) // 2, {_FOLDED_SQL} FROM p LEFT JOIN u s ON s.g = p.g AND s.v = p.v AND s.i = xor(p.i, 1) WHERE p.n > 1),
q AS (SELECT r, 0 AS v, p.g AS i, o.n, told, proof FROM p JOIN o USING (g) WHERE p.n = 1 UNION ALL SELECT r, p.v + 1, p.i // 2, (p.n + 1) // 2, {_FOLDED_SQL} FROM q p LEFT JOIN w s ON s.v = p.v AND s.i = xor(p.i, 1) WHERE p.n > 1)
SELECT l.doc_id, l.leaf, u.h AS subroot, w.h AS root, sha256(q.proof) AS proof_sha256, q.told AS folded_root, q.told = w.h AS verified FROM l JOIN q ON q.r = l.r AND q.n = 1 JOIN u ON u.g = l.g AND u.n = 1 JOIN w ON w.n = 1"""
