"""Merkle dataset manifest over a SHA midstate tree.

Every row is a leaf, the digest of its fields. Leaves of a source ascend by id;
runs of ``FANOUT`` nodes become their digest until one is left, the source's
subroot, and subroots by source become the root in the same way. A parent keeps
a copy of its hash state from before each child slot; to fold a replaced child,
the state of its slot is resumed with the replacement and the siblings to the
right of it only.

Rows are placed by a range partitioning and cut into chunks of one source's
leaves, ``LEVELS`` levels high. One task builds a chunk; chunks' nodes are the
rows of the next round, one for 4096, until every source has one
node, then the sources' subroots climb alike. A second pass folds each chunk's
documents up to its node, and from there along the path that the chunk's
documents share. Only digests travel; texts stay where they are. No chunk
exceeds its bound, however large a source is or however often a row repeats.

Defined cases: a null in any field is hashed as ``-``; a null source is a
source of its own, the first; null ids come first in their source; rows that
repeat an id are leaves of their own, in the order of their digests; a lone
leaf is its source's subroot, and a lone subroot the root, with an empty proof;
an empty table gives no rows; long and empty texts need nothing special; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_up_to, running_total, stash, table
from .exact_dedup import ascii_lower

FANOUT = 16
LEVELS = 3                      # levels a chunk is high: 4096 leaves
HEX = 64                        # characters of a digest
BROADCAST_ROWS = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


class Parent:
    """A node over a run of children: its hash state before each child slot,
    the children's digests, and its own digest."""

    __slots__ = ("states", "children", "digest")

    def __init__(self, children: bytes) -> None:
        state = hashlib.sha256()
        self.states, self.children = [], children
        for at in range(0, len(children), HEX):
            self.states.append(state.copy())
            state.update(children[at:at + HEX])
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in ``slot``."""
        state = self.states[slot].copy()
        state.update(child + self.children[HEX * (slot + 1):])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> tuple[bytes, bytes]:
        return self.children[:HEX * slot], self.children[HEX * (slot + 1):]


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def build(nodes: Iterable[bytes], levels: int) -> tuple[list[list[Parent]], bytes]:
    """The parents of each level above ``nodes``, and the last level's node."""
    row, tree = b"".join(nodes), []
    for _ in range(levels):
        tree.append([Parent(row[at:at + FANOUT * HEX]) for at in range(0, len(row), FANOUT * HEX)])
        row = b"".join(p.digest for p in tree[-1])
    return tree, row


def _chunk(rows: pa.Table, most: int) -> tuple[list[int], list[bytes], int]:
    """Order of a chunk's rows, their digests in that order, and the levels
    that the chunk is high (``most``, or less if its group ends below)."""
    order = rows.column("pos").to_numpy().argsort().tolist()
    digests = rows.column("digest").cast(pa.binary()).take(order).to_pylist()
    return order, digests, min(most, height(rows.column("n")[0].as_py()))


def chunk_nodes(placed: DataFrame, most: int) -> DataFrame:
    """(grp, chunk, n, digest): the node above every chunk of (grp, pos, n,
    digest) rows; ``n`` counts the group's chunks."""
    size = FANOUT ** most

    def climb(rows: pa.Table) -> pa.Table:
        _, digests, levels = _chunk(rows, most)
        node = build(digests, levels)[1].decode()
        n = -(-rows.column("n")[0].as_py() // size)
        return pa.table({"grp": rows.column("grp")[:1], "chunk": rows.column("chunk")[:1], "n": pa.array([n]), "digest": [node]})

    return placed.select("grp", "chunk", "pos", "n", "digest").groupBy("grp", "chunk").applyInArrow(climb, "grp long, chunk long, n long, digest string")


def paths(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """For stored (grp, pos, n, digest) rows: (grp, pos, path), the siblings to
    the left and right on every level up to the group's last node, and (grp,
    top), that node."""
    size = FANOUT ** most

    def climb(rows: pa.Table) -> pa.Table:
        order, digests, levels = _chunk(rows, most)
        tree, node = build(digests, levels)
        found = []
        for slot in range(len(order)):
            path = []
            for level in tree:
                slot, place = slot // FANOUT, slot % FANOUT
                left, right = level[slot].siblings(place)
                path.append({"left": left.decode(), "right": right.decode()})
            found.append(path)
        taken = rows.take(order)
        return pa.table({"grp": taken.column("grp"), "pos": taken.column("pos"), "n": taken.column("n"), "chunk": taken.column("chunk"),
                         "path": pa.array(found, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
                         "top": [node.decode()] * len(order)})

    rounds = []
    while True:
        rows = nodes.select("grp", F.floor(F.col("pos") / size).alias("chunk"), "pos", "n", "digest")
        rounds.append(stash(rows.groupBy("grp", "chunk").applyInArrow(
            climb, f"grp long, pos long, n long, chunk long, path {PATH}, top string"), "merkle-round"))
        if (rounds[-1].agg(F.max("n")).first()[0] or 0) <= size:
            break
        nodes = rounds[-1].where(F.col("pos") % size == 0).select(
            "grp", F.col("chunk").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("digest"))
    upper = rounds[-1].select("grp", "pos", "path")
    for lower in reversed(rounds[:-1]):
        above = broadcast_up_to(upper.select("grp", F.col("pos").alias("chunk"), F.col("path").alias("_above")), BROADCAST_ROWS)
        upper = lower.join(above, ["grp", "chunk"]).select("grp", "pos", F.concat("path", "_above").alias("path"))
    return upper, rounds[-1].where("pos = 0").select("grp", "top")


class Manifest(NamedTuple):
    levels: int             # of a chunk
    leaves: DataFrame       # doc_id, grp, pos, n, chunk, digest and claimed of every row
    chunks: DataFrame       # grp, chunk, path to the root, subroot
    root: str | None


def leaf_digest(columns: dict[str, Column]) -> Column:
    """H of the fields, each as its byte count, a colon and its value, or ``-``."""
    parts = []
    for value in columns.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(rows: DataFrame, levels: int = LEVELS) -> Manifest:
    """The manifest of (doc_id, source, digest, claimed) rows, in chunks so many
    ``levels`` high."""
    spark = rows.sparkSession
    stored = stash(rows.withColumn("_one", F.lit(1)).withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    sources = stored.groupBy("source").agg(F.sum("_one").cast("long").alias("n")).withColumn("_one", F.lit(1).cast("long"))
    sources = stash(running_total(sources, ["source"], "_one", "grp", "merkle-sources"), "merkle-sources")
    sources = stash(running_total(sources, ["source"], "n", "_first", "merkle-sources").withColumnRenamed("source", "_source"), "merkle-sources")
    numbered = running_total(stored, ["source", "doc_id", "digest", "_row"], "_one", "_at", "merkle-order")
    placed = numbered.join(broadcast_up_to(sources.drop("_one"), BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("_source")))
    leaves = stash(placed.select("doc_id", "grp", (F.col("_at") - F.col("_first")).alias("pos"), "n", "digest", "claimed")
                   .withColumn("chunk", F.floor(F.col("pos") / FANOUT ** levels)), "merkle-placed")
    nodes = stash(chunk_nodes(leaves, levels), "merkle-chunks")
    inner, subroots = paths(nodes.withColumnRenamed("chunk", "pos"), levels)
    subroots = stash(subroots, "merkle-subroots")
    outer, root = paths(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"),
                                        F.lit(subroots.count()).cast("long").alias("n"), F.col("top").alias("digest")), levels)
    found = root.first()
    over = stash(outer.select(F.col("pos").alias("grp"), F.col("path").alias("_outer")).join(subroots, "grp"), "merkle-over")
    chunks = inner.join(broadcast_up_to(over, BROADCAST_ROWS), "grp").select(
        "grp", F.col("pos").alias("chunk"), F.concat("path", "_outer").alias("path"), F.col("top").alias("subroot"))
    return Manifest(levels, leaves, stash(chunks, "merkle-paths"), found["top"] if found else None)


def verify(found: Manifest) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256 (of its siblings up
    to the root), folded_root (from the claimed leaf) and verified."""
    most = found.levels

    def fold(rows: pa.Table, chunk: pa.Table) -> pa.Table:
        order, digests, levels = _chunk(rows, most)
        claimed = rows.column("claimed").cast(pa.binary()).take(order).to_pylist()
        tree, _ = build(digests, levels)
        above = []      # the shared levels: state before the slot, and siblings
        for step in chunk.column("path")[0].as_py():
            left, right = step["left"].encode(), step["right"].encode()
            above.append((hashlib.sha256(left), left + right, right))
        proofs, folded = [], []
        for slot, digest in enumerate(claimed):
            proof = hashlib.sha256()
            for level in tree:
                slot, place = slot // FANOUT, slot % FANOUT
                digest = level[slot].fold(place, digest)
                proof.update(b"".join(level[slot].siblings(place)))
            for before, siblings, right in above:
                proof.update(siblings)
                state = before.copy()
                state.update(digest + right)
                digest = state.hexdigest().encode()
            proofs.append(proof.hexdigest())
            folded.append(digest.decode())
        taken = rows.take(order)
        return pa.table({"doc_id": taken.column("doc_id"), "leaf": taken.column("digest"),
                         "subroot": [chunk.column("subroot")[0].as_py()] * len(order), "proof_sha256": proofs, "folded_root": folded})

    both = found.leaves.groupBy("grp", "chunk").cogroup(found.chunks.groupBy("grp", "chunk"))
    judged = both.applyInArrow(fold, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(found.root).cast("string")
    return judged.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                         (F.col("folded_root") == root).alias("verified"))


def tampered(doc_id: Column) -> Column:
    """The rows that the query tampers with; a null id has no decimal."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fields = {name: F.col(name) for name in FIELDS}
    other = leaf_digest({**fields, "text": ascii_lower(F.col("text"))})
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_digest(fields).alias("digest"),
                            F.when(tampered(F.col("doc_id")), other).alias("claimed"))
    return verify(manifest(rows.withColumn("claimed", F.coalesce("claimed", "digest"))))


def _sql_field(name: str, value: str | None = None) -> str:
    value = value or f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = " || ".join(_sql_field(f) for f in FIELDS)
_OTHER = " || ".join(_sql_field(f, _LOWER if f == "text" else None) for f in FIELDS)
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _climb(name: str, key: str) -> str:
    return f"""SELECT any_value(lvl) + 1, {key}, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i))
    FROM {name} WHERE n > 1 GROUP BY {key}, i // 16"""


def _folds(name: str, nodes: str) -> str:
    return f"""SELECT f.lvl + 1, f.r, f.g, f.i // 16, (f.n + 15) // 16,
        sha256(string_agg(CASE WHEN s.i = f.i THEN f.h ELSE s.h END, '' ORDER BY s.i))
    FROM {name} f JOIN {nodes} s ON s.lvl = f.lvl AND s.g = f.g AND s.i // 16 = f.i // 16
    WHERE f.n > 1 GROUP BY f.lvl, f.r, f.g, f.i, f.n"""


ORACLE = f"""
WITH RECURSIVE src AS (SELECT source AS name, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
d AS (SELECT row_number() OVER () AS r, doc_id, g, sha256({_LEAF}) AS leaf,
    sha256(CASE WHEN {_CRC} % 5 = 0 THEN {_OTHER} ELSE {_LEAF} END) AS claimed
    FROM documents JOIN src ON source IS NOT DISTINCT FROM name),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
node(lvl, g, i, n, h) AS (SELECT 0, g, pos, n, leaf FROM p UNION ALL {_climb("node", "g")}),
sub AS (SELECT g, h FROM node WHERE n = 1),
top(lvl, g, i, n, h) AS (SELECT 0, 0, g, (SELECT count(*) FROM src), h FROM sub UNION ALL {_climb("top", "g")}),
fold(lvl, r, g, i, n, h) AS (SELECT 0, r, g, pos, n, claimed FROM p UNION ALL {_folds("fold", "node")}),
over(lvl, r, g, i, n, h) AS (SELECT 0, r, 0, g, (SELECT count(*) FROM src), h FROM fold WHERE n = 1 UNION ALL {_folds("over", "top")}),
side AS (SELECT f.r, 0 AS part, s.lvl, s.i, s.h FROM fold f JOIN node s ON s.lvl = f.lvl AND s.g = f.g AND s.i // 16 = f.i // 16 AND s.i <> f.i
    UNION ALL SELECT f.r, 1, s.lvl, s.i, s.h FROM over f JOIN top s ON s.lvl = f.lvl AND s.i // 16 = f.i // 16 AND s.i <> f.i),
proof AS (SELECT r, string_agg(h, '' ORDER BY part, lvl, i) AS h FROM side GROUP BY r)
SELECT p.doc_id, p.leaf, sub.h AS subroot, root.h AS root, sha256(coalesce(proof.h, '')) AS proof_sha256,
    over.h AS folded_root, over.h = root.h AS verified
FROM p JOIN sub USING (g) JOIN over ON over.r = p.r AND over.n = 1 LEFT JOIN proof ON proof.r = p.r, (SELECT h FROM top WHERE n = 1) root
"""
