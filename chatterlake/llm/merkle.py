"""Merkle manifest of a table: one tree of digests a key, one tree over their roots.

Rows are leaves, numbered within their key by a range sort. On every level a node finds its siblings by
equijoins of the level with itself: slot ``s`` of a run looks for slot ``(s + shift) % arity``, one join
a shift (in binary trees the one sibling's slot is ``s XOR 1``). The rows of slot zero then hold the
whole run and emit the parents. Runs are spread by (key, run), so no key and no level is one task,
and all joins of a level share two shuffles. Every level is written; a lost executor rereads it.

Proofs go back down: a node's steps are its own siblings and then its parent's steps, joined once a level.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.llm.common import ascii_lower
from chatterlake.storage import fresh_path, write_table

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PART_BITS = 33  # of monotonically_increasing_id


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts as lowercase hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its UTF-8 length before it, so that neighbouring fields cannot run together."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_key(lang: Column) -> Column:
    """A key that is never null and sorts as ``lang`` does, null first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


class Tree(NamedTuple):
    """Levels of all trees of a forest, leaves first.

    ``levels[i]``: tree, idx, n (nodes of the tree on this level), digest, left, right (digests of the
    siblings before and behind it); only trees with more than one node. ``single[i]``: tree,
    idx, digest of trees with one node on this level.
    """

    levels: list[DataFrame]
    single: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        out = self.single[0].select("tree", "digest")
        for level in self.single[1:]:
            out = out.unionByName(level.select("tree", "digest"))
        return out


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add idx, the place of a row within its ``tree`` by ``order``, and n, the rows of the tree.

    Rows are sorted by ranges, so a large tree spans tasks; what a task needs to know of the others is
    one row per task and tree.
    """
    spark = rows.sparkSession
    keys = ["tree", *order]
    placed = write_table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .withColumn("place", F.monotonically_increasing_id())
                         .withColumn("part", F.shiftright("place", _PART_BITS)),
                         fresh_path(spark, "merkle-leaves"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows")).select(
        "tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return (placed.join(starts, ["tree", "part"])
            .withColumn("idx", F.col("place") + F.col("shift")).drop("place", "part", "shift"))


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """Add left and right: the digests of a node's siblings before and behind it, joined to one text."""
    spread = nodes.withColumn("run", F.expr(f"idx div {arity}")).withColumn("slot", (F.col("idx") % arity).cast("int"))
    found = spread
    for shift in range(1, arity):
        wanted = F.col("slot").bitwiseXOR(1) if arity == 2 else (F.col("slot") + shift) % arity
        other = spread.select(F.col("tree").alias("tree_"), F.col("run").alias("run_"), F.col("slot").alias("slot_"),
                              F.col("digest").alias(f"at_{shift}"))
        # the slot is compared as a difference: a key of its own would ask for a new shuffle a shift
        found = found.join(other, (F.col("tree") == F.col("tree_")) & (F.col("run") == F.col("run_"))
                           & (wanted - F.col("slot_") == 0), "left").drop("tree_", "run_", "slot_")
    shifted = F.array(*(f"at_{s}" for s in range(1, arity)))
    # shifts that pass the end of the run come back at slot zero
    left = F.array_join(F.slice(shifted, F.lit(arity) - F.col("slot"), F.col("slot")), "")
    right = F.array_join(F.slice(shifted, F.lit(1), F.lit(arity - 1) - F.col("slot")), "")
    return found.select(*nodes.columns, F.when(F.col("slot") > 0, left).otherwise("").alias("left"), right.alias("right"))


def build(leaves: DataFrame, arity: int = ARITY) -> Tree:
    """The trees over ``leaves`` (tree, idx, n, digest and columns that stay with the leaf)."""
    spark = leaves.sparkSession
    nodes = leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, single = [], []
    while True:
        single.append(nodes.where("n = 1"))
        if most <= 1:
            return Tree(levels, single)
        level = write_table(with_siblings(nodes.where("n > 1"), arity), fresh_path(spark, f"merkle-level-{len(levels)}"))
        levels.append(level)
        nodes = level.where(F.col("idx") % arity == 0).select(
            "tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            digest("digest", "right").alias("digest"))
        most = -(-most // arity)


def with_steps(tree: Tree, tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """Leaves with steps: the siblings (left, right) from the leaf up, then the steps of ``tops``.

    ``tops`` has one row a tree: tree, steps, and columns that every leaf of the tree gets.
    """
    spark = tops.sparkSession
    given = [c for c in tops.columns if c not in ("tree", "steps")]

    def ends(level: int) -> DataFrame:
        return tree.single[level].join(tops, "tree")

    above = ends(len(tree.levels))
    for number in reversed(range(len(tree.levels))):
        level = tree.levels[number]
        kept = [c for c in level.columns if c not in ("left", "right", "n")]
        parents = above.select("tree", F.col("idx").alias("run"), F.col("steps").alias("upper"), *given)
        step = F.array(F.struct("left", "right"))
        below = (level.withColumn("run", F.expr(f"idx div {arity}")).join(parents, ["tree", "run"])
                 .select(*kept, F.concat(step, "upper").alias("steps"), *given))
        above = below.unionByName(ends(number).select(*kept, "steps", *given))
        if number:
            above = write_table(above, fresh_path(spark, f"merkle-steps-{number}"))
    return above


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest leads to along its steps."""
    return F.aggregate(steps, leaf, lambda below, step: digest(step["left"], below, step["right"]))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "lang", order: str = "doc_id",
             extra: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """One row per input row: the ``order`` column, leaf, subroot, root, steps and ``extra`` columns.

    A leaf is the digest of ``fields``; the trees by ``key`` hold their leaves by ``order``, nulls first
    (rows of equal order by their digest; equal rows are equal leaves). Runs of ``arity`` nodes become
    their digest while a tree has more than one node, also a last run of a single node; a tree of
    one leaf is that leaf. The roots, by key in bytewise order with null first, form one more tree.
    Columns that are not among ``fields`` are ignored, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    added = {f"extra_{i}": c for i, c in enumerate((extra or {}).values())}
    rows = docs.select(tree_key(F.col(key)).alias("tree"), F.col(order).alias("row_id"),
                       digest(*(field(F.col(c)) for c in fields)).alias("digest"),
                       *(c.alias(n) for n, c in added.items()))
    trees = build(write_table(numbered(rows, "row_id", "digest"), fresh_path(spark, "merkle-numbered")), arity)
    subroots = write_table(
        numbered(trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest"), "member"),
        fresh_path(spark, "merkle-subroots"))
    top = build(subroots, arity)
    root = top.roots().select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("steps"),
                              F.col("digest").alias("root"))
    tops = write_table(with_steps(top, root, arity), fresh_path(spark, "merkle-tops")).select(
        F.col("member").alias("tree"), "steps", "root", F.col("digest").alias("subroot"))
    return with_steps(trees, tops, arity).select(
        F.col("row_id").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "steps",
        *(F.col(n).alias(name) for n, name in zip(added, extra or {})))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows whose doc_id has a crc32 that 3 divides are checked against a changed text, whose A-Z are lower
    case; all others, and null doc_ids, against their own.
    """
    changed = digest(*(field(F.when(F.col("text").isNotNull(), ascii_lower(F.col("text"))) if c == "text" else F.col(c))
                       for c in FIELDS))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, extra={"changed": F.when(tampered, changed)})
    siblings = F.array_join(F.flatten(F.transform("steps", lambda s: F.array(s["left"], s["right"]))), "")
    return (rows.withColumn("proof_sha256", digest(siblings))
            .withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("steps")))
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


def _sql_leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIBLINGS = """SELECT *, coalesce(string_agg(digest, '') OVER (
            PARTITION BY tree, level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
        coalesce(string_agg(digest, '') OVER (
            PARTITION BY tree, level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights"""
_PARENTS = """SELECT level + 1, tree, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i))"""
_FOLD = """SELECT f.r, f.level + 1, f.tree, f.i // 8, s.n,
            CASE WHEN s.n > 1 THEN sha256(lefts || acc || rights) ELSE acc END, proof || lefts || rights"""
#: crc32 of the id's digits: DuckDB has none, so it is folded bit by bit over each byte.
_CRC = """list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
            lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, zero: xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""

ORACLE = f"""
    WITH RECURSIVE leaves AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, {_sql_leaf("text")} AS leaf,
               CASE WHEN xor({_CRC}, 4294967295) % 3 = 0 THEN {_sql_leaf(_LOWER)} END AS changed
        FROM documents),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
               count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    up(level, tree, i, n, digest) AS (
        SELECT 0, tree, i, n, leaf FROM placed
        UNION ALL {_PARENTS} FROM up WHERE n > 1 GROUP BY level, tree, i // 8, n),
    sibs AS ({_SIBLINGS} FROM up),
    fold(r, level, tree, i, n, acc, proof) AS (
        SELECT r, 0, tree, i, 2::BIGINT, coalesce(changed, leaf), '' FROM placed
        UNION ALL {_FOLD} FROM fold f JOIN sibs s USING (level, tree, i) WHERE f.n > 1),
    subroots AS (
        SELECT tree AS member, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n
        FROM up WHERE n = 1),
    up2(level, tree, i, n, digest) AS (
        SELECT 0, '', i, n, subroot FROM subroots
        UNION ALL {_PARENTS} FROM up2 WHERE n > 1 GROUP BY level, tree, i // 8, n),
    sibs2 AS ({_SIBLINGS} FROM up2),
    fold2(r, level, tree, i, n, acc, proof) AS (
        SELECT f.r, 0, '', s.i, 2::BIGINT, f.acc, f.proof FROM fold f JOIN subroots s ON s.member = f.tree WHERE f.n = 1
        UNION ALL {_FOLD} FROM fold2 f JOIN sibs2 s USING (level, tree, i) WHERE f.n > 1)
    SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root,
           f.acc = t.digest AS verified
    FROM placed p JOIN subroots s ON s.member = p.tree JOIN fold2 f ON f.r = p.r AND f.n = 1
    JOIN up2 t ON t.n = 1"""
