r"""Merkle manifest of a data set (operator 11): one tree of leaves a language, one tree of their roots above.

Every node carries the interval of leaf ranks that it covers, ``[lo, hi)``. Nodes of one level lie in buckets of
``FAN ** level`` ranks, so a node meets its parent by equality of (tree, bucket) and containment of intervals. Inside a
parent, whatever its interval has beyond the child's own is the siblings', left and right: the child's step of the
proof. Trees grow upwards level by level, each an eighth of the one before; proofs are handed down from the root, so
that only the lowest level ever is as large as the table, and no text moves at all.

H is sha256 in lowercase hex of its inputs laid end to end, digests as hex text. A leaf hashes doc_id, source, lang,
n_chars and text, each as byte count, ``:`` and value, or ``-`` if null.

Defined cases: null lang is a tree of its own, the first; ids ascend, null first, and rows of one id by their leaf; rows
that are wholly equal are leaves each; null and empty values hash differently; a tree of one leaf has that leaf as its
root, a table of one language its subroot; a proof without siblings hashes nothing; an empty table gives no rows. Only
the five columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.places import small, with_positions
from driftwell.operators.graph import cut, running_sums

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*values: Column) -> Column:
    """H of the values, each with its length, so that no two rows give the same input."""
    said = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*said), 256)


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["digest"]), "")


def leaves(rows: DataFrame, tree_col: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Leaves (tree, n, lo, hi, digest, body) and trees (tree, value of ``tree_col``, n).

    ``rows`` has ``tree_col``, ``digest`` and ``body``. Trees are numbered in order of their value, null first, ``n`` is
    their number of leaves, ``lo`` a leaf's rank in its tree.
    """
    by_tree = F.col(tree_col).asc_nulls_first()
    placed = with_positions(rows, [by_tree, *order])
    trees = running_sums(placed.groupBy(tree_col).agg(F.count("*").alias("n")), [by_tree], {"tree": F.lit(1), "start": F.col("n")})
    trees = cut(trees.select(F.col("tree").cast("long").alias("tree"), F.col(tree_col).alias("_value"), "n", "start"))
    known = small(trees, trees.count())
    rank = F.col("position") - F.col("start")
    placed = placed.join(known, F.col(tree_col).eqNullSafe(F.col("_value")))
    return placed.select("tree", "n", rank.alias("lo"), (rank + 1).alias("hi"), "digest", "body"), trees.select("tree", F.col("_value").alias(tree_col), "n")


def grow(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels above the leaves ``nodes``, lowest first, and (tree, digest) of the node that is left of each tree.

    A level has (tree, n, lo, hi, digest, parts); parts are its children with their intervals. A tree is left out of the
    levels above the one where it has a single node. ``largest`` is the number of leaves of the largest tree.
    """
    levels, width, tops = [], 1, nodes.where("n = 1").select("tree", "digest")
    body = ["body"] if "body" in nodes.columns else []
    while width < largest:
        width *= FAN
        part = F.struct("lo", "hi", "digest", *body)
        above = nodes.where(F.col("n") > width // FAN).groupBy("tree", "n", F.floor(F.col("lo") / width).alias("bucket")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
        above = above.select("tree", "n", F.col("parts")[0]["lo"].alias("lo"), F.element_at("parts", -1)["hi"].alias("hi"), F.sha2(_joined(F.col("parts")), 256).alias("digest"), "parts")
        nodes, body = cut(above), []  # FAN parts at most
        levels.append(nodes)
        tops = tops.unionByName(nodes.where(F.col("n") <= width).select("tree", "digest"))
    return levels, tops


def _step(parts: Column, lo: Column, hi: Column) -> Column:
    """The siblings in a parent's interval left and right of [lo, hi), as hex text."""
    return F.struct(_joined(F.filter(parts, lambda p: p["hi"] <= lo)).alias("left"), _joined(F.filter(parts, lambda p: p["lo"] >= hi)).alias("right"))


def hand_down(levels: list[DataFrame], start: DataFrame) -> DataFrame | None:
    """(tree, subroot, lo, hi, digest, body, path) of every leaf that has a parent; path: steps from the leaf to the root.

    ``start`` has (tree, subroot, path) of the trees' roots. A node's ancestors come with its parent's path, which it
    meets on the bucket of the parent's level.
    """
    above = None
    for k in range(len(levels), 0, -1):
        here, width = levels[k - 1], FAN**k
        met = here.where(F.col("n") <= width).join(start, "tree")
        if above is not None:
            parents = above.select("tree", F.floor(F.col("lo") / (width * FAN)).alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("parts").alias("peers"), "subroot", "path")
            inner = here.where(F.col("n") > width).withColumn("bucket", F.floor(F.col("lo") / (width * FAN))).join(parents, ["tree", "bucket"])
            inner = inner.where("from <= lo and hi <= to").withColumn("path", F.concat(F.array(_step(F.col("peers"), F.col("lo"), F.col("hi"))), F.col("path")))
            met = met.select("tree", "lo", "hi", "parts", "subroot", "path").unionByName(inner.select("tree", "lo", "hi", "parts", "subroot", "path"))
        above = met
    if above is None:
        return None
    each = above.select("tree", "subroot", "path", "parts", F.explode("parts").alias("x"))
    path = F.concat(F.array(_step(F.col("parts"), F.col("x.lo"), F.col("x.hi"))), F.col("path"))
    return each.select("tree", "subroot", "x.lo", "x.hi", "x.digest", "x.body", path.alias("path"))


def proofs(rows: DataFrame, tree_col: str, order: list[Column]) -> DataFrame:
    """(digest, body, subroot, root, path) for every row of ``rows`` (see ``leaves``)."""
    spark = rows.sparkSession
    base, trees = leaves(rows, tree_col, order)
    sizes = trees.agg(F.count("*"), F.max("n")).first()
    levels, tops = grow(base, sizes[1] or 0)
    # the roots of the trees are the leaves of the last tree
    roots = tops.select(F.lit(-1).cast("long").alias("tree"), F.lit(sizes[0]).cast("long").alias("n"), F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi"), "digest", F.struct("tree").alias("body"))
    roots = cut(roots)
    upper, top = grow(roots, sizes[0])
    root = (top.first() or [None, None])[1]
    none = spark.range(1).select(F.lit(-1).cast("long").alias("tree"), F.lit(root).alias("subroot"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    start = hand_down(upper, none)
    if start is None:
        start = roots.join(none, "tree")
    start = small(cut(start.select(F.col("body.tree").alias("tree"), F.col("digest").alias("subroot"), "path")), sizes[0])
    alone = base.where("n = 1").join(start, "tree").select("digest", "body", "subroot", "path")
    rest = hand_down(levels, start)
    out = alone if rest is None else alone.unionByName(rest.select("digest", "body", "subroot", "path"))
    return out.withColumn("root", F.lit(root))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda seen, step: F.sha2(F.concat(step["left"], seen, step["right"]), 256))


def is_tampered(doc_id: Column) -> Column:
    """The rows of the drill: 3 divides crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


def drill(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: does the manifest find the texts that were lower-cased?"""
    values = [F.col(c) for c in FIELDS]
    changed = leaf_digest(*values[:-1], F.translate("text", UPPER, LOWER))
    rows = docs.select("lang", leaf_digest(*values).alias("digest"), F.struct("doc_id", F.when(is_tampered(F.col("doc_id")), changed).alias("changed")).alias("body"))
    out = proofs(cut(rows), "lang", [F.col("body.doc_id").asc_nulls_first(), F.col("digest").asc()])
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    again = folded(F.coalesce("body.changed", "digest"), F.col("path"))
    out = out.select(F.col("body.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, tree_col: str = "lang") -> DataFrame:
    """(lang, level, lo, hi, digest): all nodes of the trees, the table to keep beside the data and to compare later."""
    rows = docs.select(tree_col, leaf_digest(*[F.col(c) for c in FIELDS]).alias("digest"), F.struct("doc_id").alias("body"))
    base, trees = leaves(cut(rows), tree_col, [F.col("body.doc_id").asc_nulls_first(), F.col("digest").asc()])
    sizes = trees.agg(F.count("*"), F.max("n")).first()
    levels, _ = grow(base, sizes[1] or 0)
    nodes = base.select("tree", F.lit(0).alias("level"), "lo", "hi", "digest")
    for k, nodes_k in enumerate(levels):
        nodes = nodes.unionByName(nodes_k.select("tree", F.lit(k + 1).alias("level"), "lo", "hi", "digest"))
    return nodes.join(small(trees, sizes[0]), "tree").select(tree_col, "level", "lo", "hi", "digest")


_LEVELS = 8  # trees of up to 8 ** 8 leaves


def _sql_tree(name: str, leaves: str) -> str:
    """name0 .. name8: the nodes (tree, r, n, digest) of each level; name_s0 ..: the same with their siblings' text before and after them."""
    out = [f"{name}0 AS (SELECT tree, r, n, digest FROM {leaves})"]
    for k in range(_LEVELS):
        run = "PARTITION BY tree, r // 8 ORDER BY r"
        text = lambda frame: f"coalesce(string_agg(digest, '' ORDER BY r) OVER ({run} ROWS BETWEEN {frame}), '')"  # noqa: B023, E731
        out.append(f"{name}_s{k} AS (SELECT *, {text('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS a, {text('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS b FROM {name}{k})")
        out.append(
            f"{name}{k + 1} AS (SELECT tree, r // 8 AS r, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY r)) END AS digest"
            f" FROM {name}{k} GROUP BY tree, r // 8)"
        )
    return ",\n".join(out)


def _sql_fold(name: str, rows: str, tree: str, r: str) -> str:
    """name: ``rows`` with the siblings' text and the refolded digest carried from their (tree, r) to the root of the tree."""
    at = rows
    out = []
    for k in range(_LEVELS):
        step = f"{name}{k + 1}" if k + 1 < _LEVELS else name
        out.append(
            f"{step} AS (SELECT x.* REPLACE (x.proof || s.a || s.b AS proof, CASE WHEN s.n = 1 THEN x.again ELSE sha256(s.a || x.again || s.b) END AS again) FROM {at} x"
            f" JOIN {name[0]}_s{k} s ON s.tree = x.{tree} AND s.r = x.{r} // {FAN**k})"
        )
        at = step
    return ",\n".join(out)


def sql_crc32(text_bytes: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a list of byte values."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return f"xor(list_reduce({text_bytes}, lambda c, b: xor(({table}::BIGINT[])[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


_said = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
_leaf = lambda text: "sha256(" + " || ".join(_said(c) for c in (*FIELDS[:-1], text)) + ")"
ORACLE = f"""
WITH d AS (SELECT doc_id, lang, {_leaf("text")} AS leaf,
  CASE WHEN {sql_crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 3 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
l AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d GROUP BY lang),
v AS (SELECT tree, n, doc_id, leaf AS digest, changed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d JOIN l ON d.lang IS NOT DISTINCT FROM l.lang),
{_sql_tree("t", "v")},
w AS (SELECT 0 AS tree, tree AS r, (SELECT count(*) FROM l) AS n, digest FROM t{_LEVELS}),
{_sql_tree("u", "w")},
b AS (SELECT v.*, s.digest AS subroot, '' AS proof, coalesce(changed, v.digest) AS again, 0 AS one FROM v JOIN t{_LEVELS} s ON s.tree = v.tree),
{_sql_fold("t_fold", "b", "tree", "r")},
{_sql_fold("u_fold", "t_fold", "one", "tree")}
SELECT doc_id, f.digest AS leaf, subroot, z.digest AS root, sha256(proof) AS proof_sha256, again AS folded_root, again = z.digest AS verified FROM u_fold f, u{_LEVELS} z
"""
