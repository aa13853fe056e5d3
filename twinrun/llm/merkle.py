"""Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, and a proof for every row.

Rows are leaves in the order of their key. Aligned runs of ``fanout ** depth`` leaves are blocks, hashed by one task each.
Above the blocks a butterfly exchange goes on: in each round every block sends the root it has reached to its
counterparts in the neighbouring subtrees of its run, gets theirs, and hashes the common ancestor itself. So all blocks of
a run hash the same ancestor, and after the last round each holds its upper proof: nothing is sent down again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from twinrun.llm.common import shuffle_partitions, stored, table

FANOUT = 3
#: Levels inside a block: 3 ** 8 = 6,561 leaves, about a megabyte in a task.
DEPTH = 8
PROOF = "array<struct<before:string,after:string>>"

# The columns of a leaf in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if NULL, else the number of its UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof in one string, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


# ---------------------------------------------------------------- inside a block


def _levels(n: int, fanout: int) -> int:
    """Levels until one of n nodes remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _hashed(leaves: list[str], levels: int, fanout: int) -> tuple[str, list[list[str]]]:
    """The root of a block and the nodes of each of its levels below the root."""
    nodes, below = leaves, []
    for _ in range(levels):
        below.append(nodes)
        runs = range(0, len(nodes), fanout)
        nodes = [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in runs]
    return nodes[0], below


def _proofs(below: list[list[str]], upper: list[dict], n: int, fanout: int) -> pa.Array:
    """The proof of each of n leaves: its siblings in each level of the block, then what all leaves of it share.

    Siblings are made once per node; leaves refer to them by number.
    """
    before, after, place = [], [], []
    for level, nodes in enumerate(below):
        start = len(before)
        for i in range(len(nodes)):
            first = i - i % fanout
            before.append("".join(nodes[first:i]))
            after.append("".join(nodes[i + 1 : first + fanout]))
        place.append(start + np.arange(n) // fanout**level)
    for step in upper:
        place.append(np.full(n, len(before)))
        before.append(step["before"])
        after.append(step["after"])
    index = pa.array(np.stack(place, axis=1).ravel() if place else np.zeros(0, np.int64))
    columns = [pa.array(side, pa.string()).take(index) for side in (before, after)]
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * len(place))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["before", "after"]))


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by("pos")


# ---------------------------------------------------------------- positions


def _placed(nodes: DataFrame, order: list[str], size: int, name: str) -> DataFrame:
    """Nodes (``tree, leaf``, further columns) with ``pos`` in their tree, the number ``n`` of leaves there, and ``block``.

    Ranges over tree, order and a row number split every tree, also one that holds most rows, and every group of equal
    keys. What a range holds of a tree is counted; the sums of these counts give each range its first position.
    """
    spark = nodes.sparkSession
    numbered = stored(nodes.withColumn("nr", F.monotonically_increasing_id()), f"{name}-leaves")
    keys = ["tree", *order, "leaf", "nr"]
    dealt = numbered.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    ranged = stored(dealt.drop("nr").withColumns({"range": F.spark_partition_id(), "at": at}), f"{name}-ranges")
    parts = ranged.groupBy("tree", "range").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    earlier = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "tree",
        "range",
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
    )
    placed = ranged.join(starts, ["tree", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("range", "at", "shift")
    return placed.withColumn("block", F.expr(f"pos div {size}"))


# ---------------------------------------------------------------- butterfly


def _round(state: DataFrame, reach: int, fanout: int) -> DataFrame:
    """One exchange: blocks in subtrees of ``reach`` blocks learn the roots of their run and hash its root.

    ``state``: tree, block, blocks (of the tree), digest (root of the block's subtree), proof. A block at offset s of a
    subtree with z blocks sends to the offsets s, s + z, ... of the others; z is ``reach``, so that is one counterpart
    each, but for the last subtree of a tree, which may be smaller than those it has to serve.
    """
    done = f"CAST(ceil(blocks / {reach}) AS BIGINT) <= 1"
    node = f"(block div {reach})"
    size = f"least({reach}, blocks - {node} * {reach})"
    peers = f"sequence({node} - {node} % {fanout}, least({node} - {node} % {fanout} + {fanout - 1}, (blocks - 1) div {reach}))"
    # To each subtree of the run: offsets from the own one on, in steps of the own size; the own subtree gets one row.
    others = f"""flatten(transform(filter({peers}, p -> p <> {node}), p ->
        CASE WHEN block % {reach} < least({reach}, blocks - p * {reach})
             THEN transform(sequence(block % {reach}, least({reach}, blocks - p * {reach}) - 1, {size}), o -> p * {reach} + o)
             ELSE array() END))"""
    sent = state.select(
        "tree",
        F.explode(F.expr(f"CASE WHEN {done} THEN array(block) ELSE concat(array(block), {others}) END")).alias("to"),
        F.expr(node).alias("node"),
        "block",
        "blocks",
        "digest",
        "proof",
    )
    got = sent.groupBy("tree", F.col("to").alias("block")).agg(
        F.first("blocks").alias("blocks"),
        F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("run"),
        F.max(F.when(F.col("block") == F.col("to"), F.col("proof"))).alias("proof"),
    )
    joined = "array_join(transform(filter(run, x -> x.node {0} {1}), x -> x.digest), '')"
    before, after = joined.format("<", node), joined.format(">", node)
    return got.select(
        "tree",
        "block",
        "blocks",
        F.expr(f"CASE WHEN {done} THEN run[0].digest ELSE sha2(array_join(run.digest, ''), 256) END").alias("digest"),
        F.expr(f"CASE WHEN {done} THEN proof ELSE concat(proof, array(struct({before} AS before, {after} AS after))) END").alias("proof"),
    )


def _trees(nodes: DataFrame, order: list[str], fanout: int, depth: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Trees over ordered leaves: the placed leaves, and for each block ``tree, block, blocks, digest`` (the root of its
    tree) and ``proof`` (from the block's root up to there)."""
    size = fanout**depth
    placed = stored(_placed(nodes, order, size, name), f"{name}-placed")

    def root(rows: pa.Table) -> pa.Table:
        rows, n = _sorted(rows), rows["n"][0].as_py()
        digest, _ = _hashed(rows["leaf"].to_pylist(), min(depth, _levels(n, fanout)), fanout)
        return pa.table([rows["tree"][:1], rows["block"][:1], pa.array([-(-n // size)], pa.int64()), pa.array([digest])],
                        names=["tree", "block", "blocks", "digest"])

    picked = placed.select("tree", "block", "pos", "n", "leaf")
    state = picked.groupBy("tree", "block").applyInArrow(root, "tree string, block bigint, blocks bigint, digest string")
    state = stored(state.withColumn("proof", F.expr(f"CAST(array() AS {PROOF})")), f"{name}-blocks")
    most = state.agg(F.max("blocks")).first()[0] or 1
    for r in range(_levels(most, fanout)):
        state = _round(state, fanout**r, fanout)
    return placed, state


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "source",
    key: str = "doc_id",
    carry: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    depth: int = DEPTH,
) -> DataFrame:
    """One row for each row of ``docs``: the key, the columns of ``carry``, ``leaf``, ``subroot`` (of its group), ``root``
    (of all groups) and ``proof``, an array with the siblings ``before`` and ``after`` the row's node in each level.

    A leaf is the SHA-256 of the fields. Leaves of a group ascend by key; while more than one node remains, runs of
    ``fanout`` become their hash, the last run being shorter if need be. Subroots, ordered by group, do likewise.

    NULLs are hashed as such; a NULL group is a group of its own and comes first, NULL keys come first in their group,
    rows with equal keys ascend by leaf, and full copies of a row are leaves each. Other columns are left out and may
    have any name. Long texts are hashed where they are read; only digests are shuffled. An empty table gives no rows.
    """
    taken = {"key": F.col(f"`{key}`"), "group": F.col(f"`{group}`").cast("string"), "leaf": leaf_of([F.col(f"`{f}`") for f in fields])}
    given = F.struct(*[c.alias(a) for a, c in (carry or {}).items()] or [F.lit(None).cast("string").alias("none")])
    leaves = docs.select(*[c.alias(a) for a, c in taken.items()], field(taken["group"]).alias("tree"), given.alias("carry"))
    placed, state = _trees(leaves, ["key"], fanout, depth, "merkle")
    state = stored(state, "merkle-state")

    groups = placed.groupBy("tree").agg(F.first("group").alias("group"))
    subroots = state.where("block = 0").join(groups, "tree")
    upper, top = _trees(subroots.select(F.lit("").alias("tree"), "group", F.col("tree").alias("of"), F.col("digest").alias("leaf")),
                        ["group"], fanout, depth, "merkle-top")
    above = _with_proofs(upper, top.withColumn("digests", F.array("digest")), ["of"], fanout, depth)
    above = above.select(F.col("of").alias("tree"), F.col("digests")[0].alias("root"), F.col("proof").alias("more"))
    whole = state.join(above, "tree").select(
        "tree", "block", F.array("digest", "root").alias("digests"), F.concat("proof", "more").alias("proof")
    )
    found = _with_proofs(placed, whole, ["key", "carry"], fanout, depth)
    names = [F.col("carry")[name].alias(name) for name in carry or {}]
    return found.select(
        F.col("key").alias(key), *names, "leaf", F.col("digests")[0].alias("subroot"), F.col("digests")[1].alias("root"), "proof"
    )


def _with_proofs(placed: DataFrame, state: DataFrame, columns: list[str], fanout: int, depth: int) -> DataFrame:
    """Leaves with the whole proof of each and the ``digests`` of their block's row."""
    picked = placed.select("tree", "block", "pos", "n", "leaf", *columns)
    added = T.StructType.fromDDL(f"digests array<string>, proof {PROOF}")
    schema = T.StructType([*picked.select(*columns, "leaf").schema, *added])

    def proven(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows, n = _sorted(rows), len(rows)
        _, below = _hashed(rows["leaf"].to_pylist(), min(depth, _levels(rows["n"][0].as_py(), fanout)), fanout)
        proofs = _proofs(below, known["proof"][0].as_py(), n, fanout)
        digests = pa.array([known["digests"][0].as_py()], pa.list_(pa.string())).take(pa.array(np.zeros(n, np.int64)))
        return pa.table([*[rows[c] for c in columns], rows["leaf"], digests, proofs], names=[*columns, "leaf", "digests", "proof"])

    of_block = state.select("tree", "block", "digests", "proof").groupBy("tree", "block")
    return picked.groupBy("tree", "block").cogroup(of_block).applyInArrow(proven, schema)


# ---------------------------------------------------------------- query


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its proof, and what the proof says of a copy that lost its line breaks (of every other row)."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    # Whether a row is tampered is part of the leaf that is carried; a row that is not has none.
    other = [F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]
    proven = manifest(docs, carry={"changed": F.when(tampered, leaf_of(other))})
    return proven.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = r"""
WITH RECURSIVE bits AS (
    SELECT b, 0 AS k, b AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)
    UNION ALL
    SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, source,
           concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'),
                  coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                  coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head, text,
           xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                           lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS crc
    FROM documents, crc
), hashed AS (
    SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN crc % 2 = 0
                THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS changed
    FROM docs
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
    FROM hashed
), low AS (
    SELECT tree, 0 AS level, pos, leaf AS digest FROM leaves
    UNION ALL
    SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, level, pos // 3
), subroots AS (
    SELECT tree, level AS height, digest AS subroot FROM low
    WHERE level = (SELECT max(level) FROM low AS l WHERE l.tree = low.tree)
), high AS (
    SELECT 0 AS level, tree AS pos, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY level, pos // 3
), top AS (
    SELECT level AS height, digest AS root FROM high ORDER BY level DESC LIMIT 1
), nodes AS (
    SELECT tree, level, pos, digest FROM low
    UNION ALL SELECT -1, level, pos, digest FROM high
), runs AS (
    SELECT tree, level, pos,
           coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, pos // 3 ORDER BY pos
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, pos // 3 ORDER BY pos
                                                 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM nodes
), steps AS (
    SELECT l.r, s.height + t.height AS steps, unnest(range(s.height + t.height)) AS k, s.height AS low_steps, l.tree, l.pos
    FROM leaves AS l JOIN subroots AS s USING (tree), top AS t
), proofs AS (
    SELECT r, k, before, after
    FROM steps JOIN runs ON runs.tree = CASE WHEN k < low_steps THEN steps.tree ELSE -1 END
         AND runs.level = CASE WHEN k < low_steps THEN k ELSE k - low_steps END
         AND runs.pos = CASE WHEN k < low_steps THEN steps.pos // CAST(pow(3, k) AS BIGINT)
                             ELSE steps.tree // CAST(pow(3, k - low_steps) AS BIGINT) END
), proof AS (
    SELECT r, string_agg(before || after, '' ORDER BY k) AS all_siblings, list({'b': before, 'a': after} ORDER BY k) AS list
    FROM proofs GROUP BY r
), fold AS (
    SELECT r, 0 AS k, coalesce(changed, leaf) AS node FROM leaves
    UNION ALL
    SELECT fold.r, fold.k + 1, sha256(list[fold.k + 1].b || node || list[fold.k + 1].a)
    FROM fold JOIN proof ON proof.r = fold.r WHERE fold.k < len(list)
), last AS (
    SELECT r, arg_max(node, k) AS folded_root FROM fold GROUP BY r
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(all_siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) JOIN last USING (r) LEFT JOIN proof USING (r), top
"""
