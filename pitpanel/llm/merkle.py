"""A Merkle manifest of a dataset, with proofs from parents' preimages.

Leaves are digests of whole rows. In each group (lang) they are numbered without gaps by range partitions and prefix
sums over the partitions' counts, so no task sees a whole group. A tree is built in stages: a block of 512 consecutive
nodes makes three levels at once, its last nodes are the nodes of the next stage. For every parent its preimage is
stored, the digests of its children one after the other. So a node finds its siblings by cutting its own 64 characters
out of the preimage, and a changed digest is folded upwards by splicing it into that place and hashing again.

Proofs go down the same way: the path of a node above its block is the same for all nodes of the block, so each stage
gives it to the blocks below, and leaves meet the preimages of their block and its path in one cogroup. Blocks have a
fixed size; tables shrink by 512 from stage to stage.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
DIGEST = 64
NODE = "key string, block long, total long, level int, idx long, preimage string, digest string"
PATH = "array<struct<slot:int,preimage:string>>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_for(total: int) -> int:
    """Levels of parents above so many nodes until one is left."""
    n = 0
    while FAN**n < total:
        n += 1
    return n


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(text: Column) -> Column:
    """The leaf of a row whose text is as given."""
    return F.sha2(F.concat(*[encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], encoded(text)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """key (of the lang; sorts as nulls first, then bytewise), doc_id, digest, other (the leaf of a tampered row, else null), uid."""
    changed = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit("n")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), row_digest(F.col("text")).alias("digest"),
        F.when(changed, row_digest(common.normalize_case(F.col("text")))).alias("other"), F.monotonically_increasing_id().alias("uid"),
    )


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos (from 0 in their key, by order) and total (rows of the key); rows must be a written table.

    Rows are dealt out by ranges of (key, order) and numbered in each range; the ranges' counts give where each starts.
    """
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumns({"part": F.spark_partition_id(), "at": at})
    dealt = common.materialize(dealt, "dealt")
    every = Window.partitionBy("key")
    before = F.sum("n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = dealt.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.select("key", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(every).alias("total"))
    return common.materialize(dealt.join(runs, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift"), "numbered")


def _block(table: pa.Table) -> pa.Table:
    """The parents of a block's nodes, level by level; of the only node of a key a row of level 0."""
    table = table.sort_by("pos")
    key, block, total = (table.column(c)[0].as_py() for c in ("key", "block", "total"))
    row = table.column("digest").to_pylist()
    out: list[tuple] = [(key, block, total, 0, 0, None, row[0])] if total == 1 else []
    for level in range(1, min(LEVELS, levels_for(total)) + 1):
        first = block * BLOCK // FAN**level
        preimages = ["".join(row[i : i + FAN]) for i in range(0, len(row), FAN)]
        row = [sha(p) for p in preimages]
        out += [(key, block, total, level, first + i, p, d) for i, (p, d) in enumerate(zip(preimages, row, strict=True))]
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("preimage", pa.string()), ("digest", pa.string())])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def climbed(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Tables of parents (NODE), one a stage, over nodes (key, pos, digest, total); most is the largest total."""
    stages = []
    while True:
        grouped = nodes.select("key", "pos", "digest", "total", F.expr(f"pos div {BLOCK}").alias("block")).groupBy("key", "block")
        stages.append(common.materialize(grouped.applyInArrow(_block, NODE), "preimages"))
        most = -(-most // BLOCK)
        if most <= 1:
            return stages
        nodes = tops(stages[-1])


def tops(stage: DataFrame) -> DataFrame:
    """The last node of each block of a stage, as a node of the next one."""
    last = F.expr(f"CASE WHEN total = 1 THEN 0 {' '.join(f'WHEN total <= {FAN**n} THEN {n}' for n in range(1, LEVELS))} ELSE {LEVELS} END")
    return stage.filter(F.col("level") == last).select("key", F.col("block").alias("pos"), "digest", F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"))


def own_steps(pos: int, total: int, preimages: dict) -> list[tuple[int, str]]:
    """Slot and preimage of a node's ancestors in its block, lowest first."""
    return [(pos // FAN ** (n - 1) % FAN, preimages[n, pos // FAN**n]) for n in range(1, min(LEVELS, levels_for(total)) + 1)]


def excised(steps: list[tuple[int, str]]) -> str:
    """The siblings: each preimage without the node's own digest."""
    return "".join(p[: DIGEST * s] + p[DIGEST * (s + 1) :] for s, p in steps)


def folded(digest: str, steps: list[tuple[int, str]]) -> str:
    """The root that a digest leads to when it is put in its place, level by level."""
    for s, p in steps:
        digest = sha(p[: DIGEST * s] + digest + p[DIGEST * (s + 1) :])
    return digest


def _with_block(nodes: DataFrame, stage: DataFrame, above: DataFrame, run, schema: str) -> DataFrame:
    """run(nodes of a block, preimages by level and number, path above the block, subroot) for each block, as one cogroup."""
    known = stage.filter("level > 0").select("key", "block", "level", "idx", "preimage", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    known = known.unionByName(above.select("key", "block", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(None).cast("string").alias("preimage"), "path", "subroot"))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        preimages, path, subroot = {}, [], None
        for row in right.to_pylist():
            if row["level"] < 0:
                path, subroot = [(s["slot"], s["preimage"]) for s in row["path"]], row["subroot"]
            else:
                preimages[row["level"], row["idx"]] = row["preimage"]
        return run(left, preimages, path, subroot)

    left = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
    return left.groupBy("key", "block").cogroup(known.groupBy("key", "block")).applyInArrow(block, schema)


def paths(nodes: DataFrame, stage: DataFrame, above: DataFrame) -> DataFrame:
    """key, block (the node's number), path and subroot of nodes (key, pos, total), to be handed to the stage below."""

    def run(left, preimages, path, subroot):
        out = {"key": left.column("key"), "block": left.column("pos")}
        steps = [own_steps(p, t, preimages) + path for p, t in zip(left.column("pos").to_pylist(), left.column("total").to_pylist(), strict=True)]
        out["path"] = pa.array([[{"slot": s, "preimage": p} for s, p in x] for x in steps], pa.list_(pa.struct([("slot", pa.int32()), ("preimage", pa.string())])))
        out["subroot"] = pa.array([subroot] * left.num_rows, pa.string())
        return pa.table(out)

    return common.materialize(_with_block(nodes.select("key", "pos", "total"), stage, above, run, f"key string, block long, path {PATH}, subroot string"), "paths")


def proofs(rows: DataFrame, stage: DataFrame, above: DataFrame, root: str) -> DataFrame:
    """RESULT rows of leaves (key, pos, total, doc_id, digest, other)."""

    def run(left, preimages, path, subroot):
        upper, out = excised(path), {c: [] for c in ("proof", "folded")}
        for row in left.select(["pos", "total", "digest", "other"]).to_pylist():
            steps = own_steps(row["pos"], row["total"], preimages)
            out["proof"].append(sha(excised(steps) + upper))
            out["folded"].append(folded(row["other"] or row["digest"], steps + path))
        n = left.num_rows
        same = pa.array([f == root for f in out["folded"]], pa.bool_())
        columns = [left.column("doc_id"), left.column("digest"), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(out["proof"], pa.string()), pa.array(out["folded"], pa.string()), same]
        return pa.Table.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return _with_block(rows.select("key", "pos", "total", "doc_id", "digest", "other"), stage, above, run, RESULT)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes doc_id, source, lang, n_chars and text; a null is `-`, an empty text is `0:`. Rows of a lang stand by
    doc_id (null first), rows of one doc_id by their leaf; equal rows get places next to each other and a proof each. A
    null lang is a group of its own, before all others. A row whose doc_id has a checksum that 3 divides is folded from
    the leaf of its text with A to Z in lower case; rows without a doc_id never are. An empty table gives no rows; columns
    besides those five play no part.
    """
    rows = numbered(common.materialize(leaves(docs), "leaves"), "doc_id", "digest", "uid")
    most = rows.agg(F.max("total")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    stages = climbed(rows, most)
    langs = common.materialize(tops(stages[-1]).select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), "subroots")
    langs = numbered(langs, "name")
    upper = climbed(langs, langs.count())
    root = tops(upper[-1]).first()["digest"]
    above = langs.sparkSession.createDataFrame([("", 0, [], None)], f"key string, block long, path {PATH}, subroot string")
    for k in range(len(upper) - 1, 0, -1):
        above = paths(tops(upper[k - 1]), upper[k], above)
    found = paths(langs, upper[0], above)
    above = langs.join(found.select(F.col("block").alias("pos"), "path"), "pos").select(F.col("name").alias("key"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"))
    for k in range(len(stages) - 1, 0, -1):
        above = paths(tops(stages[k - 1]), stages[k], above)
    return proofs(rows, stages[0], above, root)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(common.table(spark, sf_dir, "documents"))


def _sql_tree(name: str, start: str, depth: int) -> str:
    """CTEs name0 (key, p, d) to name{depth}: parents with digest d and preimage pre; a lone node stays, with no preimage."""
    out = [f"{name}0 AS ({start})"]
    for n in range(1, depth + 1):
        out.append(
            f"{name}{n} AS (SELECT key, p // 8 AS p, CASE WHEN any_value(t) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d, "
            f"CASE WHEN any_value(t) = 1 THEN '' ELSE string_agg(d, '' ORDER BY p) END AS pre FROM (SELECT key, p, d, count(*) OVER (PARTITION BY key) AS t FROM {name}{n - 1}) GROUP BY key, p // 8)"
        )
    return ",\n".join(out)


def _sql_fold(name: str, start: str, depth: int) -> str:
    """CTEs that take (rid, key, p, h, proof) of start up the tree, one a level, to {name}f{depth}."""
    out = [f"{name}f0 AS ({start})"]
    for n in range(1, depth + 1):
        slot, before, after = f"(f.p // {8 ** (n - 1)} % 8)", "left(pre, CAST(64 * s AS BIGINT))", "substr(pre, CAST(64 * s + 65 AS BIGINT))"
        out.append(
            f"{name}f{n} AS (SELECT rid, key, p, CASE WHEN pre = '' THEN h ELSE sha256({before} || h || {after}) END AS h, CASE WHEN pre = '' THEN proof ELSE proof || {before} || {after} END AS proof "
            f"FROM (SELECT f.*, n.pre, {slot} AS s FROM {name}f{n - 1} AS f JOIN {name}{n} AS n ON n.key = f.key AND n.p = f.p // {8**n}))"
        )
    return ",\n".join(out)


def oracle(depth: int = 8, lang_depth: int = 3) -> str:
    """DuckDB SQL for tables of up to 8 ** depth rows and 8 ** lang_depth langs."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    front = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), "
        f"lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})), 4294967295::BIGINT)"
    )
    return f"""
WITH l AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || lang, 'n') AS key, sha256({front} || {part("text")}) AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN sha256({front} || {part(low)}) END AS other FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS p FROM l
),
{_sql_tree("t", "SELECT key, p, leaf AS d FROM r", depth)},
g AS (SELECT key AS name, d FROM t{depth}),
{_sql_tree("u", "SELECT '' AS key, row_number() OVER (ORDER BY name) - 1 AS p, d FROM g", lang_depth)},
q AS (SELECT name, d, row_number() OVER (ORDER BY name) - 1 AS p FROM g),
{_sql_fold("t", "SELECT rid, key, p, coalesce(other, leaf) AS h, '' AS proof FROM r", depth)},
{_sql_fold("u", f"SELECT rid, '' AS key, q.p, h, proof FROM tf{depth} AS f JOIN q ON q.name = f.key", lang_depth)}
SELECT r.doc_id, r.leaf, g.d AS subroot, top.d AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = top.d AS verified
FROM r JOIN g ON g.name = r.key JOIN uf{lang_depth} AS f USING (rid), u{lang_depth} AS top
"""


ORACLE_OP12 = oracle()
