"""Prefix trie of conversations, as an interval encoding.

Every conversation is a sequence of turns; the distinct prefixes are the nodes of a trie. A node is named by its smallest member and its
depth, which no other node shares. Nodes are ranked in lexicographic order of their sequences (turns in order of their digests), which
is the trie's preorder, so a subtree is an interval of ranks and any sum over it a difference of two prefix sums. Ranks are found without
sorting sequences: a node comes one after its parent and all nodes below its earlier siblings, so its rank is a running sum along its path.

All sums run over range-partitioned tables (`running_sums`), so neither a conversation, nor the children of a node, nor the copies of one
sequence meet in one task. Prefixes are told apart by SHA-256 digests, folded in blocks of BLOCK turns, blocks of blocks and so on, so a
conversation of any length takes a logarithm of it in steps of bounded groups. Texts are read once and never shuffled.

Turns are ordered by turn number (null first), then role, then the digest of role and text; a null role or text is an empty one. Rows with
a null conv_id belong to no conversation and are left out. Repeated rows are turns of their own. An empty table has no conversation, hence
no node. Other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.shared import materialise, table
from shoal.operators.running import running_sums, sums_within

BLOCK, CHUNK = 64, 4096
FAMILY, HEADS = 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, chars) of rows(conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    read = rows.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    placed = sums_within(materialise(read), ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "digest"], {"before": F.lit(1)})
    return placed.select("conv_id", (F.col("before") + 1).alias("pos"), "digest", "chars")


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns() to (conv_id, depth, digest, chars) of the rebuilt conversations, and all conv_ids. A family's first conversation gives its first
    HEADS - 1 turns at most to each of its FAMILY members."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    ids = own.where("pos = 1").select("conv_id", family.alias("family"), head_turns(F.col("conv_id")).alias("h"))
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("family"), "pos", "digest", "chars")
    taken = ids.join(heads, "family").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    n_heads = heads.groupBy("family").agg(F.max("pos").alias("n_heads"))
    rest = own.withColumn("h", head_turns(F.col("conv_id"))).where("pos > h").withColumn("family", family).join(n_heads, "family", "left")
    depth = F.col("pos") - F.col("h") + F.least(F.col("h"), F.coalesce("n_heads", F.lit(0)))
    return taken.unionByName(rest.select("conv_id", depth.alias("depth"), "digest", "chars")), ids.select("conv_id")


def prefixes(seq: DataFrame) -> DataFrame:
    """seq(conv_id, depth, digest), a checkpoint, with `path`, a digest of the sequence of all digests up to depth."""
    block = F.floor((F.col("depth") - 1) / BLOCK)
    folded = seq.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "digest"))).alias("s"))
    hashed = lambda a, b: F.unhex(F.sha2(F.concat(a, b), 256))
    step = lambda acc, t: F.concat(acc, F.array(F.struct(t["depth"].alias("depth"), t["digest"].alias("digest"), hashed(F.coalesce(F.get(acc, F.size(acc) - 1)["inner"], F.lit(b"")), t["digest"]).alias("inner"))))
    start = F.array().cast("array<struct<depth: bigint, digest: binary, inner: binary>>")
    inner = materialise(folded.select("conv_id", "block", F.aggregate("s", start, step).alias("s")))
    rows = inner.select("conv_id", "block", F.inline("s"))
    if inner.where("block > 0").isEmpty():
        return rows.select("conv_id", "depth", "digest", F.col("inner").alias("path"))
    longer = inner.where("block > 0").select("conv_id").distinct()
    blocks = inner.join(longer, "conv_id", "left_semi").select("conv_id", (F.col("block") + 1).alias("depth"), F.element_at("s", -1)["inner"].alias("digest"))
    outer = prefixes(materialise(blocks)).select("conv_id", F.col("depth").alias("block"), F.col("path").alias("outer"))  # the blocks before block k are 1 to k
    return rows.join(outer, ["conv_id", "block"], "left").select("conv_id", "depth", "digest", F.when(F.col("block") > 0, hashed(F.col("outer"), F.col("inner"))).otherwise(F.col("inner")).alias("path"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends(owner, depth, conv_id) to (owner, depth, ends_sha256): the ids of a node in ascending order, joined by commas, hashed. Ids are joined
    in chunks of a range of CHUNK ids; what is left of a node's ends is streamed through its digest, never held."""
    chunks = ends.groupBy("owner", "depth", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = chunks.select("owner", "depth", "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()

        def put(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0][k] for d in done], pa.int64()) for k in (0, 1)] + [pa.array([d[1] for d in done], pa.string())], ["owner", "depth", "ends_sha256"])

        for batch in batches:
            done = []
            for owner, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if (owner, depth) != node:
                    if node:
                        done.append((node, digest.hexdigest()))
                    node, digest = (owner, depth), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            yield put(done)
        if node:
            yield put([(node, digest.hexdigest())])

    return joined.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "chunk").mapInArrow(run, "owner long, depth long, ends_sha256 string")


def trie(seq: DataFrame, ids: DataFrame) -> DataFrame:
    """seq(conv_id, depth, digest, chars) with depths 1, 2, ... and all conv_ids (those without a turn too) to the trie's nodes: (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, rank, last), where rank to last are the subtree's ranks."""
    seq, ids = materialise(seq), materialise(ids)
    first, n_convs = ids.agg(F.min("conv_id"), F.count("*")).first()
    paths = materialise(prefixes(seq.select("conv_id", "depth", "digest")))
    owned = materialise(paths.groupBy("path").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")))
    rows = materialise(paths.join(owned, "path").select("conv_id", "depth", "owner", "n_convs", "digest"))
    lengths = rows.groupBy("conv_id").agg(F.max("depth").alias("length"), F.min(F.when(F.col("owner") == F.col("conv_id"), F.col("depth"))).alias("own_from"))
    lengths = materialise(lengths)
    # A conversation owns the nodes of its path from own_from on: so many of them lie below each node of the path.
    below = F.when(F.col("own_from").isNotNull(), F.col("length") - F.greatest("depth", "own_from") + 1).otherwise(0)
    sized = rows.join(lengths, "conv_id").groupBy("owner", "depth").agg(F.sum(below).alias("nodes"))
    own = rows.where("owner = conv_id").select("owner", "depth", "digest", "n_convs").join(seq.select(F.col("conv_id").alias("owner"), "depth", "chars"), ["owner", "depth"])
    parents = rows.select(F.col("conv_id").alias("owner"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    nodes = own.join(sized, ["owner", "depth"]).join(parents, ["owner", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(first)))
    placed = materialise(sums_within(nodes, ["depth", "parent"], ["digest"], {"beside": F.col("nodes")}))
    # Ranks: running sums along the paths of all conversations that own a node; the root has rank 0.
    steps = rows.join(placed.select("owner", "depth", (F.col("beside") + 1).alias("step")), ["owner", "depth"]).join(lengths.where("own_from is not null").select("conv_id"), "conv_id", "left_semi")
    along = sums_within(steps.select("conv_id", "depth", "owner", "step"), ["conv_id"], ["depth"], {"before": F.col("step")})
    ranks = along.where("owner = conv_id").select("owner", "depth", (F.col("before") + F.col("step")).alias("rank"))
    children = placed.groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    all_nodes = placed.count() + 1
    root = seq.sparkSession.createDataFrame([(first, 0, None, n_convs, 0, all_nodes, 0)] if n_convs else [], "owner long, depth long, parent long, n_convs long, chars long, nodes long, rank long")
    every = placed.join(ranks, ["owner", "depth"]).select("owner", "depth", "parent", "n_convs", "chars", "nodes", "rank").unionByName(root).join(children, ["owner", "depth"], "left")
    every = every.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # Sums over the ranks rank to rank + nodes - 1 are what stands before the next rank after the subtree less what stands before its top.
    saved = (F.col("n_convs") - 1) * F.col("chars")
    summed = materialise(running_sums(every.withColumn("saved", saved), ["rank"], {"leaves": (F.col("n_children") == 0).cast("long"), "saving": F.col("saved")}))
    upto = summed.select(F.col("rank").alias("last"), (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("to_leaves"), (F.col("saving") + F.col("saved")).alias("to_saving"))
    full = summed.withColumn("last", F.col("rank") + F.col("nodes") - 1).join(upto, "last")
    stops = rows.join(lengths, "conv_id").where("depth = length").select("owner", "depth", "conv_id")
    stops = stops.unionByName(ids.join(lengths.select("conv_id"), "conv_id", "left_anti").select(F.lit(first).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    out = full.join(ends_digests(stops), ["owner", "depth"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("to_leaves") - F.col("leaves")).alias("n_leaves"), (F.col("to_saving") - F.col("saving")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "rank", "last",
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(materialise(turns(table(spark, sf_dir, "conversations"))))).drop("rank", "last")


#: The eight steps of a byte of CRC-32, and the remainder by 6 of the CRC of a conversation's decimal id.
_BYTE = "list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda h, b: {_BYTE.format(x='xor(h, b)')}), 4294967295) % 6"
SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS family, {_CRC} AS h FROM (SELECT DISTINCT conv_id FROM o)),
heads AS (SELECT conv_id AS family, pos, role, text FROM o WHERE conv_id % 100 = 0 AND pos < 6),
seq AS (SELECT i.conv_id, pos AS depth, role, text FROM ids i JOIN heads USING (family) WHERE pos <= h
 UNION ALL SELECT o.conv_id, pos - h + least(h, (SELECT count(*) FROM heads x WHERE x.family = i.family)), role, text FROM o JOIN ids i ON i.conv_id = o.conv_id WHERE pos > h),
p AS (SELECT conv_id, depth, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path, text, max(depth) OVER (PARTITION BY conv_id) AS length FROM seq
 UNION ALL SELECT conv_id, 0, CAST([] AS STRUCT(role VARCHAR, text VARCHAR)[]), '', coalesce((SELECT max(depth) FROM seq s WHERE s.conv_id = ids.conv_id), 0) FROM ids),
n AS (SELECT depth, path, min(conv_id) AS owner, count(*) AS n_convs, any_value(length(text)) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256 FROM p GROUP BY depth, path),
c AS (SELECT a.owner, a.depth, count(b.owner) AS n_children FROM n a LEFT JOIN n b ON b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path GROUP BY ALL),
t AS (SELECT a.owner, a.depth, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.chars) AS BIGINT) AS saved_tokens FROM n a JOIN n b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path JOIN c ON c.owner = b.owner AND c.depth = b.depth GROUP BY ALL)
SELECT n.owner AS conv_id, CAST(n.depth AS BIGINT) AS depth, (SELECT m.owner FROM n m WHERE m.depth = n.depth - 1 AND m.path = n.path[1:n.depth - 1]) AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM n JOIN c ON c.owner = n.owner AND c.depth = n.depth JOIN t ON t.owner = n.owner AND t.depth = n.depth
"""
