"""The prefix trie of conversations, its subtrees summed along heavy paths.

A node is a distinct sequence of first turns; its members are the conversations that start with it. The heavy child of a
node is the one with the most members (ties: the smallest member), so a light child has at most half of its parent's
members, and no way down from the root has more than log2(members) light steps. Nodes joined by heavy steps are a path.
Sums over subtrees go up in as many rounds as there are light steps on a way, at most: each round takes the paths of one
level, adds what light paths below have brought, sums along the paths from their ends, and brings the sums at the tops to
the parents of the paths. Every node is in one round.

No key gathers its rows: turns are numbered, prefixes hashed and paths summed in blocks of BLOCK places, whose totals
are summed on their own; members of a node are counted and listed in blocks too, and only the lists of ids that end at
one node are read in order by one task, as a hash needs them, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunlattice.llm.scratch import cut
from sunlattice.llm.words import word_count

#: Bits of the places of a block, and of the ids of a list.
BLOCK, LIST = 10, 13
#: Fixed by contract: how many first turns a conversation may take over, and which conversation it takes them from.
HEADS, FAMILY = 4, 20
#: Block of turns without a number: before all others.
NO_TURN = -(1 << 62)


def _scan(
    df: DataFrame, keys: list[str], place: str, columns: list[str], agg: Callable, join: Callable[[Column, Column], Column], backward: bool = False
) -> DataFrame:
    """`df` with each of `columns` replaced by its aggregate over the rows of the key up to its own place (from it on, if
    backward). Places are distinct longs; blocks of them are aggregated apart and joined, so a long key is many tasks."""
    toward = (lambda c: F.col(c).desc()) if backward else F.col
    held = df.withColumn("_block", F.shiftright(place, BLOCK))
    totals = held.groupBy(*keys, "_block").agg(*[agg(c).alias(f"_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy(toward("_block")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_block", *[agg(f"_{c}").over(earlier).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_block").orderBy(toward(place)).rowsBetween(Window.unboundedPreceding, 0)
    joined = held.join(before, [*keys, "_block"])
    return joined.select(*[join(agg(c).over(inside), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def _xor(now: Column, before: Column) -> Column:
    return now.bitwiseXOR(F.coalesce(before, F.lit(0).cast("long")))


def _plus(now: Column, before: Column) -> Column:
    return now + F.coalesce(before, F.lit(0).cast("long"))


def numbered_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, t1, t2, words): each turn's number in its conversation, from 0, a hash of 128 bits of its role and
    text (null: empty), and the words of its text. Turns go by number, null first, then by role and text; rows that repeat
    a turn are turns of their own. Rows with a null conv_id are in no conversation and take no part."""
    turns = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.withColumn("part", F.coalesce(F.shiftright("turn", BLOCK), F.lit(NO_TURN)))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    return turns.join(before, ["conv_id", "part"]).select(
        "conv_id",
        (F.row_number().over(inside) + F.col("before") - 1).alias("place"),
        F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64(F.lit(2), "role", "text").alias("t2"),
        word_count(F.col("text")).cast("long").alias("words"),
    )


def rebuilt_turns(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of the rebuilt conversations: conversation c takes the first h turns of c - c % 20, as far as there
    are any, in place of its own first h; h is the crc32 of its id, modulo 4. convs: (conv_id, n)."""
    wish = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    asked = convs.select("conv_id", "n", wish.alias("h"), first.alias("base"))
    bases = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    given = asked.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = cut(given.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size")))
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    taken = plan.where("head > 0").join(heads, "base").where("place < head").select("conv_id", "place", "t1", "t2", "words", "size")
    own = turns.join(plan, "conv_id").where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "t1", "t2", "words", "size")
    return taken.unionByName(own), plan.select("conv_id", "size")


HASHED = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's lists, which follow each other; no more than one batch is held."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, digest.hexdigest()), HASHED.types, strict=True)], schema=HASHED)

    for batch in batches:
        for node, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("node", "depth", "ids")], strict=True):
            if key == (node, depth):
                digest.update(b",")
            else:
                if key:
                    yield row()
                key, digest = (node, depth), hashlib.sha256()
            digest.update(ids.encode())
    if key:
        yield row()


def _ends(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) from (node, depth, conv_id): ids of a block are one list, and lists are hashed in order."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    lists = ends.groupBy("node", "depth", F.shiftright("conv_id", LIST).alias("block")).agg(ids.alias("ids"))
    ordered = lists.repartition("node", "depth").sortWithinPartitions("node", "depth", "block")
    return ordered.select("node", "depth", "ids").mapInArrow(_hash_lists, "node long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves, saved_tokens and ends_sha256.

    turns: (conv_id, place, t1, t2, words, size), places of a conversation gapless from 0; convs: (conv_id, size), also
    those without turns, which are members of the root alone. Without conversations there is no node, not even a root.
    Sequences are told apart by 128 bits of hash and their length; equal turns at different places count as different.
    """
    chain = turns.select(
        "conv_id",
        "place",
        "size",
        "words",
        F.xxhash64("place", "t1", "t2").alias("x1"),
        F.xxhash64(F.lit(3), "t2", "place", "t1").alias("x2"),
    ).select("*", F.col("x1").alias("d1"), F.col("x2").alias("d2"))
    chain = _scan(chain, ["conv_id"], "place", ["d1", "d2"], F.bit_xor, _xor)
    chain = cut(chain.withColumn("depth", F.col("place") + 1).drop("place"))

    zero = F.lit(0).cast("long")
    grouped = chain.groupBy("depth", "d1", "d2").agg(
        F.min("conv_id").alias("node"),
        F.count("*").alias("n_convs"),
        F.max("words").alias("words"),
        F.max(F.col("d1").bitwiseXOR(F.col("x1"))).alias("p1"),  # the same in all rows
        F.max(F.col("d2").bitwiseXOR(F.col("x2"))).alias("p2"),
    )
    root = convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), "node", "n_convs", zero.alias("words"), zero.alias("p1"), zero.alias("p2"))
    nodes = cut(grouped.unionByName(root))

    # parents, and which child of each is heavy
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("node").alias("parent"))
    linked = cut(nodes.join(above, ["depth", "p1", "p2"], "left").drop("p1", "p2"))
    kids = linked.where("depth > 0").groupBy("parent", "depth").agg(
        F.count("*").alias("n_children"), F.max_by("node", F.struct("n_convs", -F.col("node"))).alias("heavy")
    )
    kids = cut(kids)
    number = kids.select(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth"), "n_children")
    light = F.coalesce(F.col("node") != F.col("heavy"), F.lit(False))
    full = linked.join(kids.select("parent", "depth", "heavy"), ["parent", "depth"], "left").withColumn("light", light)
    full = full.join(number, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero)).drop("heavy")
    full = cut(full)

    # tops of paths: the last light step on the way down a conversation that is the smallest member of some node
    owners = nodes.select(F.col("node").alias("conv_id")).distinct()
    ways = chain.select("conv_id", "depth", "d1", "d2").join(owners, "conv_id", "left_semi").join(full.where("depth > 0"), ["depth", "d1", "d2"])
    top = F.when(F.col("light"), F.struct("depth", "node")).when(F.col("depth") == 1, F.struct(zero.alias("depth"), F.col("parent").alias("node")))
    ways = ways.withColumn("top", top).withColumn("level", F.col("light").cast("long"))
    ways = _scan(ways, ["conv_id"], "depth", ["top"], F.max, F.greatest)
    ways = _scan(ways, ["conv_id"], "depth", ["level"], F.sum, _plus)
    kept = ["node", "depth", "parent", "n_convs", "n_children", "words", "top", "level"]
    start = full.where("depth = 0").withColumn("top", F.struct("depth", "node")).withColumn("level", zero)
    paths = cut(ways.where("conv_id = node").select(*kept).unionByName(start.select(*kept)), by="level")

    sums = _subtree_sums(paths)
    last = chain.where("depth = size").select("conv_id", "depth", "d1", "d2")
    last = last.unionByName(convs.where("size = 0").select("conv_id", zero.alias("depth"), zero.alias("d1"), zero.alias("d2")))
    ends = _ends(last.join(nodes.select("depth", "d1", "d2", "node"), ["depth", "d1", "d2"]).select("node", "depth", "conv_id"))
    return (
        paths.join(sums, ["node", "depth"])
        .join(ends, ["node", "depth"], "left")
        .select(
            F.col("node").alias("conv_id"),
            "depth",
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def _subtree_sums(paths: DataFrame) -> DataFrame:
    """(node, depth, n_leaves, saved_tokens): a round for each level of light steps, from the deepest one up."""
    deepest = paths.agg(F.max("level")).first()[0] or 0
    done, brought = None, None
    for level in range(deepest, -1, -1):
        own = paths.where(F.col("level") == level).select(
            "node",
            "depth",
            "parent",
            "top",
            (F.col("n_children") == 0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        )
        if brought is not None:
            own = own.join(brought, ["node", "depth"], "left")
            for c in ("n_leaves", "saved_tokens"):
                own = own.withColumn(c, F.col(c) + F.coalesce(f"more_{c}", F.lit(0)))
            own = own.drop("more_n_leaves", "more_saved_tokens")
        summed = cut(_scan(own, ["top"], "depth", ["n_leaves", "saved_tokens"], F.sum, _plus, backward=True))
        tops = summed.where((F.col("depth") == F.col("top.depth")) & (F.col("depth") > 0))
        brought = tops.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(
            F.sum("n_leaves").alias("more_n_leaves"), F.sum("saved_tokens").alias("more_saved_tokens")
        )
        part = summed.select("node", "depth", "n_leaves", "saved_tokens")
        done = part if done is None else done.unionByName(part)
    return done


def conversation_trie(df: DataFrame, rebuild: bool = False) -> DataFrame:
    """The prefix trie of a table of turns (conv_id, turn, role, text), of the conversations as they are, or rebuilt.

    Rows with a null conv_id take no part; null roles and texts are empty ones; turns go by number (null first), role and
    text; repeated rows are turns of their own; other columns are ignored; an empty table gives an empty one.
    """
    turns = cut(numbered_turns(df))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    if rebuild:
        return prefix_trie(*rebuilt_turns(turns, cut(convs)))
    convs = cut(convs.withColumnRenamed("n", "size"))
    return prefix_trie(turns.join(convs, "conv_id"), convs)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversation_trie(table, rebuild=True)


OP13_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT list(list_reduce([i] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS tab FROM range(256) AS g(i)),
o AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 20 AS base, n,
         xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id), t),
r AS MATERIALIZED (
  SELECT c.conv_id, 0 AS own, o.pos, role, text FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h),
p AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS size, text,
         sha256(string_agg(md5(role) || md5(text), '') OVER w) AS key
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
  UNION ALL
  SELECT conv_id, 0, (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id), '', '' FROM c),
k AS MATERIALIZED (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM p),
n AS MATERIALIZED (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(up) AS up,
         (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = size), '')) AS ends
  FROM k GROUP BY depth, key),
f AS MATERIALIZED (
  SELECT n.*, u.conv_id AS parent FROM n LEFT JOIN n AS u ON u.depth = n.depth - 1 AND u.key = n.up),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS m FROM f WHERE depth > 0 GROUP BY ALL),
g AS MATERIALIZED (
  SELECT f.*, coalesce(m, 0) AS n_children FROM f LEFT JOIN kids ON kids.parent = f.conv_id AND kids.depth = f.depth),
s AS (
  SELECT k.depth, k.key, sum((n_children = 0)::BIGINT) AS leaves, sum(saved) AS saved
  FROM g JOIN k ON k.conv_id = g.conv_id AND k.depth <= g.depth GROUP BY ALL)
SELECT g.conv_id, g.depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM g JOIN s ON s.depth = g.depth AND s.key = g.key
"""
