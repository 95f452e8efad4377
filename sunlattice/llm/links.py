"""Groups of linked members, from shared bucket keys, without pairing up what lies in a bucket.

A member's weight is the number of members in all its buckets; the text from which a group of near copies was made shares
more buckets with them than they do with each other, and so has the largest weight. The hub of a bucket is its member of
the largest weight. First each member meets one hub, that with which it shares the most buckets: a row a member at most,
however many keys it has. Where it is not linked to the same hub already, it then meets the next of the HUBS hubs that
come first for it, so members of a large group of near copies cost one row each. Verified links give groups. Buckets that
still hold members of different groups are then compared across groups, never inside one, in tiles of at most two blocks
of a bucket: a task holds a tile and returns only links that join groups, so rows grow with members, not with pairs. A
group of thousands of copies is one group by then; once an outsider is linked to one of them, the others are passed over.
Together the rounds examine every pair in a common bucket unless it is connected already, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunlattice.llm.components import connected_components
from sunlattice.llm.scratch import cut, discard, maybe_in

#: Hubs that a member meets at most before groups are compared.
HUBS = 3
#: Members of a block of a bucket at most, about, and bytes of their strings.
BLOCK, BLOCK_BYTES = 2_048, 8_000_000
Judge = Callable[[pa.Table], tuple[Callable[[int, np.ndarray], np.ndarray], Callable[[int, int], bool]]]


def linked_groups(
    members: DataFrame,
    close: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    bring: Callable[[DataFrame], DataFrame],
    judge: Judge,
) -> DataFrame:
    """(node, label) for the members that have a link.

    members: a table (not a plan: it is read several times) with uid (long, unique), keys (array of buckets) and what
    `close` needs. close(a, b): a condition on columns with the prefixes a and b that no true link fails (or only with
    the probability its author states). verify: takes a table of distinct pairs (a, b) of uids and returns those that
    are links. bring: takes the table of the uids that are compared across groups and returns what `judge` needs of them.
    judge: for the rows of a tile, two functions of row numbers: may(i, others) leaves out of an array of rows some that
    are not linked to row i, and linked(i, j) tells whether two are.
    """
    payload = [c for c in members.columns if c not in ("uid", "keys")]

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs that are `close`."""
        ends = pairs.select(F.col("a").alias("uid")).distinct().unionByName(pairs.select(F.col("b").alias("uid")).distinct())
        held = maybe_in(members, "uid", ends)

        def side(name: str) -> DataFrame:
            return held.select(F.col("uid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in payload])

        return pairs.join(side("b"), "b").join(side("a"), "a").where(close("a_", "b_")).select("a", "b")

    # outer: else Spark makes the keys of every member once more, to ask whether there are any
    placed = members.select("uid", F.explode_outer("keys").alias("key")).where("key is not null")
    counts = cut(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(maybe_in(placed, "key", counts.select("key")).join(counts, "key"))
    discard(counts)
    weights = shared.groupBy("uid").agg(F.sum("n").alias("weight"))
    shared = cut(shared.select("key", "uid").join(weights, "uid"))
    hub_of = cut(shared.groupBy("key").agg(F.max_by("uid", "weight").alias("hub")))
    met = shared.select("key", "uid").join(hub_of, "key").where("uid <> hub")

    often = F.transform(F.array_distinct("hubs"), lambda h: F.struct((-F.size(F.filter("hubs", lambda x: x == h))).alias("n"), h.alias("hub")))
    hubs = met.groupBy("uid").agg(F.collect_list(F.struct("key", "hub")).alias("at")).withColumn("hubs", F.col("at.hub"))  # a hub a key at most
    first = hubs.select("uid", "at", F.slice(F.array_sort(often), 1, HUBS)["hub"].alias("first"))
    unmet = F.filter("at", lambda x: ~F.array_contains("first", x["hub"]))["key"]
    first = cut(first.select("uid", "first", unmet.alias("unmet")))
    ranked = first.select("uid", F.posexplode("first").alias("rank", "hub")).select(F.col("hub").alias("a"), F.col("uid").alias("b"), "rank")
    tested = cut(near(ranked.where("rank = 0").select("a", "b")))
    found = cut(verify(tested))
    if HUBS > 1:
        # ends that are linked to one hub (or are it) are connected already
        roots = cut(found.select(F.col("b").alias("uid"), F.col("a").alias("root")))

        def rooted(pairs: DataFrame, end: str) -> DataFrame:
            own = roots.select(F.col("uid").alias(end), F.col("root").alias(f"root_{end}"))
            return pairs.join(own, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))

        apart = rooted(rooted(ranked.where("rank > 0"), "a"), "b").where("root_a <> root_b").select("a", "b")
        more = cut(near(cut(apart)))
        found = cut(found.unionByName(verify(more)))
        tested = tested.unionByName(more)
    groups = connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # the members of buckets that are still in several groups
    labels = groups.select(F.col("node").alias("uid"), "label")
    spread = shared.select("key", "uid").join(labels, "uid", "left").select("key", "uid", F.coalesce("label", "uid").alias("uid_group"))
    spread = cut(spread)
    mixed = spread.groupBy("key").agg(F.min("uid_group").alias("lo"), F.max("uid_group").alias("hi")).where("lo < hi")
    mixed = cut(mixed.select("key"))
    if mixed.isEmpty():
        return groups
    # a hub that all others of its bucket have met has no pair left there; most buckets hold two or three members
    owed = first.select(F.explode("unmet").alias("key")).distinct().withColumn("owed", F.lit(True))
    still = maybe_in(spread, "key", mixed).join(mixed, "key").join(maybe_in(hub_of, "key", mixed), "key")
    still = cut(still.join(owed, "key", "left").where("uid <> hub or owed").select("key", "uid", "uid_group"))
    mixed = still.groupBy("key").agg(F.min("uid_group").alias("lo"), F.max("uid_group").alias("hi")).where("lo < hi")
    still = cut(still.join(mixed.select("key"), "key"))
    if still.isEmpty():
        return groups
    mine = still.groupBy("uid").agg(F.collect_list("key").alias("mine"))
    table = bring(cut(still.select("uid").distinct()))
    dealt = _dealt(still.join(cut(table.join(mine, "uid")), "uid"))
    last = cut(dealt.mapInArrow(partial(_across, judge=judge), "a long, b long"))
    return groups if last.isEmpty() else _joined(groups, last)


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of buckets, sorted by tile: (key, lo, hi, part, rows' columns).

    A bucket that fits a block is one tile. Else its largest group, inside which nothing is compared, is dealt in blocks of
    its own, numbered -1, -2 and so on, and the others in blocks 0, 1 and so on. A tile holds block lo of the others, or lo
    and hi, where hi may be a block of the largest group: a row of that group is in one tile for each block of the others.
    """
    texts = [F.octet_length(c) for c, kind in rows.dtypes if kind == "string"]
    sizes = rows.select("key", "uid_group", sum(texts, F.lit(0)).alias("bytes"))
    sizes = sizes.groupBy("key", "uid_group").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")

    most = F.max(F.struct("n", "bytes", "uid_group"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), most.alias("most"))
    whole = blocks(F.col("n"), F.col("bytes")) == 1
    rest = blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes"))
    parted = F.when(whole, 0).otherwise(blocks(F.col("most.n"), F.col("most.bytes")))
    plan = sizes.select("key", F.col("most.uid_group").alias("largest"), parted.alias("parted"), F.when(whole, 1).otherwise(rest).alias("rest"))

    apart = (F.col("uid_group") == F.col("largest")) & (F.col("parted") > 0)
    own = F.pmod(F.xxhash64("uid"), F.when(apart, F.col("parted")).otherwise(F.col("rest"))).cast("int")
    other = rows.join(plan, "key").withColumn("own", F.when(apart, -1 - own).otherwise(own))
    first = F.when(apart, 0).otherwise(-F.col("parted"))
    other = other.withColumn("other", F.explode(F.sequence(first, F.col("rest") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    swap = low < 0
    tiles = other.withColumns({"lo": F.when(swap, high).otherwise(low), "hi": F.when(swap, low).otherwise(high)})
    named = tiles.withColumn("part", (F.col("own") != F.col("lo")).cast("int")).select("key", "lo", "hi", "part", *rows.drop("key").columns)
    return named.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _across(batches: Iterator[pa.RecordBatch], judge: Judge) -> Iterator[pa.RecordBatch]:
    """The links that join groups of one tile after the other."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
        tile = [held[c].to_numpy() for c in ("key", "lo", "hi")]
        starts = np.flatnonzero(np.any([np.diff(c) != 0 for c in tile], axis=0)) + 1
        edges = [0, *starts.tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield from _tile_links(held.slice(a, b - a), judge)
        held = held.slice(edges[-1])  # the last tile may go on
    if held is not None:
        yield from _tile_links(held, judge)


def _tile_links(table: pa.Table, judge: Judge) -> Iterator[pa.RecordBatch]:
    """Links between groups of a tile, each of them joining two groups that weren't connected before; pairs of members that
    are connected already are passed over, and a pair is compared in the first of the buckets that both are in."""
    uid, group, part = (table[c].to_numpy() for c in ("uid", "uid_group", "part"))
    key, two = table["key"][0].as_py(), table["lo"][0].as_py() != table["hi"][0].as_py()
    root, mine = np.unique(group, return_inverse=True)[1], [frozenset(m) for m in table["mine"].to_pylist()]
    if root.max() == 0:
        return
    may, linked = judge(table)
    spot, ends = np.arange(len(uid)), []
    for i in spot[part == 0]:
        others = np.flatnonzero((root != root[i]) & ((part == 1) if two else (spot > i)))
        for j in may(i, others).tolist():
            if root[i] != root[j] and min(mine[i] & mine[j]) == key and linked(i, j):
                ends.append((uid[i], uid[j]))
                root[root == root[j]] = root[i]
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups after more links."""
    known = groups.select(F.col("node").alias("u"), F.col("label").alias("v"))
    return connected_components(known.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
