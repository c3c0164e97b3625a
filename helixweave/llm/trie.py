"""Conversation prefix trie by partition refinement.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it.

* All conversations begin in one class, the root. Turn by turn an active class splits by its members' next turn; a
  class is named by its smallest member, a turn by 128 bits of its hash.
* A class of one member retires: the turns that are left are a unary chain, one row each. A class with few open
  turns (``FEW``) is refined to its end in one task, turn by turn as well. Larger ones go on in the next round; so
  there are as many rounds as turns that a larger class shares, and a class may have any number of members: its
  members meet in counts alone.
* Leaves and saved tokens fold back from the last round to the first, children into parents. A chain's nodes are
  known as they stand: one leaf, nothing saved.

The members that end in a node are written as decimal numbers, ascending, into one SHA-256. A digest takes its
input in one stream; rows of up to ``RUN`` ids reach it in order, and the task that feeds it holds one at a time.

Edge cases: rows without conv_id belong to no conversation; null turns come first, equal ones in order of role and
text; null roles and texts count as empty; repeated rows are turns like others; texts of any length are hashed and
counted whole; an empty table has no node, not even a root. Further columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, n_parts

WORD = r"[^\x20\x09-\x0D]+"
#: Members and open turns of a class that one task refines to its end, at most.
FEW = 1024
#: Range of ids that one piece of a digest's input holds.
RUN = 1024
NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def turns(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """(conv_id, place, key, words): turns numbered from 1 in each conversation.

    Rows are sorted by ranges of (conv_id, turn), so that a conversation of any length is numbered by many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first()]
    rows = rows.repartitionByRange(n_parts(spark, rows), *order).sortWithinPartitions(*order, "role", "text")
    got = cut(rows.select("conv_id", F.monotonically_increasing_id().alias("row"), key.alias("key"), words.alias("words")).withColumn("part", F.shiftright("row", 33)), spark)
    # one row for each range that a conversation meets
    counts = got.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    counts = counts.select("conv_id", "part", "first", before.alias("before"))
    return cut(got.join(counts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("row") - F.col("first") + 1).alias("place"), "key", "words"), spark)


def rebuilt(spark: SparkSession, numbered: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, key, words, total), (conv_id, total)) of the rebuilt conversations; total is their number of turns.

    Conversation c begins with the first h turns of conversation c - c % group, h = crc32(c) % most, and goes on with
    its own turns after its first h.
    """
    lengths = cut(numbered.groupBy("conv_id").agg(F.max("place").alias("n")), spark)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    plans = lengths.select("conv_id", "n", h.cast("long").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    # what a base gives is short, and few conversations take it
    heads = numbered.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "key", "words")
    given = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plans = plans.join(given, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    plans = cut(plans.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), spark)
    first = plans.where("taken > 0").join(heads, "base").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "key", "words", "total")
    own = numbered.join(plans, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "key", "words", "total")
    return cut(first.unionByName(own), spark), plans.select("conv_id", "total")


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def _refined(table: pa.Table) -> pa.Table:
    """All nodes of the subtree of one class, given its members' turns from the class's own one on."""
    parent, top = table.column("class")[0].as_py(), min(table.column("depth").to_pylist())
    path: dict[int, dict] = {}
    for c, d, k, w in zip(*(table.column(x).to_pylist() for x in ("conv_id", "depth", "key", "words")), strict=True):
        path.setdefault(c, {})[d] = (k, w)
    nodes: list[list] = []
    todo = [(sorted(path), top, parent, -1)]
    while todo:
        members, depth, above, at = todo.pop()
        w = path[members[0]][depth][1]
        ended = [c for c in members if depth + 1 not in path[c]]
        split: dict[str, list[int]] = {}
        for c in members:
            if depth + 1 in path[c]:
                split.setdefault(path[c][depth + 1][0], []).append(c)
        todo += [(m, depth + 1, members[0], len(nodes)) for m in split.values()]
        nodes.append([members[0], depth, above, len(members), len(split), 0 if split else 1, (len(members) - 1) * w, _digest(ended), at])
    for x in reversed(nodes):
        if x[8] >= 0:
            nodes[x[8]][5] += x[5]
            nodes[x[8]][6] += x[6]
    columns = [pa.array([x[k] for x in nodes], pa.string() if k == 7 else pa.int64()) for k in range(8)]
    return pa.Table.from_arrays([*columns, pa.array([top] * len(nodes), pa.int64())], [*_NAMES, "since"])


def _streamed(batches):
    """(depth, conv_id, ends_sha256) from pieces sorted by (depth, conv_id, run)."""
    now, state, done = None, None, []
    for batch in batches:
        for depth, node, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "conv_id", "piece")), strict=True):
            if (depth, node) != now:
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (depth, node), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string() if k == 2 else pa.int64()) for k in range(3)], ["depth", "conv_id", "ends_sha256"])
        done = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([state.hexdigest()])], ["depth", "conv_id", "ends_sha256"])


def _ends(spark: SparkSession, ended: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of (depth, class, conv_id): the members that end in each class."""
    run = F.floor(F.col("conv_id") / RUN)
    pieces = ended.groupBy("depth", "class", run.alias("run")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("depth", F.col("class").alias("conv_id"), "run", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("piece"))
    return pieces.repartition(n_parts(spark), "depth", "conv_id").sortWithinPartitions("depth", "conv_id", "run").mapInArrow(_streamed, "depth long, conv_id long, ends_sha256 string")


def _chains(rows: DataFrame) -> DataFrame:
    """The nodes of retired classes: the turns that their one member has left."""
    last = F.col("depth") == F.col("total")
    own = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    return rows.select("conv_id", "depth", F.when(F.col("depth") == F.col("since"), F.col("class")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, own).otherwise(F.lit(NOTHING)).alias("ends_sha256"))


def prefix_trie(spark: SparkSession, rows: DataFrame, totals: DataFrame, few: int = FEW) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    rows: (conv_id, depth, key, words, total), depths from 1 to total; totals: (conv_id, total) of all conversations.
    """
    start = totals.agg(F.min("conv_id"), F.count("*")).first()
    if start[0] is None:
        return spark.createDataFrame([], _NODE)
    key = ["class", "key"]
    state = rows.withColumn("class", F.lit(start[0]).cast("long"))
    root = spark.range(1).select(F.lit(start[0]).cast("long").alias("child"), F.lit(None).cast("long").alias("class"), F.lit(start[1]).cast("long").alias("n"), F.lit(0).cast("long").alias("words"))
    ended = [totals.where("total = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(start[0]).cast("long").alias("class"), "conv_id")]
    # of each round: its large classes, its retired ones, and the turns of both and of the small ones
    large, single, small, chains = [root], [], [], []
    depth = 1
    while True:
        left = F.col("total") - depth
        groups = state.where(F.col("depth") == depth).groupBy(*key).agg(F.min("conv_id").alias("child"), F.count("*").alias("n"), F.first("words").alias("words"), F.sum(left).alias("left"))
        kind = F.when(F.col("n") == 1, "single").when((F.col("n") <= few) & (F.col("left") <= few), "small").otherwise("large")
        groups = cut(groups.withColumn("kind", kind), spark)
        members = state.where(F.col("depth") == depth).select("conv_id", *key).join(groups.select(*key, "child", "kind"), key).select("conv_id", "child", "kind")
        tagged = cut(state.where(F.col("depth") >= depth).join(members, "conv_id").withColumn("since", F.lit(depth).cast("long")), spark)
        large.append(groups.where("kind = 'large'").select("child", "class", "n", "words"))
        single.append(groups.where("kind = 'single'").select("class"))
        small.append(tagged.where("kind = 'small'").select("class", "child", "since", "conv_id", "depth", "key", "words"))
        chains.append(_chains(tagged.where("kind = 'single'")))
        ended.append(tagged.where(f"kind = 'large' and depth = {depth} and total = {depth}").select("depth", F.col("child").alias("class"), "conv_id"))
        more = groups.where("kind = 'large' and left > 0").limit(1).count()
        if not more:
            break
        state = tagged.where(f"kind = 'large' and depth > {depth}").select("conv_id", "depth", "key", "words", "total", F.col("child").alias("class"))
        depth += 1
    both = lambda frames: reduce(DataFrame.unionByName, frames)
    subtrees = cut(both(small).groupBy("since", "child").applyInArrow(_refined, f"{_NODE}, since long"), spark)
    digests = cut(_ends(spark, both(ended)), spark)
    folded: list[DataFrame] = []
    below = None
    for d in range(depth, -1, -1):
        # what the children of this depth's classes add: chains, subtrees of small classes, classes of the round after
        add = lambda leaves, saved: [leaves.alias("n_leaves"), saved.alias("saved_tokens")]
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        parts = [single[d].select("class", *add(one, none))] if d < depth else []
        if d < depth:
            tops = subtrees.where((F.col("depth") == d + 1) & (F.col("since") == d + 1))
            parts.append(tops.select(F.col("parent_conv_id").alias("class"), *add(F.col("n_leaves"), F.col("saved_tokens"))))
        if below is not None:
            parts.append(below.select(F.col("parent_conv_id").alias("class"), "n_leaves", "saved_tokens"))
        own = large[d].select(F.col("child").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("class").alias("parent_conv_id"), F.col("n").alias("n_convs"), ((F.col("n") - 1) * F.col("words")).alias("own"))
        if parts:
            sums = both(parts).groupBy("class").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("more")).withColumnRenamed("class", "conv_id")
            own = own.join(sums, "conv_id", "left")
        else:
            own = own.select("*", *[F.lit(None).cast("long").alias(c) for c in ("n_children", "n_leaves", "more")])
        below = cut(own.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), F.coalesce("n_leaves", one).alias("n_leaves"), (F.col("own") + F.coalesce("more", none)).alias("saved_tokens")), spark)
        folded.append(below)
    classes = both(folded).join(digests, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    return both([x.select(*_NAMES) for x in (*chains, subtrees, classes)])
