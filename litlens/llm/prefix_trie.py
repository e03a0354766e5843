"""Prefix trie of conversations as a burst trie.

All conversations start in one container under the root. A container with too
many turns bursts: what its conversations share becomes a trie head, and each
next turn id behind it gets a container of its own. Containers that are small
enough are sorted and swept into nodes, each in one task; a container of one
conversation is a chain, whose turns are nodes as they are. Heads then gather
the totals of what hangs below them, from the deepest burst up.

Equal conversations are one sequence with a count from the start, so a group of
copies never fills a container. Turns and whole sequences are told apart by
128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, split_join, stored

#: Turns a container may hold; the memory of the task that sweeps it.
CONTAINER_TURNS = 4096
#: Ids that are joined into one row before their digest is made.
IDS_A_ROW = 8192

NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, end long, top long")


def _two_hashes(*cols: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)]


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """``conv, pos, t1, t2, chars``: every turn with its position from 1 and the
    128-bit id of (role, text). NULL turns come first, ties go by role, then
    text id. Positions come from range partitions, so a conversation may be of
    any length."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    t1, t2 = _two_hashes(role, text)
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), t1.alias("t1"),
        t2.alias("t2"), F.length(text).cast("long").alias("chars"))
    placed = stored(running(rows, ["conv", "turn", "role", "t1", "t2"], {"upto": F.lit(1)}, "trie-order")
                    .drop("turn", "role"), "trie-placed")
    starts = placed.groupBy("conv").agg(F.min("upto").alias("first"))
    return split_join(placed, starts, ["conv"]).select(
        "conv", (F.col("upto") - F.col("first") + 1).alias("pos"), "t1", "t2", "chars")


def with_shared_heads(turns: DataFrame, convs: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """``conv, pos, t1, t2, chars`` of rebuilt conversations: the first
    ``heads`` turns (at most ``most``) of conversation ``base``, then the own
    turns after the first ``heads``. Both are expressions over ``conv``."""
    plan = convs.select("conv", base.alias("base"), heads.alias("h"))
    based = turns.filter(F.col("pos") <= most).join(
        plan.select(F.col("base").alias("conv")).distinct(), "conv", "left_semi")
    # at most ``most`` turns a list
    lists = based.groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "chars"))).alias("list"))
    taken = stored(plan.join(lists, "base", "left").select(
        "conv", "h", F.slice(F.coalesce("list", F.array().cast("array<struct<pos:bigint,t1:bigint,t2:bigint,chars:bigint>>")),
                             F.lit(1), F.col("h")).alias("list")), "trie-heads")
    first = taken.select("conv", F.inline("list"))
    kept = taken.select("conv", "h", F.size("list").alias("k"))
    own = split_join(turns.filter(F.col("pos") > F.lit(0)), kept, ["conv"]).filter("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "t1", "t2", "chars")
    return first.select("conv", "pos", "t1", "t2", "chars").unionByName(own)


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv, rep, n, len``: equal sequences of turns are named by the smallest
    conversation; ``n`` of them are equal."""
    at = ["pos", "t1", "t2"]
    x1, x2 = _two_hashes(*[F.col(c) for c in at])
    whole = turns.groupBy("conv").agg(F.bit_xor(x1).alias("x1"), F.bit_xor(x2).alias("x2"), F.count("*").alias("len"))
    named = stored(convs.join(whole, "conv", "left").na.fill(0, ["x1", "x2", "len"]), "trie-whole")
    groups = named.groupBy("x1", "x2", "len").agg(F.min("conv").alias("rep"), F.count("*").alias("n"))
    return stored(split_join(named, groups, ["x1", "x2", "len"]).select("conv", "rep", "n", "len"), "trie-sequences")


def id_digests(members: DataFrame) -> DataFrame:
    """``rep, ends_sha256`` of the ``conv, rep`` rows: SHA-256 of the ids of a
    group, ascending and comma-joined. Range partitions join them into long rows
    first; the digest of a group is then fed row by row, whatever its size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([rep]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["rep", "first", "ids"])

        for b in batches:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (r != rep or len(ids) == IDS_A_ROW):
                    yield row()
                    ids = []
                rep = r
                ids.append(c)
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, sha, done = None, None, []
        for b in batches:
            for r, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r != rep:
                    if sha is not None:
                        done.append((rep, sha.hexdigest()))
                    rep, sha = r, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["rep", "ends_sha256"])
                done = []
        if sha is not None:
            done.append((rep, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["rep", "ends_sha256"])

    packed = members.select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions(
        "rep", "conv").mapInArrow(pack, "rep long, first long, ids string")
    return packed.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(
        digest, "rep long, ends_sha256 string")


def sweep(convs: list[tuple[bytes, int, int, list[int]]], depth: int, parent: int) -> list[list]:
    """Nodes of one container below a head of ``depth``: ``convs`` holds (bytes
    of the turn ids of the suffix, representative, count, characters of each
    turn). In sorted order each suffix shares with the one before it a path of
    open nodes; those it does not share close, and a closed node adds its totals
    to the node above."""
    out: list[list] = []
    path: list[list] = []  # open nodes: rep, n, children, leaves, saved, end, characters, rows of closed children

    def close(keep: int) -> None:
        while len(path) > keep:
            rep, n, children, leaves, saved, end, chars, below = path.pop()
            saved += (n - 1) * chars
            leaves = leaves or 1
            for child in below:
                child[2] = rep
            row = [rep, depth + len(path) + 1, parent, n, children, leaves, saved, end, int(not path)]
            out.append(row)
            if path:
                above = path[-1]
                above[0] = min(above[0], rep)
                above[1] += n
                above[2] += 1
                above[3] += leaves
                above[4] += saved
                above[7].append(row)

    last = b""
    for key, rep, n, chars in sorted(convs):
        same, most = 0, min(len(key), len(last)) // 16
        while same < most and key[16 * same:16 * same + 16] == last[16 * same:16 * same + 16]:
            same += 1
        close(same)
        path.extend([rep, 0, 0, 0, 0, None, c, []] for c in chars[same:])
        path[-1][1], path[-1][5] = n, rep
        last = key
    close(0)
    return out


def _swept(rows: DataFrame) -> DataFrame:
    """Nodes of all containers of ``rows`` (c_rep, c_depth, parent, rep, n, pos,
    t1, t2, chars); every container is whole in one task."""
    names = [c.split()[0] for c in NODES.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        container, convs, done = None, [], []

        def finish() -> None:
            if container:
                done.extend(sweep([(b"".join(k), r, n, c) for k, r, n, c in convs], *container[1:]))

        def hand_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], names)

        for b in batches:
            for c_rep, c_depth, parent, rep, n, t1, t2, chars in zip(*(c.to_pylist() for c in b.columns)):
                if (c_rep, c_depth, parent) != container:
                    finish()
                    if len(done) >= 10_000:
                        yield hand_on()
                        done = []
                    container, convs = (c_rep, c_depth, parent), []
                if not convs or convs[-1][1] != rep:
                    convs.append(([], rep, n, []))
                convs[-1][0].append(t1.to_bytes(8, "big", signed=True) + t2.to_bytes(8, "big", signed=True))
                convs[-1][3].append(chars)
        finish()
        if done:
            yield hand_on()

    return rows.repartition("c_rep", "c_depth").sortWithinPartitions("c_rep", "c_depth", "rep", "pos").select(
        "c_rep", "c_depth", "parent", "rep", "n", "t1", "t2", "chars").mapInArrow(of, NODES)


CONTAINER = ["c_rep", "c_depth"]


def _burst(rows: DataFrame, placed: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The containers ``big`` as trie heads, the nodes of their paths, and the
    sequences of the smaller containers below, one for each next turn id.

    The path of a head goes on while all members that are long enough have the
    same turn, so members that end on it need no burst of their own.
    """
    members = split_join(placed.drop("parent"), big.select(*CONTAINER), CONTAINER)
    inside = stored(split_join(rows, members, ["rep"]).filter("pos > c_depth"), "trie-burst")
    at = stored(inside.groupBy(*CONTAINER, "pos").agg(
        F.min("t1").alias("a1"), F.max("t1").alias("z1"), F.min("t2").alias("a2"), F.max("t2").alias("z2"),
        F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("chars").alias("chars"),
        F.max(F.when(F.col("len") == F.col("pos"), F.col("rep"))).alias("end")), "trie-at")
    split = at.filter("a1 < z1 or a2 < z2").groupBy(*CONTAINER).agg((F.min("pos") - 1).alias("split"))
    cut = stored(big.join(split, CONTAINER, "left").withColumn("to", F.coalesce("split", "longest")).drop("split"),
                 "trie-cut")
    path = split_join(at.drop("a1", "z1", "a2", "z2"), cut.select(*CONTAINER, "to"), CONTAINER).filter("pos <= to")
    last = path.filter("pos = to").select(*CONTAINER, F.col("conv_id").alias("at_to"))
    cut = cut.join(last, CONTAINER, "left").withColumn("low", F.coalesce("at_to", "low")).drop("at_to")
    behind = split_join(inside, cut.select(*CONTAINER, "to", "low"), CONTAINER).filter(F.col("pos") == F.col("to") + 1)
    names = behind.groupBy(*CONTAINER, "t1", "t2").agg(F.min("rep").alias("new_rep"))
    following = stored(split_join(behind, names, [*CONTAINER, "t1", "t2"]).select(
        "rep", "n", "len", F.col("new_rep").alias("c_rep"), F.col("to").alias("c_depth"), F.col("low").alias("parent")),
        "trie-next")
    children = names.groupBy(*CONTAINER).agg(F.count("*").alias("n_children"))
    heads = cut.join(children, CONTAINER, "left").na.fill(0, ["n_children"])
    return heads, path.drop("to"), following


def prefix_trie(turns: DataFrame, convs: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """The nodes of the trie of all conversations ``convs`` (``conv``, without
    repeats), whose turns are ``conv, pos, t1, t2, chars`` with positions 1, 2, ...

    A node is a distinct sequence of first turns. Returns ``conv_id`` (the
    smallest conversation that starts with it), ``depth``, ``parent_conv_id``
    (NULL at the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless
    nodes of its subtree), ``saved_tokens`` (over its subtree, a node's other
    conversations times the characters of its last turn) and ``ends_sha256``
    (of the ids that end there). A conversation without turns ends at the root;
    without conversations there is no node at all.
    """
    named = sequences(turns, convs)
    seqs = named.filter("conv = rep").select("rep", "n", "len")
    rows = stored(split_join(turns.withColumnRenamed("conv", "rep"), seqs.select("rep"), ["rep"]), "trie-rows")
    placed = seqs.select("*", F.lit(-1).cast("long").alias("c_rep"), F.lit(0).cast("long").alias("c_depth"),
                         F.lit(None).cast("long").alias("parent"))
    heads, paths, swept = [], [], []
    while True:
        level = len(swept)  # of the heads made here; what is below them is one deeper
        sizes = stored(placed.groupBy(*CONTAINER, "parent").agg(
            F.count("*").alias("seqs"), F.sum(F.col("len") - F.col("c_depth")).alias("turns"), F.sum("n").alias("convs"),
            F.min("rep").alias("low"), F.min("rep").alias("least"), F.max("len").alias("longest"),
            F.min(F.when(F.col("len") == F.col("c_depth"), F.col("rep"))).alias("end")), "trie-sizes")
        # the root is the whole table and always bursts
        big = sizes.filter((F.col("turns") > container_turns) & (F.col("seqs") > 1)) if heads else sizes
        if heads:
            chains = sizes.filter("seqs = 1")
            heads.append(chains.select("*", F.col("longest").alias("to"), F.lit(0).cast("long").alias("n_children"),
                                       F.lit(level + 1).alias("level")))
            paths.append(split_join(rows.drop("t1", "t2"), chains.select(F.col("low").alias("rep"), *CONTAINER, "convs", "longest"),
                                    ["rep"]).filter("pos > c_depth").select(
                *CONTAINER, "pos", F.col("rep").alias("conv_id"), F.col("convs").alias("n_convs"), "chars",
                F.when(F.col("pos") == F.col("longest"), F.col("rep")).alias("end")))
            small = sizes.filter((F.col("turns") <= container_turns) & (F.col("seqs") > 1)).select(*CONTAINER)
            inside = split_join(placed.drop("len"), small, CONTAINER)
            swept.append(stored(_swept(split_join(rows, inside, ["rep"]).filter("pos > c_depth")), "trie-swept"))
            level += 1
        if big.isEmpty():
            break
        head, path, placed = _burst(rows, placed, big)
        heads.append(stored(head, "trie-heads").withColumn("level", F.lit(level)))
        paths.append(path)
    if not heads:
        return _no_nodes(named)
    nodes = _gathered(heads, paths, swept)
    digests = id_digests(named.select("conv", "rep")).withColumnRenamed("rep", "end")
    named_ends = split_join(nodes.filter("end is not null"), digests, ["end"])
    return named_ends.unionByName(nodes.filter("end is null").withColumn("ends_sha256", F.lit(NO_ENDS))).drop("end")


def _no_nodes(any_table: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in NODES.split(", ")[:-2]]
    return any_table.limit(0).select(*[F.lit(None).cast("long").alias(c) for c in names],
                                     F.lit(None).cast("string").alias("ends_sha256"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _gathered(heads: list[DataFrame], paths: list[DataFrame], swept: list[DataFrame]) -> DataFrame:
    """All nodes: the swept ones, and those on the paths of heads and chains,
    whose totals are gathered from the deepest level up. What hangs below a
    container knows it by the last node of its path, (``low``, ``to``)."""
    own = (F.col("n_convs") - 1) * F.col("chars")
    on = stored(running(_union(paths), [*CONTAINER, "pos"], {"upto": own}, "trie-upto"), "trie-on")
    ends = on.groupBy(*CONTAINER).agg(F.max("upto").alias("total"), F.min(F.col("upto") - own).alias("before"))
    every = stored(split_join(_union(heads), ends, CONTAINER, "left"), "trie-totals")
    done, tops = [], None
    for level in range(len(swept), -1, -1):
        here = every.filter(F.col("level") == level)
        if tops is None:
            here = here.select("*", *[F.lit(None).cast("long").alias(c) for c in ("leaves", "below")])
        else:
            below = tops.groupBy("low", "to").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"))
            here = split_join(here, below, ["low", "to"], "left")
        here = here.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves"))).withColumn(
            "below", F.coalesce("below", F.lit(0)))
        here = stored(here.withColumn("saved", F.col("below") + F.coalesce(F.col("total") - F.col("before"), F.lit(0))),
                      "trie-level")
        done.append(here)
        tops = here.select(F.col("parent").alias("low"), F.col("c_depth").alias("to"), "leaves", "saved")
        if level:
            tops = tops.unionByName(swept[level - 1].filter("top = 1").select(
                F.col("parent_conv_id").alias("low"), (F.col("depth") - 1).alias("to"), F.col("n_leaves").alias("leaves"),
                F.col("saved_tokens").alias("saved")))
    one, at_root = F.lit(1).cast("long"), F.col("to") == 0
    first = F.col("pos") == F.col("c_depth") + 1
    before = on.select(*CONTAINER, (F.col("pos") + 1).alias("pos"), F.col("conv_id").alias("above"))
    totals = _union(done).select(*CONTAINER, "parent", "least", "to", "n_children", "leaves", "below", "total")
    out = split_join(split_join(on, before, [*CONTAINER, "pos"], "left"), totals, CONTAINER).select(
        "conv_id", F.col("pos").alias("depth"),
        F.when(first, F.coalesce("parent", "least")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("pos") == F.col("to"), F.col("n_children")).otherwise(one).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("below") + F.col("total") - F.col("upto") + own).alias("saved_tokens"),
        "end")
    return _union([out, *[s.drop("top") for s in swept], done[-1].select(
        F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.col("convs").alias("n_convs"), F.when(at_root, F.col("n_children")).otherwise(one).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "end")])


def conversation_trie(conversations: DataFrame, base: Column, heads: Column, most: int,
                      container_turns: int = CONTAINER_TURNS, id_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of rebuilt conversations: see :func:`with_shared_heads` for
    ``base``, ``heads`` and ``most``, :func:`prefix_trie` for the columns.

    Turns stand in the order of ``turn``, NULL first, ties by role and text id;
    repeated rows are turns of their own. NULL roles and texts are empty. Rows
    without a conversation id belong to none and are left out. An empty table
    gives an empty result; other columns are ignored.
    """
    turns = stored(ordered_turns(conversations, id_col, turn_col, role_col, text_col), "trie-turns")
    convs = stored(turns.select("conv").distinct(), "trie-convs")
    return prefix_trie(stored(with_shared_heads(turns, convs, base, heads, most), "trie-rebuilt"), convs, container_turns)
