"""Prefix trie of conversations by collapsing whole sequences.

A node is a distinct sequence of first turns, from the root without turns.  No tree is
walked; every figure of a node is a sum over the sequences that start with it.

1. Turns are numbered by a range sort over (conversation, turn, role, text), and from then
   on a turn is 128 bits for its role and text and the bytes of its text.  A prefix is the
   exclusive or of its turns' bits salted by position, a running value.  Running values are
   made within each sorted part and completed by those of the parts before, so one
   conversation of many turns is worked on by many tasks.
2. Identical whole conversations become one sequence with a weight, its smallest
   conversation and its end list.  Only sequences go on.
3. Sequences that are proper prefixes of others go by anti-join; the rest are the leaves.
4. Each node's smallest conversation names the one sequence that owns the node.  Down a
   sequence members only get fewer, so it owns exactly its nodes from some depth on.  Sums
   over a subtree's nodes, each once, are then sums over sequences: those of each sequence's
   own part below the node.  So nodes, members, children, leaves and saved tokens come from
   one aggregate, which Spark starts before the shuffle.

saved_tokens: what a cache of shared prefixes saves, (members - 1) times the bytes of the
node's last text, over the subtree.

Turns are sorted by turn (null first), then role, then text; repeated rows are turns of their
own.  A null role or text is empty.  A null conversation id names no conversation: its rows
take no part.  Texts may be very long; they go through one shuffle.  An empty table gives no
rows.  Extra columns are ignored, whatever their names.  Turns and prefixes are told by
128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coloom.llm.common import table
from coloom.session import cut

#: Ends of one node that are written as one text.
TOGETHER = 4096
NODE = ["d", "x1", "x2"]


def ordered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, pos, t1, t2, size): the turns of each conversation, numbered from 1.

    A conversation's turns are in the order of ``part``, then ``pos``.
    """
    empty = F.lit("")
    named = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), empty).alias("role"),
        F.coalesce(F.col(text), empty).alias("text"),
        # Rows that are alike can be dealt apart.
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv", "turn", "role", "text", "row"]
    placed = cut(
        named.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "conv",
            F.monotonically_increasing_id().alias("row"),
            F.xxhash64("role", "text").alias("t1"),
            F.xxhash64(F.lit(1), "role", "text").alias("t2"),
            F.octet_length("text").cast("long").alias("size"),
        )
    ).withColumn("part", F.shiftright("row", 33).cast("int"))
    before = _before(placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")), {"before": F.sum("n")})
    within = Window.partitionBy("conv", "part").orderBy("row")
    return (
        placed.withColumn("at", F.row_number().over(within))
        .join(before, ["conv", "part"])
        .select("conv", "part", (F.col("at") + F.col("before")).alias("pos"), "t1", "t2", "size")
    )


def _before(totals: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(conv, part) with each of ``sums`` over the parts before."""
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("conv", "part", *[F.coalesce(s.over(earlier), F.lit(0)).alias(c) for c, s in sums.items()])


def _running(turns: DataFrame) -> DataFrame:
    """(conv, d, x1, x2, size, upto): the prefix of each turn, and the bytes up to it."""
    salted = turns.select(
        "conv", "part", F.col("pos").alias("d"), "size", *[F.xxhash64("pos", "t1", "t2", *s).alias(c) for c, s in (("h1", []), ("h2", [F.lit(1)]))]
    )
    totals = salted.groupBy("conv", "part").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.sum("size").alias("size"))
    before = _before(totals, {"b1": F.bit_xor("h1"), "b2": F.bit_xor("h2"), "b": F.sum("size")})
    upto = Window.partitionBy("conv", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    local = {"x1": F.bit_xor("h1").over(upto), "x2": F.bit_xor("h2").over(upto), "upto": F.sum("size").over(upto)}
    return (
        salted.withColumns(local)
        .join(before, ["conv", "part"])
        .select("conv", "d", F.expr("x1 ^ b1").alias("x1"), F.expr("x2 ^ b2").alias("x2"), "size", (F.col("upto") + F.col("b")).alias("upto"))
    )


def trie(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and their ends, for ``convs(conv)``, each once, and the ``turns`` that they have.

    Nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens);
    a node is known by its smallest conversation and its depth.  Ends: (conv_id, depth, end),
    one row for each conversation, at the node that is all of it.
    """
    run = cut(_running(turns))
    zero = F.lit(0).cast("long")
    last = run.groupBy("conv").agg(F.max(F.struct("d", "x1", "x2", "upto")).alias("last"))
    none = F.struct(zero.cast(run.schema["d"].dataType).alias("d"), zero.alias("x1"), zero.alias("x2"), zero.alias("upto"))
    whole = cut(convs.join(last, "conv", "left").select("conv", F.coalesce("last", none).alias("last")).select("conv", "last.*"))

    seqs = whole.groupBy(*NODE).agg(F.min("conv").alias("s"), F.count(F.lit(1)).alias("w"), F.first("upto").alias("total"))
    roots = seqs.select("s", zero.cast(run.schema["d"].dataType).alias("d"), zero.alias("x1"), zero.alias("x2"), zero.alias("size"), zero.alias("upto"))
    kept = seqs.select(F.col("s").alias("conv"))
    paths = cut(run.join(kept, "conv", "left_semi").withColumnRenamed("conv", "s").unionByName(roots))
    seqs = cut(seqs)

    nodes = paths.groupBy(*NODE).agg(F.min("s").alias("node"), F.count(F.lit(1)).alias("through"))
    inner = paths.join(seqs.select("s", F.col("d").alias("len")), "s").where("d < len").select(*NODE).distinct()
    leaves = seqs.join(inner, NODE, "left_anti").select("s", F.lit(1).alias("leaf"))

    # From which depth on a sequence owns its nodes, what lies before, and the node above the first of them.
    named = cut(paths.join(nodes.select(*NODE, "node"), NODE))
    owned = F.col("node") == F.col("s")
    since = named.groupBy("s").agg(
        F.min(F.when(owned, F.col("d"))).alias("since"),
        F.min(F.when(owned, F.col("upto") - F.col("size"))).alias("above"),
        F.max(F.when(~owned, F.col("node"))).alias("parent"),
    )
    facts = seqs.select("s", "w", F.col("d").alias("len"), "total").join(leaves, "s", "left").join(since, "s")
    rows = named.join(facts, "s")
    before = F.col("upto") - F.col("size")
    rest = F.col("total") - before
    own = F.when(F.col("since").isNotNull(), F.col("total") - F.greatest(before, F.col("above"))).otherwise(zero)
    child = F.coalesce((F.col("d") < F.col("len")) & (F.col("since") <= F.col("d") + 1), F.lit(False))
    up = F.when(F.col("d") == F.col("since"), F.col("parent")).when(F.col("d") > F.col("since"), F.col("s"))
    out = rows.groupBy(*NODE).agg(
        F.min("s").alias("conv_id"),
        F.max(up).alias("parent_conv_id"),
        F.sum("w").alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"),
        (F.sum(F.col("w") * rest) - F.sum(own)).alias("saved_tokens"),
    )
    nodes_out = out.select("conv_id", F.col("d").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    # The node that a sequence ends at has its smallest member from the sequences through it.
    at = named.join(seqs.select("s", F.col("d").alias("len")), "s").where("d = len").select(*NODE, F.col("node").alias("conv_id"))
    ends = whole.join(at, NODE).select("conv_id", F.col("d").cast("long").alias("depth"), F.col("conv").alias("end"))
    return nodes_out, ends


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): of the ends in ascending order, comma-joined.

    Ends are sorted and joined in runs of at most ``TOGETHER``; the runs of a node pass
    through its digest one after the other, so a node may have any number of ends.
    """
    order = ["conv_id", "depth", "end"]
    placed = cut(ends.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("row")))
    chunk = F.expr(f"row div {TOGETHER}").alias("chunk")
    joined = F.array_join(F.array_sort(F.collect_list("end")), ",")
    runs = placed.groupBy("conv_id", "depth", chunk).agg(joined.alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": at[0], "depth": at[1], "ends_sha256": sha.hexdigest()}])

        for batch in batches:
            out = []
            for conv, depth, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "text"))):
                if (conv, depth) == at:
                    sha.update(b",")
                else:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = (conv, depth), hashlib.sha256()
                sha.update(text.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())],
                ["conv_id", "depth", "ends_sha256"],
            )
        if at is not None:
            yield done()

    dealt = runs.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk")
    return dealt.mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """The conversations, and their turns after each took over the head of its group's first.

    Conversation c starts with the first h turns of c - c % group, then has its own turns
    after its first h; h is crc32 of c in decimal, modulo ``most`` + 1.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    base = F.expr(f"conv - conv % {group}")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("int")
    lent = sizes.select(F.col("conv").alias("base"), F.least("n", F.lit(most)).alias("lent"))
    plan = sizes.select("conv", base.alias("base"), h.alias("h")).join(lent, "base", "left")
    plan = cut(plan.select("conv", "base", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("taken")))
    heads = turns.where(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "t1", "t2", "size")
    head = plan.where("taken > 0").join(heads, "base").where("pos <= h").select("conv", F.lit(-1).alias("part"), "pos", "t1", "t2", "size")
    own = turns.join(plan.select("conv", "h", "taken"), "conv").where("pos > h")
    own = own.select("conv", "part", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "size")
    return plan.select("conv"), head.unionByName(own)


def op12_conversation_prefixes(spark, sf_dir: str) -> DataFrame:
    turns = cut(ordered(table(spark, sf_dir, "conversations")))
    nodes, ends = trie(*rebuilt(turns))
    return nodes.join(end_digests(ends), ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


#: CRC-32 bit by bit: a number stands for a byte, -1 for a shift.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
          lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""

OP12_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT h.conv_id, 0 AS own, pos, role, text FROM h JOIN t ON t.conv_id = h.base AND pos <= h
      UNION ALL SELECT h.conv_id, 1, pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND pos > h),
s AS (SELECT h.conv_id, coalesce(list([role, text] ORDER BY own, pos) FILTER (role IS NOT NULL), []) AS seq
      FROM h LEFT JOIN r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
n AS (SELECT seq[1:d] AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = d), '') AS ends
      FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM s) GROUP BY ALL),
k AS (SELECT n.*, (SELECT count(*) FROM n c WHERE c.d = n.d + 1 AND c.node[1:n.d] = n.node) AS n_children FROM n)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children,
       (SELECT count(*) FROM k u WHERE u.d >= k.d AND u.node[1:k.d] = k.node AND u.n_children = 0) AS n_leaves,
       (SELECT CAST(coalesce(sum(CASE WHEN u.d = 0 THEN 0 ELSE (u.n_convs - 1) * strlen(u.node[u.d][2]) END), 0) AS BIGINT)
        FROM k u WHERE u.d >= k.d AND u.node[1:k.d] = k.node) AS saved_tokens,
       sha256(k.ends) AS ends_sha256
FROM k LEFT JOIN k p ON k.d > 0 AND p.d = k.d - 1 AND p.node = k.node[1:k.d - 1]
"""
