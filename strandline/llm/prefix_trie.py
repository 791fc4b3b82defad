"""Prefix trie of conversations by ROLLUP over positional turn columns.

A conversation is cut into blocks of BLOCK turns, one column each. A turn's
column holds two 64-bit hashes of its place and content (128 bits) and its
words. The XOR of the hashes of a prefix names the trie's node, so a block is
keyed by the node where the block before it ended, and all blocks of all
conversations are rolled up together: one ROLLUP gives every prefix, its level
in the block read off `grouping_id`. No round per block is needed.

Subtree sums need no walk either. The smallest conversation of a node owns it;
a conversation owns its path from some depth on, and the nodes below a node are
those that its members own there. A second ROLLUP sums what members own.

A hot first turn or a copied conversation is a partial aggregate in every task;
a long conversation is ranked and prefixed in slices. The ids that end at a node
are joined in slices of 4096 ids and hashed in one stream per node, which holds
one slice at a time.

Defined results: rows with NULL conv_id belong to no conversation. NULL role
or text is empty. NULL turns come first; rows of one turn are ordered by a digest
of role and text; repeated rows are turns of their own. An empty table has no
node. Columns beside conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scale import rank_in_group
from .rows import written

BLOCK = 8
# Turn numbers in a slice when turns are ranked; blocks in a slice when prefixes run along a conversation.
RANK_SLICE = 1024
BLOCK_SLICE = 1024
ID_BITS = 12
FAMILY = 20
MAX_SHARED = 4
_FIRST = -(1 << 63)
_WORD = r"[^\x20\x09-\x0D]+"


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """`conv_id`, `r` (from 1), `digest` of role and text, `words`: one row per turn, without texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)).alias("turn"),
        F.unhex(F.md5(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "utf-8"))).alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
    return rank_in_group(rows, ["conv_id"], "turn", "r", ties=("digest",), width=RANK_SLICE).select("conv_id", "r", "digest", "words")


def shared_heads(turns: DataFrame) -> DataFrame:
    """`conv_id`, `pos` (from 1), `digest`, `words`: each conversation rebuilt over the head of its family's first one.

    The first h turns (h by the id's checksum) come from the conversation whose
    id is the next lower multiple of FAMILY. A conversation without turns keeps
    one row with pos 0.
    """
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MAX_SHARED
    ids = turns.select("conv_id").distinct().withColumn("h", shared).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = (turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("r") < MAX_SHARED)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("r", "digest", "words"))).alias("head")))
    joined = ids.join(heads, "base", "left").select(
        "conv_id", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<r:int,digest:binary,words:bigint>>")), 1, F.col("h").cast("int")).alias("head"))
    first = joined.select("conv_id", F.inline("head")).select("conv_id", F.col("r").alias("pos"), "digest", "words")
    # Where the family's first conversation is absent or short, later turns move up.
    moved = joined.where(F.size("head") < F.col("h")).select("conv_id", (F.col("h") - F.size("head")).alias("up"))
    own = (turns.withColumn("h", shared).where("r > h").join(moved, "conv_id", "left")
           .select("conv_id", (F.col("r") - F.coalesce("up", F.lit(0))).alias("pos"), "digest", "words"))
    bare = ids.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("words"))
    return first.union(own).union(bare)


def turn_blocks(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: `block`, `t1`..`tBLOCK`, and the node (`ka`, `kb`) and words (`before`) of the prefix before it."""
    at = F.greatest(F.col("pos") - 1, F.lit(0))
    slot = F.when(F.col("pos") > 0, at % BLOCK)
    hashed = turns.select("conv_id", F.floor(at / BLOCK).alias("block"), slot.alias("slot"), "words",
                          F.xxhash64("pos", "digest").alias("a"), F.xxhash64(F.lit("second"), "pos", "digest").alias("b"))
    columns = [F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{c}{i + 1}") for i in range(BLOCK) for c in ("a", "b", "words")]
    one = lambda c: F.bit_xor(F.when(F.col("slot").isNotNull(), F.col(c)))
    rows = hashed.groupBy("conv_id", "block").agg(*columns, F.coalesce(one("a"), F.lit(0)).alias("xa"), F.coalesce(one("b"), F.lit(0)).alias("xb"),
                                                  F.sum("words").alias("xw"), F.count("slot").alias("n"))
    turn = [F.when(F.col(f"a{i}").isNotNull(), F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"words{i}").alias("w"))).alias(f"t{i}")
            for i in range(1, BLOCK + 1)]
    rows = rows.select("conv_id", "block", *turn, "xa", "xb", "xw", "n", F.floor(F.col("block") / BLOCK_SLICE).alias("part"))
    # Exclusive prefixes inside slices, shifted by the slices before: most conversations have one slice and need no shift.
    inside = W.partitionBy("conv_id", "part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "part").agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"), F.sum("xw").alias("xw"))
    shift = totals.select("conv_id", "part", F.bit_xor("xa").over(earlier).alias("sa"), F.bit_xor("xb").over(earlier).alias("sb"),
                          F.sum("xw").over(earlier).alias("sw")).where("part > 0")
    zero = F.lit(0)
    rows = (rows.withColumns({"pa": F.bit_xor("xa").over(inside), "pb": F.bit_xor("xb").over(inside), "pw": F.sum("xw").over(inside)})
            .join(shift, ["conv_id", "part"], "left"))
    return rows.select("conv_id", "block", *[f"t{i}" for i in range(1, BLOCK + 1)], "xa", "xb", "xw", "n",
                       F.coalesce("pa", zero).bitwiseXOR(F.coalesce("sa", zero)).alias("ka"),
                       F.coalesce("pb", zero).bitwiseXOR(F.coalesce("sb", zero)).alias("kb"),
                       (F.coalesce("pw", zero) + F.coalesce("sw", zero)).alias("before"))


def rollup(blocks: DataFrame, measures: str) -> DataFrame:
    """One row per node: `depth`, `na`, `nb`, its parent's `ma`, `mb`, words of the path before its last turn `p` and of that turn `w`, and the measures."""
    turns = [f"t{i}" for i in range(1, BLOCK + 1)]
    spark = blocks.sparkSession
    grouped = spark.sql(f"select block, ka, kb, before, {BLOCK} - bit_count(grouping_id()) as level, array({', '.join(turns)}) as path, {measures} "
                        f"from {{blocks}} group by block, ka, kb, before, rollup({', '.join(turns)})", blocks=blocks)
    # Groups that end in an absent turn are no prefixes; a block's own level 0 is the last node of the block before.
    nodes = grouped.where("if(level = 0, block = 0, path[level - 1] is not null)")
    fold = lambda n, start, f: F.aggregate(F.slice("path", 1, n), start, f)
    xor = lambda c, n: fold(n, F.col(f"k{c}"), lambda x, t: x.bitwiseXOR(t[c]))
    level, up = F.col("level"), F.greatest(F.col("level") - 1, F.lit(0))
    kept = [c for c in nodes.columns if c not in ("block", "ka", "kb", "before", "level", "path")]
    return nodes.select((F.col("block") * BLOCK + level).alias("depth"), "level", xor("a", level).alias("na"), xor("b", level).alias("nb"),
                        xor("a", up).alias("ma"), xor("b", up).alias("mb"), fold(up, F.col("before"), lambda x, t: x + t["w"]).alias("p"), *kept)


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's id lists, which arrive in order; one list is held at a time."""
    at, state = None, None

    def row():
        return pa.RecordBatch.from_pydict({"na": [at[0]], "nb": [at[1]], "ends_sha256": [state.hexdigest()]})

    for batch in batches:
        done = {"na": [], "nb": [], "ends_sha256": []}
        for na, nb, ids in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("ids")):
            if at != (na, nb):
                if at is not None:
                    for name, v in zip(done, (*at, state.hexdigest())):
                        done[name].append(v)
                at, state = (na, nb), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
        if done["na"]:
            yield pa.RecordBatch.from_pydict(done)
    if at is not None:
        yield row()


def end_hashes(convs: DataFrame) -> DataFrame:
    """`na`, `nb`, `ends_sha256`: hash of the ids, in numeric order, of the conversations that end at each node."""
    part = F.shiftright("conv_id", ID_BITS)
    lists = convs.groupBy(F.col("xa").alias("na"), F.col("xb").alias("nb"), part.alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = lists.repartition("na", "nb").sortWithinPartitions("na", "nb", "part").select("na", "nb", "ids")
    return ordered.mapInArrow(_hash_ids, "na long, nb long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie over `conv_id`, `pos`, `digest`, `words`; columns of the contract, with the node's name (`na`, `nb`)."""
    made = turn_blocks(turns)
    totals = made.groupBy("conv_id").agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"), F.sum("xw").alias("total"), F.sum("n").alias("n_turns"))
    made = made.drop("xa", "xb", "xw", "n").join(totals, "conv_id")
    blocks = written(made, "trie-blocks")
    whole = blocks.where("block = 0")
    first = written(rollup(blocks, "min(conv_id) as rep, max(n_turns) as longest"), "trie-nodes")
    # From which depth on a conversation owns its path, what its path holds before, whether it ends in a leaf, and the owner of the node above.
    owners = first.groupBy("rep").agg(F.min("depth").alias("from"), F.min("p").alias("p0"), F.max(F.col("longest") == F.col("depth")).alias("leaf"))
    tops = first.select("rep", F.col("depth").alias("from"), "ma", "mb").join(owners, ["rep", "from"])
    above = tops.where(F.col("from") > 0).join(first.select(F.col("na").alias("ma"), F.col("nb").alias("mb"), F.col("rep").alias("above")), ["ma", "mb"])
    owned = owners.join(above.select("rep", "above"), "rep", "left").withColumnRenamed("rep", "conv_id")
    members = blocks.join(owned, "conv_id", "left").withColumns({
        "own": F.coalesce(F.col("total") - F.col("p0"), F.lit(0)), "leaf": F.coalesce(F.col("leaf"), F.lit(False)).cast("long"),
        "start": F.col("from") - F.col("block") * BLOCK})
    branches = ", ".join(f"count_if(start = {i + 1})" for i in range(BLOCK + 1))
    nodes = rollup(members, f"count(*) as n_convs, min(struct(conv_id, total, own, n_turns, from, above)) as rep, sum(total) as totals, sum(own) as owns, "
                            f"sum(leaf) as n_leaves, array({branches}) as branches")
    d = F.col("depth")
    # Words below a node, once per member, less once per node.
    each = F.col("totals") - F.col("n_convs") * F.col("p")
    once = F.col("owns") - F.col("rep.own") + F.col("rep.total") - F.col("p")
    nothing = F.lit(hashlib.sha256().hexdigest())
    result = nodes.select(
        "na", "nb", F.col("rep.conv_id").alias("conv_id"), d.alias("depth"),
        F.when(d == 0, F.lit(None)).when(F.col("rep.from") < d, F.col("rep.conv_id")).otherwise(F.col("rep.above")).alias("parent_conv_id"), "n_convs",
        (F.col("branches")[F.col("level")] + (F.col("rep.n_turns") > d).cast("long")).alias("n_children"), "n_leaves", (each - once).alias("saved_tokens"))
    return (result.join(end_hashes(whole.select("conv_id", "xa", "xb")), ["na", "nb"], "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns = turns_in_order(conversations)
    bare = turns.select("conv_id").distinct().select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("words"))
    return trie(turns.withColumnRenamed("r", "pos").union(bare))


def family_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt over their families' heads."""
    return trie(shared_heads(turns_in_order(conversations)))


def _sql_crc(value: str) -> str:
    """CRC-32 of a text's bytes (ASCII), bit by bit."""
    bits = "list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({value}, ''), lambda c: ascii(c)::bigint)), "
            f"lambda acc, b: {bits}), 4294967295)")


ORACLE = rf"""
with turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as r,
               {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as t from conversations where conv_id is not null),
lists as (select conv_id, list(t order by r) as ts from turns group by conv_id),
heads as (select conv_id, ts, conv_id - conv_id % {FAMILY} as base, {_sql_crc('conv_id::varchar')} % {MAX_SHARED} as h from lists),
rebuilt as (select a.conv_id, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) as ts from heads a left join lists b on b.conv_id = a.base),
members as (select conv_id, ts, d, ts[:d] as path from (select *, unnest(range(0, len(ts) + 1)) as d from rebuilt)),
nodes as (select path, d as depth, min(conv_id) as conv_id, count(*) as n_convs, max(len(ts)) = d as leaf,
          coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(ts) = d), '') as ends,
          case when d = 0 then 0 else len(regexp_extract_all(any_value(ts[d].text), '[^\x20\x09-\x0D]+')) end as words from members group by path, d),
below as (select path[:k] as path, count(*) filter (leaf) as n_leaves, sum((n_convs - 1) * words) as saved_tokens
          from (select *, unnest(range(0, depth + 1)) as k from nodes) group by 1),
children as (select path[:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by 1)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, b.n_leaves, b.saved_tokens::bigint as saved_tokens,
       sha256(n.ends) as ends_sha256
from nodes n join below b on b.path = n.path left join children c on c.path = n.path left join nodes p on n.depth > 0 and p.path = n.path[:n.depth - 1]"""
