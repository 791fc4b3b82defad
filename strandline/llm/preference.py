"""Preference formatting: pairs of conversations as one prompt and two masked completions. DataFrame functions only.

The turns that chosen and rejected have in common, from the first on, are
rendered once as the prompt. What follows on either side is rendered as its
completion; its mask lists the character spans of assistant texts, which a
training loss may see. A pair without a difference is kept and marked as not
usable.

Defined results: exact repeats of a turn's row count once; turns are ordered
by number, then role and text. NULL text is empty, NULL role is "unknown".
Rows with NULL conv_id belong to no conversation. Pairs that name an unknown
conversation give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ASSISTANT = "assistant"
_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """`conv_id` and `turns` (turn, role, text) in order."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).cast(_TURNS).alias("turns"))


def first_turn_pairs(convs: DataFrame) -> DataFrame:
    """`chosen_id`, `rejected_id`: among conversations that open alike, the one with most turns (then the least id) is chosen over each other one."""
    opened = convs.select("conv_id", F.col("turns")[0]["role"].alias("role"), F.col("turns")[0]["text"].alias("text"), F.size("turns").alias("n"))
    best = (opened.groupBy("role", "text").agg(F.max(F.struct("n", (-F.col("conv_id")).alias("minus"))).alias("best"), F.count(F.lit(1)).alias("c"))
            .where("c > 1").select("role", "text", (-F.col("best.minus")).alias("chosen_id")))
    return (opened.join(best, ["role", "text"]).where(F.col("conv_id") != F.col("chosen_id"))
            .select("chosen_id", F.col("conv_id").alias("rejected_id")))


def neighbour_pairs(convs: DataFrame) -> DataFrame:
    """`chosen_id`, `rejected_id`: every conversation with an even id over the next id, if both are there."""
    ids = convs.select("conv_id")
    return (ids.where("conv_id % 2 = 0").select(F.col("conv_id").alias("chosen_id"), (F.col("conv_id") + 1).alias("rejected_id"))
            .join(ids.select(F.col("conv_id").alias("rejected_id")), "rejected_id", "left_semi").select("chosen_id", "rejected_id"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("\n<|end|>\n"))), "")


def mask(turns: Column) -> Column:
    """(start, end) of each assistant text in the rendered turns, in characters."""
    tail = F.length(F.lit("\n<|end|>\n"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        begin = done["at"] + F.length(_head(t))
        end = begin + F.length(t["text"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct((end + tail).alias("at"), F.when(t["role"] == ASSISTANT, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda done: done["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")


def preference_format(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row per pair: `chosen_id`, `rejected_id`, `n_prompt_turns`, `prompt`, `chosen`, `rejected`, `chosen_mask`, `rejected_mask`, `usable`.

    `pairs` has `chosen_id` and `rejected_id`; without it, conversations that open alike are paired.
    """
    convs = conversations(turns)
    pairs = first_turn_pairs(convs) if pairs is None else pairs.select(F.col("chosen_id").cast("long").alias("chosen_id"), F.col("rejected_id").cast("long").alias("rejected_id"))
    both = (pairs.join(convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id")
            .join(convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id"))
    both = both.withColumn("n", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    cut = both.select("chosen_id", "rejected_id", F.col("n").alias("n_prompt_turns"), F.slice("a", 1, F.col("n")).alias("p"),
                      rest("a").alias("a"), rest("b").alias("b"))
    return cut.select("chosen_id", "rejected_id", "n_prompt_turns", rendered(F.col("p")).alias("prompt"), rendered(F.col("a")).alias("chosen"),
                      rendered(F.col("b")).alias("rejected"), mask(F.col("a")).alias("chosen_mask"), mask(F.col("b")).alias("rejected_mask"),
                      ((F.size("a") > 0) | (F.size("b") > 0)).alias("usable"))


def _sql_rendered(turns: str) -> str:
    return f"coalesce(list_aggregate(list_transform({turns}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10)), 'string_agg', ''), '')"


def _sql_mask(turns: str) -> str:
    size = "length(t.role) + length(t.text) + 14"
    begin = f"coalesce(list_sum(list_transform({turns}[:i - 1], lambda t: {size})), 0)::int + length({turns}[i].role) + 5"
    return (f"list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = '{ASSISTANT}'), "
            f"lambda i: ({begin}) || '-' || ({begin} + length({turns}[i].text)))")


ORACLE = f"""
with turns as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null),
convs as (select conv_id, list({{'role': role, 'text': text}} order by turn, role, text) as turns from turns group by conv_id),
opened as (select conv_id, turns, turns[1] as head, len(turns) as n from convs),
best as (select head, arg_max(conv_id, (n, -conv_id)) as chosen_id from opened group by head having count(*) > 1),
named as (select b.chosen_id, o.conv_id as rejected_id from opened o join best b on o.head = b.head where o.conv_id <> b.chosen_id
          union select a.conv_id, b.conv_id from convs a join convs b on b.conv_id = a.conv_id + 1 where a.conv_id % 2 = 0),
pairs as (select chosen_id, rejected_id, a.turns as a, b.turns as b
          from named join convs a on a.conv_id = chosen_id join convs b on b.conv_id = rejected_id),
cut as (select *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is distinct from b[i])) - 1, len(a)) as n from pairs),
parts as (select chosen_id, rejected_id, n, a[:n] as p, a[n + 1:] as x, b[n + 1:] as y from cut)
select chosen_id, rejected_id, n::int as n_prompt_turns, {_sql_rendered('p')} as prompt, {_sql_rendered('x')} as chosen, {_sql_rendered('y')} as rejected,
       array_to_string({_sql_mask('x')}, ' ') as chosen_mask, array_to_string({_sql_mask('y')}, ' ') as rejected_mask, len(x) > 0 or len(y) > 0 as usable
from parts"""
