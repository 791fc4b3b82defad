"""Domain tables derived from the test tables, as SQL for Spark and for DuckDB.

`<t>` marks a table reference: `{t}` for Spark, the bare name (base table) or
`$t` (another view) for DuckDB. A pair gives different text per engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()

_ACGT = ("'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', "
         "'acgtacgtacgtacgtacgtacgtacacgtacgtacgtacgtacgtacgtac'")

_TEXT: dict[str, str | tuple[str, str]] = {
    "calls": """
select concat('S', cast(l_suppkey % 4 as varchar(4))) as sample,
       concat('chr', cast(1 + l_partkey % 22 as varchar(4))) as chr,
       1 + (l_orderkey * 7 + l_linenumber) % 5000 as pos,
       substr('ACGT', cast(1 + l_partkey % 4 as int), 1) as ref,
       substr('ACGTRYKMSWNX', cast(1 + (l_orderkey + l_linenumber + cast(floor(l_suppkey / 4) as bigint)) % 12 as int), 1) as call,
       cast(l_quantity as bigint) as qual,
       (l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 101 + l_suppkey) % 1000000 as ord
from <lineitem>""",
    "regions": """
select concat('chr', cast(1 + p_partkey % 22 as varchar(4))) as chr,
       1 + (p_partkey * 37) % 49000 as start_pos,
       (p_partkey * 37) % 49000 + 10 * p_size as end_pos,
       p_name as name, p_partkey as region_id,
       case when p_size % 2 = 0 then '+' else '-' end as strand from <part>""",
    "alignments": """
select (l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 101 + l_suppkey) % 1000000 as read_id,
       concat('chr', cast(1 + l_partkey % 22 as varchar(4))) as chr,
       1 + (l_orderkey * 7 + l_suppkey) % 50000 as start_pos,
       (l_orderkey * 7 + l_suppkey) % 50000 + 36 as end_pos,
       case when l_linenumber % 2 = 0 then '+' else '-' end as strand,
       cast(l_quantity as bigint) as mapq,
       case when l_returnflag = 'R' then 0 else 18 end as flag,
       l_suppkey % 2 as is_tumor,
       concat(substr('ACGT', cast(1 + l_partkey % 4 as int), 1),
              repeat(substr('GTAC', cast(1 + l_orderkey % 4 as int), 1), 15),
              repeat(substr('CATG', cast(1 + l_suppkey % 4 as int), 1), 20)) as bases,
       repeat(substr('IH5+', cast(1 + l_linenumber % 4 as int), 1), 36) as quals
from <lineitem>""",
    "stats_lines": """
select concat(event_type, '=', cast(cast(floor(value) as bigint) as varchar(20))) as line,
       event_id as ord from <events> where value is not null""",
    "jobs": """
select o_orderkey as id, concat('fn', cast(o_custkey % 12 as varchar(4))) as func,
       o_custkey % 5 as revision,
       md5(cast(cast(floor(o_orderkey / 2) as bigint) as varchar(20))) as inputkey,
       md5(cast(o_orderkey as varchar(20))) as outputkey,
       concat('K=', cast(o_custkey % 3 as varchar(4))) as knobs,
       1 + o_custkey % 8 as nodes, o_orderdate as starttime,
       60 + (o_orderkey * 131) % 20000 as elapsed_s,
       case when o_orderstatus = 'F' then 1 when o_orderstatus = 'O' then 0 end as success from <orders>""",
    "replicas": """
select md5(cast(l_partkey as varchar(20))) as block,
       concat('node', cast(l_suppkey % 8 as varchar(4))) as node,
       1 + l_partkey % 5 as want, 1000 + l_partkey as size from <lineitem>""",
    "pixels": """
select l_orderkey % 50 as frame, l_partkey % 40 as object, l_linenumber as cycle,
       l_suppkey % 4 as channel, cast(l_quantity as bigint) * 10 as value from <lineitem>""",
    "seqs": (
        # Letters are made here, once per text: a filter on them would be pushed below with the expression copied in, per use.
        f"select doc_id, source, inline(array(struct(regexp_replace(translate(text, {_ACGT}), '[^acgt]', '') as seq))) from <documents>",
        f"select doc_id, source, regexp_replace(translate(text, {_ACGT}), '[^acgt]', '', 'g') as seq from <documents>"),
    "refs": (
        f"select concat('r', cast(item_id as varchar(20))) as ref, item_id, "
        f"regexp_replace(translate(text, {_ACGT}), '[^acgt]', '') as seq from <benchmark>",
        f"select concat('r', cast(item_id as varchar(20))) as ref, item_id, "
        f"regexp_replace(translate(text, {_ACGT}), '[^acgt]', '', 'g') as seq from <benchmark>"),
    # Whole sequences tiled into reads of up to 36 bases.
    "reads": (
        # Cut by one pass over the text: slicing it at each offset would scan it from its start every time.
        """select doc_id * 1000000 + i as read_id, concat(cast(doc_id as string), '.', cast(i as string)) as name,
                  source as file, doc_id % 3 as grp, bases, translate(bases, 'acgt', 'IH5+') as quals,
                  case when i % 3 = 1 then 16 else 0 end as flag, concat('rg', cast(doc_id % 4 as string)) as rg
           from (select doc_id, source, cast(i as bigint) as i, bases
                 from (select doc_id, source, posexplode(regexp_extract_all(seq, '.{{1,36}}', 0)) as (i, bases) from <seqs>))""",
        """select doc_id * 1000000 + i as read_id, concat(doc_id, '.', i) as name,
                  source as file, doc_id % 3 as grp, substr(seq, cast(1 + 36 * i as bigint), 36) as bases,
                  translate(substr(seq, cast(1 + 36 * i as bigint), 36), 'acgt', 'IH5+') as quals,
                  case when i % 3 = 1 then 16 else 0 end as flag, concat('rg', doc_id % 4) as rg
           from (select doc_id, source, seq,
                        unnest(range(cast(floor((length(seq) - 1) / 36) as bigint) + 1)) as i
                 from <seqs> where length(seq) > 0)"""),
}


def _duck(sql: str) -> str:
    return re.sub(r"<(\w+)>", lambda m: m[1] if m[1] in BASE_TABLES else "$" + m[1], sql)


def _spark(sql: str) -> str:
    return re.sub(r"varchar\(\d+\)", "string", re.sub(r"<(\w+)>", r"{\1}", sql))


def add_view(name: str, spark_sql: str | Callable[["Tables"], DataFrame], duck_sql: str | None = None) -> None:
    """Define one more derived view (families keep their own next to their queries)."""
    SPARK_VIEWS[name] = spark_sql if callable(spark_sql) else _spark(spark_sql)
    DUCK_VIEWS[name] = _duck(duck_sql or spark_sql)


SPARK_VIEWS: dict[str, str | Callable[["Tables"], DataFrame]] = {}
DUCK_VIEWS: dict[str, str] = {}
for _name, _sql in _TEXT.items():
    add_view(_name, *(_sql if isinstance(_sql, tuple) else (_sql,)))
