"""Registry of queries with their oracle SQL, and the tables they read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import BASE_TABLES, DUCK_VIEWS, SPARK_VIEWS

# Tables whose rows carry most of the work, and the columns that spread them.
SPREAD_KEYS = {"documents": ("doc_id",), "pages": ("page_id",), "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")}

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the base tables and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._seen = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in SPARK_VIEWS:
                view = SPARK_VIEWS[name]
                self._seen[name] = view(self) if callable(view) else self.sql(view)
            elif name in BASE_TABLES:
                self._seen[name] = self._scan(name)
            else:
                raise AttributeError(name)
        return self._seen[name]

    def _scan(self, name: str) -> DataFrame:
        """The table's parquet scan. A table in fewer row groups than the session has task slots
        is spread first, because the work per row outweighs moving it once; larger tables are read as they lie."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        slots = self.spark.sparkContext.defaultParallelism
        if name in SPREAD_KEYS and df.rdd.getNumPartitions() < slots:
            df = df.repartition(slots, *SPREAD_KEYS[name])
        return df

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over `{table}` references."""
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def query(name: str, oracle: str | None = None):
    """Register a query; `oracle` is SQL over base tables and `$view` names."""
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn
    return add


def with_views(text: str) -> str:
    """Put the derived views an oracle names with `$` in front of it as CTEs."""
    needed: list[str] = []

    def need(sql: str):
        for name in re.findall(r"\$(\w+)", sql):
            if name not in needed:
                need(DUCK_VIEWS[name])
                needed.append(name)

    need(text)
    body = re.sub(r"\$(\w+)", r"\1", text).strip()
    heads = ",\n".join(f"{n} as ({re.sub(r'[$](\w+)', r'\1', DUCK_VIEWS[n])})" for n in needed)
    if not heads:
        return body
    found = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if found:
        return f"with {found.group(1) or ''}{heads},\n{body[found.end():]}"
    return f"with {heads}\n{body}"
