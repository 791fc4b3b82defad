"""SQL names for the column functions: plain SQL functions, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "revcomp(s STRING) RETURNS STRING":
        "RETURN reverse(translate(s, 'ACGTMRWSYKVHDBNXacgtmrwsykvhdbnx', 'TGCAKYWSRMBDHVNXtgcakywsrmbdhvnx'))",
    "iupac_letter(m INT) RETURNS STRING": "RETURN substring('XACMGRSVTWYHKDBN', m + 1, 1)",
    "iupac_mask(s STRING) RETURNS INT":
        "RETURN aggregate(split(upper(s), ''), 0, (a, x) -> a | (instr('XACMGRSVTWYHKDBN', x) - 1))",
    # Table function: every k-letter window with its 0-based position.
    "kmers(s STRING, k INT) RETURNS TABLE (pos INT, kmer STRING)":
        "RETURN SELECT p - 1, substring(s, p, k) FROM (SELECT explode(CASE WHEN length(s) >= k THEN sequence(1, length(s) - k + 1) ELSE array() END) AS p)",
}


def register(spark: SparkSession) -> None:
    """Create the functions for the session."""
    for head, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} {body}")
