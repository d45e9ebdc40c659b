"""The registered queries of the scanner, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.operators.catalogue import BY_ID, DKR_002
from tracewell.operators.scan import scan
from tracewell.plans import findings_queries, oracle, patch_queries
from tracewell.plans.corpus import derived_files


def rule_name(rule_id: str) -> str:
    """``PSEC-XSS-PY-001`` to ``rule_xss_py``."""
    return "rule_" + rule_id.removeprefix("PSEC-").lower().replace("-", "_").removesuffix("_001" if not rule_id.startswith("IAC") else "")


def _rule_query(rule_id: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: scan(derived_files(spark, sf_dir), [rule_id])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(derived_files(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {rule_name(r): _rule_query(r) for r in [*BY_ID, DKR_002[0]]} | findings_queries.QUERIES | patch_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {rule_name(k): oracle.rule_sql(r) for k, r in BY_ID.items()} | {rule_name(DKR_002[0]): oracle.last_user_sql()} | findings_queries.ORACLES | patch_queries.ORACLES
