"""SQL functions for users who write SQL: plain expressions, inlined by the analyzer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hydrolake import config


def register(spark: SparkSession) -> list[str]:
    """risk_level(depth), risk_label(depth) and api7(rain array, today first)."""
    levels = [band[0] for band in config.RISK_BANDS]
    labels = [band[1] for band in config.RISK_BANDS]

    def chain(names: list[str]) -> str:
        return (
            "CASE WHEN depth IS NULL OR isnan(depth) THEN NULL "
            f"WHEN depth < {config.DEPTH_WASPADA} THEN '{names[0]}' "
            f"WHEN depth < {config.DEPTH_SIAGA} THEN '{names[1]}' "
            f"WHEN depth < {config.DEPTH_AWAS} THEN '{names[2]}' ELSE '{names[3]}' END"
        )

    bodies = {
        "risk_level(depth DOUBLE) RETURNS STRING": chain(levels),
        "risk_label(depth DOUBLE) RETURNS STRING": chain(labels),
        "api7(rain ARRAY<DOUBLE>) RETURNS DOUBLE": (
            f"aggregate(rain, named_struct('s', 0D, 'w', 1D), "
            f"(a, x) -> named_struct('s', a.s + a.w * coalesce(x, 0D), 'w', a.w * {config.API_DECAY}D), a -> a.s)"
        ),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return ["risk_level", "risk_label", "api7"]
