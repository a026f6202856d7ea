"""SQL names of the scalar functions: native SQL functions, inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.operators.memory import BETA

#: name: (parameters, result, body).
FUNCTIONS = {
    "ev_base_tokens": ("t STRING", "ARRAY<STRING>", r"transform(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_.-]*|[0-9]+(?:\\.[0-9]+)?|[\\x{4e00}-\\x{9fff}]', 0), x -> lower(x))"),
    "ev_format_timestamp": ("s DOUBLE", "STRING", "format_string('[%02d:%02d:%02d]', cast(floor(greatest(0D, s) / 3600) as bigint), cast(floor(pmod(greatest(0D, s), 3600D) / 60) as bigint), cast(floor(pmod(greatest(0D, s), 60D)) as bigint))"),
    "ev_stable_id": ("t STRING", "STRING", "substring(sha2(t, 256), 1, 24)"),
    "ev_temporal_iou": ("a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE", "DOUBLE", "CASE WHEN greatest(a1, b1) > least(a0, b0) THEN greatest(0D, least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)) ELSE 0D END"),
    "ev_confidence": ("score DOUBLE", "STRING", "CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END"),
    "ev_overlap": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN least(size(array_distinct(a)), size(array_distinct(b))) > 0 THEN size(array_intersect(a, b)) / least(size(array_distinct(a)), size(array_distinct(b))) ELSE 0D END"),
    "ev_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"),
    "ev_hamming": ("a STRING, b STRING", "INT", "CASE WHEN length(a) <> length(b) THEN 999 ELSE bit_count(cast(conv(a, 16, -10) as bigint) ^ cast(conv(b, 16, -10) as bigint)) END"),
    "ev_decay": ("similarity DOUBLE, age_days DOUBLE, frequency DOUBLE, importance DOUBLE, alpha DOUBLE", "DOUBLE", f"greatest(0D, similarity) * exp(-alpha * greatest(0D, age_days)) * (1 + {BETA}D * ln(greatest(1D, frequency) + 1)) * greatest(0D, importance)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and give their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
