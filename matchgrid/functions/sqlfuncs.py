"""SQL functions for interactive use. Each is one expression, which the optimiser inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_FUNCTIONS = {
    "box_iou": (
        "ax DOUBLE, ay DOUBLE, aw DOUBLE, ah DOUBLE, bx DOUBLE, by DOUBLE, bw DOUBLE, bh DOUBLE",
        """CASE WHEN aw * ah + bw * bh > greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0D)
                                    * greatest(least(ay + ah, by + bh) - greatest(ay, by), 0D)
           THEN greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0D) * greatest(least(ay + ah, by + bh) - greatest(ay, by), 0D)
              / (aw * ah + bw * bh - greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0D)
                                    * greatest(least(ay + ah, by + bh) - greatest(ay, by), 0D))
           ELSE 0D END""",
    ),
    "wilson_low": (
        "k DOUBLE, n DOUBLE",
        """CASE WHEN n > 0 THEN greatest(0D, (k / n + 3.8416D / (2D * n)
             - 1.96D * sqrt(k / n * (1D - k / n) / n + 3.8416D / (4D * n * n))) / (1D + 3.8416D / n)) ELSE 0D END""",
    ),
    "undistort_x": (
        "x DOUBLE, y DOUBLE, k1 DOUBLE",
        "0.5D + (x - 0.5D) / (1D + k1 * (power(2D * (x - 0.5D), 2D) + power(2D * (y - 0.5D) * 9D / 16D, 2D)))",
    ),
    "pitch_x": (
        "h ARRAY<DOUBLE>, x DOUBLE, y DOUBLE",
        "(h[0] * x + h[1] * y + h[2]) / nullif(h[6] * x + h[7] * y + h[8], 0D)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
    return sorted(SQL_FUNCTIONS)
