"""A report of the environment that never fails."""

from __future__ import annotations

import platform


def report(spark=None) -> dict[str, str]:
    out = {"python": platform.python_version(), "platform": platform.platform()}
    try:
        import pyspark

        out["pyspark"] = pyspark.__version__
        if spark is not None:
            out |= {k: str(spark.conf.get(k, "unset")) for k in ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.ansi.enabled")}
            out["java"] = spark.sparkContext._jvm.System.getProperty("java.version")
    except Exception as e:  # the report is what one reads when something is broken
        out["error"] = f"{type(e).__name__}: {e}"
    return out
