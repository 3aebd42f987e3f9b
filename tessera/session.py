"""Session settings the semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Strict arithmetic, case-sensitive names, one time zone, runtime re-planning.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that someone else made."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config(map={**SETTINGS, **conf})
    return configure((builder.master(master) if master else builder).getOrCreate())
