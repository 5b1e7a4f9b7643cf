"""Environment checks: a report of OK, WARN and ERROR lines; only an ERROR is fatal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .plans.config import Profile


@dataclass(frozen=True)
class Line:
    check: str
    severity: str
    message: str


def run(spark: SparkSession, profile: Profile) -> list[Line]:
    out = []

    def add(check: str, good: bool, message: str, otherwise: str = "ERROR") -> None:
        out.append(Line(check, "OK" if good else otherwise, message))

    def there(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    add("version", int(spark.version.split(".")[0]) >= 4, f"Spark {spark.version}")
    add("ansi", spark.conf.get("spark.sql.ansi.enabled") == "true", "ANSI mode, so overflows are errors")
    add("time zone", spark.conf.get("spark.sql.session.timeZone") == "UTC", "session time zone", "WARN")
    add("log", there(profile.log), profile.log)
    add("target", there(profile.target), profile.target, "WARN")
    add("adaptive", spark.conf.get("spark.sql.adaptive.enabled") == "true", "adaptive execution", "WARN")
    return out


def fatal(lines: DataFrame) -> DataFrame:
    """Whether any line is an error."""
    return lines.agg(F.coalesce(F.bool_or(F.col("severity") == "ERROR"), F.lit(False)).alias("fatal"))
