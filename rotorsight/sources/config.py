"""Risk configuration, rule dimensions and clause tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import limits as L


@dataclass(frozen=True)
class RiskConfig:
    """A few dozen values read once; they become literals in the plans."""

    version: str = L.RISK_VERSION
    high_risk_devices: list[str] = field(default_factory=lambda: list(L.HIGH_RISK_DEVICES))
    trip_rules: list[str] = field(default_factory=lambda: list(L.TRIP_RULES))
    warn_rules: list[str] = field(default_factory=lambda: list(L.WARN_RULES))
    failure_mode_risk: dict[str, str] = field(default_factory=lambda: dict(L.FAILURE_MODE_RISK))


# What applies when the file is missing, and when it exists but cannot be read.
MISSING_FILE = RiskConfig("unversioned", list(L.MISSING_FILE_HIGH_RISK), list(L.TRIP_RULES),
                          list(L.MISSING_FILE_WARN_RULES), {})
UNREADABLE_FILE = RiskConfig("unversioned", [], list(L.TRIP_RULES),
                             list(L.MISSING_FILE_WARN_RULES), {})


def load_risk_config(spark: SparkSession, path: str) -> RiskConfig:
    """Read the JSON file; absent keys fall back like an unreadable file does."""
    try:
        found = spark.read.format("binaryFile").load(path).limit(1).count()
    except AnalysisException:
        return MISSING_FILE
    if not found:
        return MISSING_FILE
    frame = spark.read.option("multiLine", True).json(path)
    if "_corrupt_record" in frame.columns or not frame.columns:
        return UNREADABLE_FILE
    row = frame.first().asDict(recursive=True)
    modes = {k: str((v or {}).get("risk_level") or "LOW").upper()
             for k, v in (row.get("failure_mode_matrix") or {}).items()}
    pick = lambda key, default: list(row[key]) if row.get(key) is not None else default
    return RiskConfig(
        str(row.get("version") or "unversioned"), pick("high_risk_devices", []),
        pick("trip_rules", UNREADABLE_FILE.trip_rules),
        pick("warn_rules", UNREADABLE_FILE.warn_rules),
        {k: v if v in L.RISK_LEVELS else "LOW" for k, v in modes.items()})


def risk_matrix(spark: SparkSession) -> DataFrame:
    """Four fixed rows: level, name, default decision, hours to respond."""
    return spark.createDataFrame(
        L.RISK_MATRIX, "level string, name string, default_decision string, sla_hours double")


CLAUSE_SCHEMA = ("doc_id string, chunk_id string, section string, quote string, page int, "
                 "rule_codes array<string>, keywords array<string>, requirement string, "
                 "action string, mechanism string")


def read_clauses(spark: SparkSession, path: str) -> DataFrame:
    """Manual clauses from JSON files of the form {"clauses": [...]}."""
    empty = F.array().cast("array<string>")
    fields = ", ".join(":".join(part.split(" ", 1)) for part in CLAUSE_SCHEMA.split(", "))
    return (spark.read.schema(f"clauses array<struct<{fields}>>")
            .option("multiLine", True).json(path)
            .select(F.explode("clauses").alias("c")).select("c.*")
            .withColumns({"rule_codes": F.coalesce("rule_codes", empty),
                          "keywords": F.coalesce("keywords", empty)}))

