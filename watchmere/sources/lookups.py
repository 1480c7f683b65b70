"""Lookup tables: assets, identities, networks and threat intelligence.

They are read on the driver (YAML, CSV, JSON) and become small DataFrames; a
missing file is an empty table.  ``joinable`` broadcasts one only up to a row
count that was checked when it was read.
"""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import disjoint

BROADCAST_ROWS = 100_000

#: What a known asset has where its record says nothing, and users that are privileged without a record.
ASSET_DEFAULTS = {"criticality": "medium", "role": "unknown", "environment": "production", "owner": "unassigned"}
PRIVILEGED_USERS = ("root", "Administrator", "admin")
INTEL_CONFIDENCE = 50


@dataclass
class Lookups:
    assets: dict[str, dict] = field(default_factory=dict)
    identities: dict[str, dict] = field(default_factory=dict)
    networks: list[tuple[str, tuple]] = field(default_factory=list)  # CIDR, (country, code, organisation)
    intel: dict[str, dict] = field(default_factory=dict)


def read_networks(text: str) -> list[tuple[str, tuple]]:
    return [(r["network"], (r.get("country"), r.get("country_code"), r.get("asn_org"))) for r in csv.DictReader(io.StringIO(text, newline="")) if r.get("network")]


def load(directory: str | Path, spark: SparkSession | None = None) -> Lookups:
    """assets.yml, identities.yml, geoip.csv and threat_intel.json of a directory: a local one, or one of any file system that Spark reads."""

    def text(name: str) -> str:
        if spark is None:
            path = Path(directory) / name
            return path.read_text(encoding="utf-8") if path.exists() else ""
        try:
            rows = spark.read.text(f"{directory}/{name}", wholetext=True).select("value", F.input_file_name().alias("path")).orderBy("path").collect()  # one row a file
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return ""
            raise
        return "".join(r["value"] for r in rows)

    return Lookups(yaml.safe_load(text("assets.yml")) or {}, yaml.safe_load(text("identities.yml")) or {}, read_networks(text("geoip.csv")), json.loads(text("threat_intel.json") or "{}"))


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def assets(spark: SparkSession, found: Lookups) -> DataFrame:
    return _frame(spark, [(h, *[(a or {}).get(k, v) for k, v in ASSET_DEFAULTS.items()]) for h, a in found.assets.items()], "a_host string, a_criticality string, a_role string, a_environment string, a_owner string")


def identities(spark: SparkSession, found: Lookups) -> DataFrame:
    rows = [(u, i.get("privileged", u in PRIVILEGED_USERS), i.get("type", "unknown"), i.get("department"), i.get("enabled", True)) for u, i in ((u, i or {}) for u, i in found.identities.items())]
    return _frame(spark, rows, "i_user string, i_privileged boolean, i_type string, i_department string, i_enabled boolean")


def intel(spark: SparkSession, found: Lookups) -> DataFrame:
    return _frame(spark, [(ip, h.get("source"), h.get("category"), int(h.get("confidence", INTEL_CONFIDENCE))) for ip, h in found.intel.items()], "t_ip string, t_source string, t_category string, t_confidence int")


def networks(spark: SparkSession, found: Lookups) -> DataFrame:
    """Disjoint intervals of address keys, IPv4 and IPv6, a row each."""
    rows = [(lo, hi, *attributes) for lo, hi, attributes in disjoint(found.networks)]
    return spark.createDataFrame(rows, "g_lo string, g_hi string, g_country string, g_code string, g_org string")
