"""Names and identifiers: conditions, opaque ids, canonical keys, aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the incident corpora.
FAULT_TYPES = ("cpu", "mem", "disk", "socket", "delay", "loss")
AUXILIARIES = ("frontend-check", "frontend-external", "istio-init", "loadgenerator")
FORBIDDEN_KEYS = (
    "faultlabel", "faulttype", "groundtruth", "label", "labels",
    "rootcause", "rootindicator", "rootlabel", "rootservice", "target",
    "injectiontarget", "injectionservice", "testrootfrequency",
)
FORBIDDEN_PATHS = ("relativedirectory", "sourcepath")


def head(name: Column) -> Column:
    """What stands before the last underscore; empty without one."""
    return F.regexp_extract(name, r"(?s)^(.*)_[^_]*$", 1)


def tail(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^.*_([^_]*)$", 1)


def known_fault(condition: Column) -> Column:
    return F.coalesce((head(condition) != "") & tail(condition).isin(*FAULT_TYPES), F.lit(False))


def opaque_id(prefix: str, namespace: str, relative: Column) -> Column:
    """``prefix-`` and 16 hex digits of the SHA-256 of ``namespace:relative``."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat(F.lit(f"{namespace}:"), relative), 256), 1, 16))


def canonical_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def trace_alias(indicator: Column, channel: Column) -> Column:
    """Trace channels name the front end's service in two ways."""
    return F.when(channel.startswith("trace"), F.regexp_replace(indicator, "^frontendservice_", "frontend_")).otherwise(indicator)
