"""Town configurations: YAML files on the driver, small by nature, turned into rule tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # optional
    yaml = None


def load_configs(folder: str) -> dict[str, dict]:
    """Configurations by town tag, files in order of name; files without town and tag (shared settings) and unreadable ones are skipped."""
    if yaml is None:
        raise RuntimeError("reading YAML needs PyYAML")
    out: dict[str, dict] = {}
    for p in sorted([*Path(folder).glob("*.yaml"), *Path(folder).glob("*.yml")]):
        try:
            c = yaml.safe_load(p.read_text(encoding="utf-8")) or {}
        except yaml.YAMLError:
            continue
        if isinstance(c, dict) and c.get("city_tag") and c.get("city"):
            out[str(c["city_tag"])] = c
    return out


def venue_rules(spark: SparkSession, configs: dict[str, dict]) -> DataFrame:
    """Keyword rules (city_tag, rule_ord, word, target) in file order; rules without a target id keep a null target."""
    rows = [(tag, i, str(w), r.get("target_id")) for tag, c in configs.items() for i, r in enumerate(c.get("venue_match_rules") or []) for w in r.get("keywords") or []]
    return spark.createDataFrame(rows, "city_tag string, rule_ord int, word string, target string")


def target_by_name(rules: DataFrame, places: DataFrame, words: DataFrame) -> DataFrame:
    """Give rules without a target the first place whose name holds one of the rule's target words (city_tag, rule_ord, target_word)."""
    open_ = rules.where("target is null").select("city_tag", "rule_ord").distinct().join(words, ["city_tag", "rule_ord"])
    hit = open_.join(places.select("place_id", F.lower("name").alias("_n")), F.col("_n").contains(F.lower("target_word")))
    first = hit.groupBy("city_tag", "rule_ord").agg(F.min("place_id").alias("_t"))
    return rules.join(first, ["city_tag", "rule_ord"], "left").withColumn("target", F.coalesce("target", "_t")).drop("_t").where("target is not null")


def enabled_sources(config: dict) -> list[str]:
    """Names of a town's sources that aren't switched off."""
    return sorted(n for n, s in (config.get("sources") or {}).items() if not isinstance(s, dict) or s.get("enabled", True))


def least_events(config: dict, source: str | None = None, default: int = 1) -> int:
    """Minimum number of events: the source's own, else the town's."""
    s = (config.get("sources") or {}).get(source or "", {})
    return int((s.get("min_events") if isinstance(s, dict) else None) or config.get("min_events") or default)
