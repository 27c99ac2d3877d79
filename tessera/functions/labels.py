"""The label space, read from a YAML file; labels.yaml beside this module is the default one."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

#: Origin class to region, and a city's tier to its size.
REGIONS = {"DE": "DE", "US": "US", "JP": "JP", "GB": "UK", "FR": "FR", "IT": "IT"}
SIZES = {"major": "large", "medium": "medium", "small": "small"}


@dataclass(frozen=True)
class LabelSpace:
    """heads: name -> (tiers, labels); attributes: name -> (heads, classes); api: rows of (head, name part or None, public type)."""

    heads: dict[str, tuple[list[str], list[str]]]
    attributes: dict[str, tuple[list[str], list[str]]]
    api: list[tuple[str, str | None, str]]

    def label_rows(self) -> list[tuple]:
        """(head, head_idx, label_id, label, prefix, tier): the label's parts; O has no tier."""
        rows = []
        for h, (head, (_, labels)) in enumerate(self.heads.items()):
            for i, label in enumerate(labels):
                prefix, _, tier = label.split("-", 2) if "-" in label else ("O", "", None)
                rows.append((head, h, i, label, prefix, tier and tier.lower()))
        return rows

    def attribute_rows(self) -> list[tuple]:
        """(attr, class_id, class, head) for each head that an attribute applies to."""
        return [(a, i, c, h) for a, (heads, classes) in self.attributes.items() for i, c in enumerate(classes) for h in heads]


def parse(text: str) -> LabelSpace:
    """The label space of a YAML text. Every head's first label must be O; classes are text, whatever YAML takes them for."""
    raw = yaml.safe_load(text)
    heads = {str(h): ([str(t) for t in x["tiers"]], [str(label) for label in x["labels"]]) for h, x in raw["heads"].items()}
    for head, (_, labels) in heads.items():
        if labels[:1] != ["O"]:
            raise ValueError(f"head {head}: the first label must be O, not {labels[:1]}")
    attributes = {str(a): ([str(h) for h in x["applies_to"]], [str(c) for c in x["classes"]]) for a, x in raw["attributes"].items()}
    api: list[tuple[str, str | None, str]] = []
    for head, to in raw["api_mapping"].items():
        api += [(head, part, kind) for part, kind in to["by_name_part"].items()] if isinstance(to, dict) else [(head, None, to)]
    return LabelSpace(heads, attributes, api)


DEFAULT_TEXT = Path(__file__).with_name("labels.yaml").read_text(encoding="utf-8")
DEFAULT = parse(DEFAULT_TEXT)


def label_dim(spark: SparkSession, space: LabelSpace = DEFAULT) -> DataFrame:
    return spark.createDataFrame(space.label_rows(), "head string, head_idx int, label_id int, label string, prefix string, tier string")
