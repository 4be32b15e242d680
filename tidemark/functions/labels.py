"""Column expressions over quality labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_id(label: Column) -> Column:
    """The label as an integer; anything unparsable is null.

    Labels may arrive as text or doubles, so the cast goes through double.
    """
    return F.nanvl(label.cast("string").try_cast("double"), F.lit(None).cast("double")).try_cast("int")


def is_issue(label: Column, issue: Iterable[int]) -> Column:
    return F.coalesce(label_id(label).isin(list(issue)), F.lit(False))


def is_reviewed(label: Column, good: Iterable[int], issue: Iterable[int]) -> Column:
    return F.coalesce(label_id(label).isin(list(dict.fromkeys([*good, *issue]))), F.lit(False))


# How each target strategy maps label ids.
TARGET_MAPS = {
    "collapsed_1_34_9": {1: 1, 3: 34, 4: 34, 9: 9},
    "collapsed_12_34_9": {1: 12, 2: 12, 3: 34, 4: 34, 9: 9},
}
TARGET_MAPS["oxygen_collapse_12_34_9"] = TARGET_MAPS["collapsed_12_34_9"]
PLAIN_STRATEGIES = ("raw_multiclass", "multiclass_1_3_4_9")


def strategy_target(label: Column, strategy: str, issue: Iterable[int]) -> Column:
    """Target value under a strategy; null where the strategy has no class."""
    label = label_id(label)
    if strategy == "binary_issue":
        return is_issue(label, issue).cast("int")
    if strategy in PLAIN_STRATEGIES:
        return label
    if strategy not in TARGET_MAPS:
        raise ValueError(f"unknown target strategy: {strategy}")
    target = F.lit(None).cast("int")
    for source, mapped in TARGET_MAPS[strategy].items():
        target = F.when(label == source, mapped).otherwise(target)
    return target


def strategy_labels(strategy: str) -> list[int] | None:
    """Report labels fixed by the strategy; None means those found in the data."""
    fixed = {"multiclass_1_3_4_9": [1, 3, 4, 9], "binary_issue": [0, 1], "collapsed_1_34_9": [1, 34, 9]}
    return fixed.get(strategy, None if strategy == "raw_multiclass" else [12, 34, 9])


def meaning(label: Column, meanings: Mapping[int, str]) -> Column:
    """Readable meaning of a label id, from a small fixed dictionary."""
    text = F.lit(None).cast("string")
    for value, name in meanings.items():
        text = F.when(label == value, name).otherwise(text)
    return text


def finite(*columns: Column) -> Column:
    """True where every value is present and neither NaN nor infinite."""
    usable = F.lit(True)
    for column in columns:
        usable = usable & F.coalesce(F.abs(column.cast("double")) < F.lit(float("inf")), F.lit(False))
    return usable


def infinite_to_null(column: Column) -> Column:
    return F.when(F.abs(column) < F.lit(float("inf")), column)
