"""Column-name clean-up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def snake_case(name: str, parentheses: str = "") -> str:
    """Words joined by ``_`` in lower case: a word ends before each capital and at each underscore.

    Blanks and dashes stay in their word as ``_``, so ``Part Type`` becomes ``part__type``. Brackets become ``parentheses``.
    """
    inside = {" ": "_", "-": "_", "(": parentheses, ")": parentheses}
    words = [""]
    for char in name:
        ends = char == "_" or char.isupper()
        if ends and (words[-1] or (char == "_" and len(words) == 1)):
            words.append("")
        if char != "_":
            words[-1] += inside.get(char, char.lower())
    return "_".join(words)


def normalize_columns(df: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    renames = renames or {}
    names = [snake_case(c) for c in df.columns]
    names = [renames.get(n, n) for n in names]
    repeated = {n for n in names if names.count(n) > 1}
    if repeated:
        raise ValueError(f"columns collide after clean-up: {sorted(repeated)}")
    return df.toDF(*names)


def clean_dummy_names(df: DataFrame) -> DataFrame:
    """The feature-table variant: lower case, whatever separates words or values becomes ``_``."""
    separators = str.maketrans(dict.fromkeys("() -", "_"))
    return df.toDF(*[c.lower().translate(separators) for c in df.columns])
