"""Simplified forms of traditional characters, read from the character data the cluster's JVM carries."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def simplified(spark: SparkSession) -> dict[str, str]:
    """Traditional character -> simplified one, for the characters that differ.

    Empty where the JVM has no such data; traditional texts then stay as they are.
    """
    chars = [chr(c) for c in (*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000))]
    try:
        made = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified").transliterate("\n".join(chars)).split("\n")
    except Exception:  # noqa: BLE001 - any failure of the bridge means that the data isn't there
        return {}
    if len(made) != len(chars):
        return {}
    return {a: b for a, b in zip(chars, made, strict=True) if a != b and len(b) == 1}


class Simplifier:
    """Replaces by a regex class, which scans texts far faster than a table of all characters."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.pattern: re.Pattern[str] | None = None

    def __getstate__(self):
        return self.table

    def __setstate__(self, table):
        self.table, self.pattern = table, None

    def __call__(self, text: str) -> str:
        if not self.table:
            return text
        if self.pattern is None:
            self.pattern = re.compile("[" + "".join(self.table) + "]")
        return self.pattern.sub(lambda m: self.table[m[0]], text)
