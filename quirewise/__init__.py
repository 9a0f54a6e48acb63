"""Taking scanned document collections apart with Spark."""

from .rules import CN_EXAM, CN_EXAM_STRICT, LATIN, SCAN, LayoutProfile, RuleProfile

__all__ = ["CN_EXAM", "CN_EXAM_STRICT", "LATIN", "SCAN", "LayoutProfile", "RuleProfile"]
