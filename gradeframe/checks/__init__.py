"""Queries over the driver tables that exercise every operator."""

from __future__ import annotations

import importlib

MODULES = [
    "grading_checks",
    "text_checks",
    "agreement_checks",
    "segment_checks",
    "link_checks",
    "reply_checks",
    "stream_checks",
]


def all_checks():
    """All registered queries by name."""
    for module in MODULES:
        importlib.import_module(f"gradeframe.checks.{module}")
    from gradeframe.checks.registry import CHECKS

    return CHECKS
