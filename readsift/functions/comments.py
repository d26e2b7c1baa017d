"""Predicates and flags on operator comments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from readsift.config import ACCEPTED_MARK, AUTOMATIC_MARK, RULE_MARKS


def not_automatic(comment: Column) -> Column:
    """Comment lacks the automatic mark; a NULL comment does not qualify."""
    return ~comment.contains(AUTOMATIC_MARK)


def says_accepted(comment: Column) -> Column:
    return comment.contains(ACCEPTED_MARK)


def rule_flags(comment: Column) -> dict[str, Column]:
    """One 0/1 column per validation rule named in the comment; NULL gives 0."""
    return {
        name: F.when(F.instr(comment, mark) >= 1, 1).otherwise(0)
        for name, mark in RULE_MARKS
    }
