"""Named sets of strings, as predicates and as rewrites of terms.

Patterns match whole strings. They are regular expressions of Java; the operators that some index engines add
(~ complement, & intersection, @ anything, <n-m> interval) are rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_ADDED = re.compile(r"(?<!\\)(?:\\\\)*(?:[~&@]|(?<!\?)(?<!\(\?P)<\d+-\d+>)")


def whole(pattern: str) -> str:
    """The pattern anchored at both ends."""
    outside = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "", pattern)
    if _ADDED.search(outside):
        raise ValueError(f"operators ~ & @ <n-m> aren't supported: {pattern!r}")
    return rf"\A(?:{pattern})\z"


@dataclass(frozen=True)
class TermSet:
    """label, and the strings in it: those of `terms` and those that match one of `patterns`."""

    label: str
    terms: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    everything: bool = False

    def test(self, term: Column) -> Column:
        found = F.lit(self.everything)
        if self.terms:
            found = found | term.isin(list(self.terms))
        for p in self.patterns:
            found = found | term.rlike(whole(p))
        return F.coalesce(found, F.lit(False))

    def rewrite(self, term: Column) -> Column:
        """The label for members, other terms as they are."""
        return F.when(self.test(term), F.lit(self.label)).otherwise(term)

    def union(self, *others: TermSet, label: str = "UNION") -> TermSet:
        sets = (self, *others)
        join = lambda name: tuple(dict.fromkeys(x for s in sets for x in getattr(s, name)))
        return TermSet(label, join("terms"), join("patterns"), any(s.everything for s in sets))

    def followed_by(self, other: TermSet, label: str) -> TermSet:
        """All strings that are one of this set and then one of the other."""
        left, right = (s.alternatives() for s in (self, other))
        return TermSet(label, (), (f"(?:{left})(?:{right})",))

    def alternatives(self) -> str:
        if self.everything:
            return r"(?s:.*)"
        return "|".join([*(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in self.terms), *(f"(?:{p})" for p in self.patterns)]) or r"(?!)"


ANY = TermSet("ANY", everything=True)
EMPTY = TermSet("EMPTY")
