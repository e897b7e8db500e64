"""Label expressions: ladders, code maps, pattern lists."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Ladder = Sequence[tuple[Column, str]]


def flag(cond: Column) -> Column:
    """1 or 0; an unknown condition counts as 0."""
    return F.when(cond, 1).otherwise(0)


def band(ladder: Ladder, default: str | None) -> Column:
    """First matching label of an ordered ladder."""
    chain = reduce(lambda acc, step: acc.when(*step), ladder[1:], F.when(*ladder[0]))
    return chain.otherwise(default)


def label_of(code: Column, labels: Mapping, unknown: str | None = "text") -> Column:
    """Code to label. `unknown='text'` keeps unknown codes as text, None gives NULL,
    anything else is the label of all unknown codes."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), code)
    if unknown is None:
        return hit
    return F.coalesce(hit, code.cast("string") if unknown == "text" else F.lit(unknown))


def like_any(text: Column, patterns: Iterable[str], ignore_case: bool = False) -> Column:
    """True when any LIKE pattern matches; a backslash in a pattern is a plain character."""
    subject = F.lower(text) if ignore_case else text
    tests = [subject.like((p.lower() if ignore_case else p).replace("\\", "\\\\")) for p in patterns]
    return reduce(lambda a, b: a | b, tests)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def keyword_pattern(words: Sequence[str]) -> str:
    """One pattern for all words: a tree of their letters, so that a place in a text is left at the first letter
    no word goes on with. At each place it matches the longest word."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def spell(node: dict) -> str:
        branches = [("" if c.isalnum() else "\\") + c + spell(child) for c, child in sorted(node.items()) if c]
        if not branches:
            return ""
        joined = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return joined + ("?" if "" in node else "")

    return spell(tree)


def keyword_rank(text: Column, ranks: Mapping[str, int]) -> Column:
    """The smallest rank of any of the words in the text, NULL if none is there; one pass whatever their number.

    At each place the longest word is found; words inside it are known beforehand.
    """
    words = [w for w in ranks if w]
    best = {w: min(ranks[v] for v in words if v in w) for w in words}
    if not words:
        return F.lit(None).cast("int")
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({keyword_pattern(words)}))"), 1))
    table = F.create_map(*[F.lit(x) for pair in best.items() for x in pair])
    return F.array_min(F.transform(hits, lambda w: F.element_at(table, w)))
