"""Boolean queries, and their compilation to one column over the scores of a document's terms.

A null score means no match. AND adds its children (null if any is), OR takes the best (nulls are passed over), NOT
keeps the positive child where the negative one is null. So a tree of any depth is one aggregation of the postings.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class QueryType(Enum):
    TERM = "TERM"
    AND = "AND"
    OR = "OR"
    NOT = "NOT"


@dataclass(frozen=True)
class Query:
    type: QueryType
    term: str = ""
    children: tuple[Query, ...] = ()

    @staticmethod
    def Term(term: str) -> Query:
        """The term as it is: queries aren't analysed."""
        return Query(QueryType.TERM, term)

    @staticmethod
    def And(*children: Query) -> Query:
        return Query(QueryType.AND, children=_flat(children))

    @staticmethod
    def Or(*children: Query) -> Query:
        return Query(QueryType.OR, children=_flat(children))

    @staticmethod
    def Not(positive: Query, negative: Query | None = None) -> Query:
        """What matches ``positive`` but not ``negative``; with one child nothing matches."""
        return Query(QueryType.NOT, children=(positive,) if negative is None else (positive, negative))

    def is_empty(self) -> bool:
        """Whether nothing can match, whatever the index holds."""
        kids = self.children
        if self.type is QueryType.TERM:
            return not self.term
        if self.type is QueryType.AND:
            return not kids or any(c.is_empty() for c in kids)
        if self.type is QueryType.OR:
            return all(c.is_empty() for c in kids)
        return len(kids) < 2 or kids[0].is_empty()

    def terms(self) -> list[str]:
        """The distinct terms that can matter, in order of first use."""
        if self.is_empty():
            return []
        if self.type is QueryType.TERM:
            return [self.term]
        kids = self.children[:2] if self.type is QueryType.NOT else self.children
        return list(dict.fromkeys(t for c in kids for t in c.terms()))

    def compile(self, scores: Mapping[str, Column], *, exact_float: bool = True) -> Column:
        """The score column, given a nullable score column for each term. ``exact_float`` rounds each node to a 32-bit float."""
        kind = "float" if exact_float else "double"
        none = F.lit(None).cast(kind)
        if self.is_empty():
            return none
        if self.type is QueryType.TERM:
            return scores[self.term].cast(kind)
        kids = [c.compile(scores, exact_float=exact_float) for c in self.children]
        if self.type is QueryType.AND:
            total = kids[0].cast("double")
            for k in kids[1:]:
                total = total + k.cast("double")
            return total.cast(kind)
        if self.type is QueryType.OR:
            return F.greatest(*kids) if len(kids) > 1 else kids[0]
        return F.when(kids[1].isNull(), kids[0]).otherwise(none)


def _flat(children) -> tuple[Query, ...]:
    return tuple(children[0]) if len(children) == 1 and not isinstance(children[0], Query) else tuple(children)


# The code points by which a query text counts as CJK; narrower than the tokeniser's.
QUERY_CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF))


def build_query(text: str) -> Query:
    """A query from a search box: CJK text becomes the AND of its bigrams (of single characters where they stand alone), other text one raw term."""
    cjk = [any(a <= ord(c) <= b for a, b in QUERY_CJK) for c in text]
    if sum(cjk) * 2 <= len(text):
        return Query.Term(text)
    runs: list[str] = []
    for c, is_cjk in zip(text, cjk, strict=True):
        if not is_cjk:
            runs.append("")
        elif runs:
            runs[-1] += c
        else:
            runs.append(c)
    parts = [Query.Term(x) for run in runs if run for x in ([run[i : i + 2] for i in range(len(run) - 1)] or [run])]
    return parts[0] if len(parts) == 1 else Query.And(*parts)
