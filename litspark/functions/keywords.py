"""Boolean keyword queries as predicates.

A query is an AND of groups, a group an OR of literal texts. Blanks separate groups unless quoted,
``|`` separates the alternatives of a group, an empty alternative matches everything.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a term of a query with quotes, for Python and for Java.
QUOTED_TERM = r'(?:"[^"]*"|[^\s"])+'
QUOTED_TERM_JAVA = r'(?U)(?:"[^"]*"|[^\s\x1c-\x1f"])+'


def query_groups(query: str) -> list[list[str]]:
    """Groups of one query given as an argument."""
    if '"' in query:
        terms = [t.replace('"', "") for t in re.findall(QUOTED_TERM, query)]
    else:
        terms = query.split(" ")
    return [t.split("|") for t in terms]


def query_terms_col(query: Column) -> Column:
    quoted = F.transform(
        F.regexp_extract_all(query, F.lit(QUOTED_TERM_JAVA), F.lit(0)), lambda t: F.replace(t, F.lit('"'), F.lit(""))
    )
    return F.when(F.contains(query, F.lit('"')), quoted).otherwise(F.split(query, " ", -1))


def query_groups_col(query: Column) -> Column:
    """Groups of a column of queries, array<array<string>>; same rule as ``query_groups``."""
    return F.transform(query_terms_col(query), lambda t: F.split(t, "[|]", -1))


def keyword_predicate(query: str, info_upper: Column) -> Column:
    """Predicate of one query over upper-cased text: literal ``contains`` calls."""
    needed = [g for g in query_groups(query) if "" not in g]
    per_group = [
        reduce(lambda a, b: a | b, [F.contains(info_upper, F.upper(F.lit(t))) for t in g]) for g in needed
    ]
    return reduce(lambda a, b: a & b, per_group, F.lit(True))


def groups_match(groups_upper: Column, info_upper: Column) -> Column:
    """The same test when the (upper-cased) groups are data."""
    return F.forall(groups_upper, lambda g: F.exists(g, lambda t: F.contains(info_upper, t)))
