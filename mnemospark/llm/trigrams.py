"""Boolean trigram queries of regular expressions, and an inverted index that answers them.

A query is True (every text), a trigram, or ("and" | "or", [queries]). A text that matches the
expression satisfies its query; the reverse need not hold, so candidates are verified.
"""

from __future__ import annotations

from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Most strings that an exact part of an expression is spelled out into.
EXACT = 64
#: Rows of a block of postings, about.
BLOCK = 1024


def query(pattern: str):
    """The Boolean trigram query of a regular expression, on text in lower case."""
    exact, found = _walk(list(_parser.parse(pattern)))
    return simple(both([found, of_strings(exact)]))


def of_strings(exact: set[str]):
    if any(len(s) < 3 for s in exact):
        return True
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact]
    least = sorted({tuple(sorted(s)) for s in sets if not any(t < s for t in sets)})
    return ("or", [("and", list(s)) for s in least])


def both(queries: list):
    return ("and", [q for q in queries if q is not True])


def simple(q):
    """q without empty or single-member nodes."""
    if q is True or isinstance(q, str):
        return q
    kind, parts = q[0], [simple(x) for x in q[1]]
    if kind == "or" and (True in parts or not parts):
        return True
    parts = [x for x in parts if x is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (kind, parts)


def _walk(nodes: list) -> tuple[set[str], object]:
    """The strings that end a sequence (empty where unknown), and the query of what came before."""
    exact, needed = {""}, []

    def unknown() -> None:
        nonlocal exact
        needed.append(of_strings(exact))
        exact = {""}

    for op, arg in nodes:
        part: set[str] | None = None
        inner = True
        if op is K.LITERAL:
            part = {chr(arg).lower()}
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is K.AT:
            continue
        elif op is K.SUBPATTERN:
            part, inner = _known(list(arg[3]))
        elif op is K.BRANCH:
            ways = [_known(list(x)) for x in arg[1]]
            if all(w[0] is not None for w in ways):
                part = set().union(*(w[0] for w in ways))
            else:
                inner = ("or", [both([w[1], of_strings(w[0] or {""})]) for w in ways])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, body = arg
            strings, q = _known(list(body))
            if strings is not None and high is not K.MAXREPEAT and high <= 2:
                part = {""} if low == 0 else set()
                part |= strings if high >= 1 and low <= 1 else set()
                part |= {a + b for a in strings for b in strings} if high == 2 else set()
            elif low:
                inner = both([q, of_strings(strings or {""})])
        if part is not None and len(exact) * len(part) <= EXACT:
            exact = {a + b for a in exact for b in part}
        else:
            unknown()
            needed.append(inner if part is None else of_strings(part))
    return exact, both(needed)


def _known(nodes: list) -> tuple[set[str] | None, object]:
    """The strings of a sequence if it is nothing else (None if not), and its query."""
    exact, found = _walk(nodes)
    if simple(found) is True and not any(_open(n) for n in nodes):
        return exact, True
    return None, both([found, of_strings(exact)])


def _open(node) -> bool:
    """Whether a node stands for more strings than _walk spells out."""
    op, arg = node
    if op is K.LITERAL or op is K.AT:
        return False
    if op is K.IN:
        return not all(o is K.LITERAL for o, _ in arg)
    if op is K.SUBPATTERN:
        return any(_open(n) for n in arg[3])
    if op is K.BRANCH:
        return any(_open(n) for x in arg[1] for n in x)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        return arg[1] is K.MAXREPEAT or arg[1] > 2 or any(_open(n) for n in arg[2])
    return True


def trigrams(q) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))


def postings(rows: DataFrame, wanted: list[str], blocks: int) -> DataFrame:
    """The inverted index: (block, trigram, rows), rows the sorted distinct keys in a block of keys.

    rows has row_key and text. Only the trigrams that some query names are indexed.
    """
    low = rows.select("row_key", F.lower("text").alias("low"))  # a column of its own: made once for all trigrams
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    each = low.select("row_key", F.explode(held).alias("trigram"))
    block = F.pmod("row_key", F.lit(blocks)).alias("block")
    return each.groupBy(block, "trigram").agg(F.array_sort(F.collect_set("row_key")).alias("rows"))


def answer(q, lists: Column) -> Column:
    """The keys that satisfy q in one block; lists maps a trigram to its keys."""
    if isinstance(q, str):
        return F.coalesce(lists[q], F.array().cast("array<bigint>"))
    parts = [answer(x, lists) for x in q[1]]
    join = F.array_intersect if q[0] == "and" else F.array_union
    out = parts[0]
    for x in parts[1:]:
        out = join(out, x)
    return out


def candidates(rows: DataFrame, queries: list) -> DataFrame:
    """(row_key, rules): bit k of rules is set where queries[k] holds; rows that satisfy none have no row.

    Queries that are True are left to the caller: they ask for every row. Postings are cut into
    blocks of about ``BLOCK`` keys, so the list of a trigram that most texts hold stays bounded.
    """
    asked = [(k, q) for k, q in enumerate(queries) if q is not True]
    if not asked:
        return rows.select("row_key", F.lit(0).cast("long").alias("rules")).limit(0)
    wanted = sorted(set().union(*(trigrams(q) for _, q in asked)))
    blocks = max(1, rows.count() // BLOCK)
    index = postings(rows, wanted, blocks)
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))
    found = F.array(*[F.struct(F.lit(1 << k).cast("long").alias("rule"), answer(q, F.col("lists")).alias("rows")) for k, q in asked])
    each = lists.select(F.explode(found).alias("x")).select(F.col("x.rule").alias("rule"), F.explode("x.rows").alias("row_key"))
    return each.groupBy("row_key").agg(F.bit_or("rule").alias("rules"))
