"""Quality rules: an ordered decision list learned by sequential covering.

Statistics of every text are computed once and stored. Rules are grown on two thirds of the
labelled sample and pruned on the rest: each is a conjunction of thresholds that marks bad
texts; covered rows leave, and the next rule is learned on what is left. The list is emitted
as one ordered Spark conditional expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Most labelled rows that the list is learned from, taken by a hash of doc_id.
SAMPLE = 20_000
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rules, conditions in a rule, thresholds tried for a statistic.
RULES, CONDITIONS, CUTS = 12, 3, 32
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "bar_share", "distinct_share", "symbol_words", "log_words")


def statistics(text: str) -> tuple:
    """COUNTS and RATIOS of one text."""
    words = text.encode().split()
    n = len(words)
    shown = b"".join(words).decode()
    lines, dup = set(), 0
    full = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    for x in full:
        dup += x in lines
        lines.add(x)
    marks = sum(map(text.count, SYMBOLS))
    upper = sum(map(str.isupper, shown))
    ends = sum(w[-1] in b"#*$%&|<>!" for w in words)
    counts = (n, len(shown), marks, dup, repeated(words))
    chars = max(len(shown), 1)
    ratios = (
        len(shown) / max(n, 1), marks / chars, dup / max(len(full), 1), counts[4] / max(n, 1), upper / chars, sum(map(shown.count, "0123456789")) / chars,
        shown.count("!") / chars, shown.count("|") / max(n, 1), len(set(words)) / max(n, 1), ends / max(n, 1), float(np.log1p(n)),
    )
    return counts + ratios


def repeated(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of width words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    place: dict[bytes, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
    # Windows are ranked by doubling: pairs of ranks of halves get a rank of their own, exactly.
    rank, span = ids, 1
    while span < width:
        _, rank = np.unique(rank[:-span] * (len(words) + 1) + rank[span:], return_inverse=True)
        span *= 2
    again = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += again
    cover[width : width + n] -= again
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, RATIOS) of every row; a null text has no word. Rows of documents map one to one."""
    common.prepare(docs.sparkSession)
    names = ["doc_id", *COUNTS, *RATIOS]

    def run(batches):
        for b in batches:
            columns = list(zip(*map(statistics, b.column(1).to_pylist()), strict=True)) or [[] for _ in names[1:]]
            kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RATIOS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in RATIOS)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs).alias("text")).mapInArrow(common.frugal(run), schema)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] >= self.cut if self.above else table[self.name] < self.cut

    def column(self) -> Column:
        return F.col(self.name) >= F.lit(self.cut) if self.above else F.col(self.name) < F.lit(self.cut)


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(table)
    return out


def grow(table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition of most information gain while it removes good rows."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and (~bad[inside]).any():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        before, best = np.log2(p / (p + n)) if p else 0.0, (0.0, None)
        for name in RATIOS:
            x = table[name][inside]
            for cut in np.unique(np.quantile(x, np.linspace(0, 1, CUTS + 1)[1:])).tolist():
                for above in (True, False):
                    held = (x >= cut) == above
                    q = (held & bad[inside]).sum()
                    if q and not held.all():
                        gain = q * (np.log2(q / held.sum()) - before)
                        if gain > best[0] + 1e-9:
                            best = gain, Condition(name, above, cut)
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(table)
    return rule


def prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float]:
    """Drops last conditions while the pruning rows are told apart as well; and their precision."""
    best, worth, share = rule, -2.0, 0.0
    for k in range(len(rule), 0, -1):
        held = covers(rule[:k], table, len(bad))
        p, n = (held & bad).sum(), (held & ~bad).sum()
        value = (p - n) / (p + n) if p + n else -1.0
        if value >= worth + 1e-9:
            best, worth, share = rule[:k], value, p / (p + n) if p + n else 0.0
    return best, share


def learn(table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9) -> list[Rule]:
    """The ordered rules that mark bad rows; ends when a rule's precision on pruning rows is low."""
    third = np.arange(len(bad)) % 3 == 0
    left, rules = np.ones(len(bad), bool), []
    for _ in range(RULES):
        g, p = left & ~third, left & third
        if not bad[g].any():
            break
        rule = grow({k: v[g] for k, v in table.items()}, bad[g])
        if not rule:
            break
        rule, share = prune(rule, {k: v[p] for k, v in table.items()}, bad[p])
        if share < precision:
            break
        rules.append(rule)
        left &= ~covers(rule, table, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional expression: true keeps."""
    out = None
    for rule in rules:
        met = rule[0].column()
        for c in rule[1:]:
            met &= c.column()
        out = F.when(met, F.lit(False)) if out is None else out.when(met, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def train(measured: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list[Rule]:
    """Learns from at most size labelled rows; without any, the list is empty and keeps all.

    Of repeated rows of an id one counts, so an id with many rows doesn't fill the driver.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("labelled"), "labelled").limit(size)
    rows = measured.join(F.broadcast(known), F.col("doc_id") == F.col("labelled"))
    rows = rows.groupBy("labelled").agg(F.min(F.struct(*RATIOS)).alias("x"), F.min("quality").alias("quality"))
    found = rows.orderBy(F.xxhash64("labelled"), "labelled").select("x.*", "quality").toPandas()
    return learn({c: found[c].to_numpy(float) for c in RATIOS}, found["quality"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept) of every row.

    A null text counts as empty (it fails the base rule), a null doc_id stays null, repeated
    rows give repeated rows; very long texts are measured whole; other columns are ignored. A
    statistic that equals a threshold counts as above it. An empty table gives an empty table.
    """
    measured = common.stored(measure(docs), "quality-statistics")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = F.when(failed, F.lit(False)).otherwise(verdict(train(measured, labels)))
    return measured.select("doc_id", *COUNTS, failed.alias("base_failed"), kept.alias("kept"))
