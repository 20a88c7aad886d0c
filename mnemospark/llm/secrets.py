"""Secret scans: a trigram index proposes the texts of each rule, expressions verify them.

DataFrame functions only. Rules whose expression has no mandatory trigram scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, trigrams


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: what a match is; group, least: the part whose length must reach least.

    hint: an expression that every text with such a match matches, where it tells more than pattern.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""


#: The three kinds of the contract.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
)
#: Further kinds, by the published shapes of such tokens.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 0, 39),
)
RULES = BASE + MORE
MASK = "[SECRET]"
#: Spans of a piece of text that is masked at once.
PIECE = 64
#: Matches of a rule in a text from which on they are placed in blocks.
BLOCKS = 64
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def spans_of(rule: Rule, rank: int, text: Column) -> Column:
    """array<struct<start, rank, end, kind>> of a rule's matches, leftmost and not overlapping.

    Offsets count code points. The text between matches and the matches alternate, so their
    lengths add up to the offsets.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    sizes = F.arrays_zip(
        F.transform(F.slice(between, 1, F.size(whole)), F.length).alias("gap"),
        F.transform(whole, F.length).alias("size"),
        F.transform(part, F.length).alias("part"),
    )

    zero = F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(x["part"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((start + x["size"]).alias("at"), kept.alias("out"))

    def fold(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])

    def folded(x: Column) -> Column:
        # In blocks of the root of the matches, as an array is copied whenever it grows.
        n = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(x, k * n + 1, n))
        size = lambda block: F.aggregate(block, zero, lambda acc, y: acc + y["gap"] + y["size"])
        starts = F.aggregate(F.transform(blocks, size), F.array(zero), lambda acc, y: F.concat(acc, F.array(F.element_at(acc, -1) + y)))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), F.slice(starts, 1, n).alias("at")), lambda b: fold(b["block"], b["at"])))

    return F.transform(F.array(sizes), lambda x: F.when(F.size(x) == 0, F.array().cast(SPANS)).when(F.size(x) < BLOCKS, fold(x, zero)).otherwise(folded(x)))[0]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, text, spans) of every row of docs: row is a struct of all columns but text, so no
    name clashes; spans: array<struct<start, rank, end, kind>>, by start, then rule.

    A null text counts as empty, has no span and stays null. Repeated rows are scanned each,
    texts of any length whole. Spans of different rules may overlap; ties in start are in the
    order of the rules. An empty table gives an empty table.
    """
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row"), "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumn("row_key", F.xxhash64("row.doc_id", text))
    queries = [trigrams.query(r.pattern) for r in rules]
    # Stored, so that its size is known before texts move: where it is small it goes to them.
    found = common.stored(trigrams.candidates(rows.select("row_key", text.alias("text")), queries).withColumnRenamed("row_key", "found_key"), "secret-candidates")
    joined = rows.join(found, F.col("row_key") == F.col("found_key"), "left")
    parts = []
    for k, (rule, q) in enumerate(zip(rules, queries, strict=True)):
        proposed = F.lit(True) if q is True else F.coalesce(F.col("rules").bitwiseAND(F.lit(1 << k)), F.lit(0)) != 0
        parts.append(F.when(proposed & text.rlike(rule.hint or rule.pattern), spans_of(rule, k, text)).otherwise(F.array().cast(SPANS)))
    return joined.select("row", "text", F.array_sort(F.concat(*parts)).alias("spans"))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(scanned: DataFrame) -> DataFrame:
    """The digests of the query."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(k: int, kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long").alias(f"n_{kind}")

    counts = [count(k, r.kind) for k, r in enumerate(BASE)]
    return scanned.select(F.col("row.doc_id").cast("long").alias("doc_id"), *counts, F.sha2(F.encode(shown(base), "UTF-8"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of the text replaced by MASK (overlapping ones by one); columns stay.

    A text of many spans is cut into pieces that hold about PIECE of them each, and a piece is
    put together on its own, so that time grows with the text. A null text stays null, repeated
    rows are masked each, an empty table gives an empty table.
    """
    pieces = F.greatest(F.ceil(F.size("spans") / PIECE), F.lit(1))
    size = F.greatest(F.ceil(F.length("text") / pieces), F.lit(1))
    cut = F.regexp_extract_all("text", F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))

    def masked(x: Column) -> Column:
        """x: a piece's text, its place lo and the place hi that follows it."""

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(x["text"], (acc["at"] - x["lo"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
            # A span that starts inside the one before lengthens it.
            put = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), put.alias("out"))

        def last(acc: Column) -> Column:
            rest = F.substring(x["text"], (acc["at"] - x["lo"] + 1).cast("int"), F.length(x["text"]))
            return F.concat(acc["out"], F.when(acc["at"] < x["hi"], rest).otherwise(F.lit("")))

        before = F.array_max(F.transform(F.filter("spans", lambda s: s["start"] < x["lo"]), lambda s: s["end"]))
        start = F.struct(F.greatest(before, x["lo"]).alias("at"), F.lit("").alias("out"))  # null is passed over
        return F.aggregate(F.filter("spans", lambda s: (s["start"] >= x["lo"]) & (s["start"] < x["hi"])), start, step, last)

    placed = F.transform(cut, lambda t, k: F.struct(t.alias("text"), (k * size).cast("long").alias("lo"), (k * size + F.length(t)).cast("long").alias("hi")))
    whole = F.when(F.size("spans") > 0, F.array_join(F.transform(placed, masked), "")).otherwise(F.col("text"))
    return common.in_order(scan(docs, rules), docs.columns, whole)


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the query, from the same rules, without the index."""
    lists = []
    for k, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        lists.append(
            f"""(SELECT coalesce(list({{'s': s, 'k': {k}, 'e': s + n, 'v': '{r.kind}'}}), []) FROM (
              SELECT CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
                length(m[i]) AS n, length(v[i]) AS part FROM (
                SELECT regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS v, string_split_regex(t, '{p}') AS g), unnest(range(1, len(m) + 1)) AS u(i)
            ) WHERE part >= {r.least})"""
        )
    base = len(BASE)
    shown_sql = "array_to_string(list_transform({}, lambda x: x.v || ':' || x.s || ':' || x.e), ',')"
    counts = ", ".join(f"CAST(len(list_filter(spans, lambda x: x.k = {k})) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      f AS (SELECT doc_id, list_sort({' || '.join(lists)}) AS spans FROM d)
      SELECT doc_id, {counts}, sha256({shown_sql.format(f'list_filter(spans, lambda x: x.k < {base})')}) AS base_sha256, {shown_sql.format('spans')} AS spans FROM f"""
