"""The pipeline on a small input: each stage's decisions take effect, clean documents stay."""

import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from mnemospark.llm import common, simhash
from pyspark.sql import functions as F

from .test_operators import removed_plainly

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


def shingles(text, n=5):
    words = text.lower().split()
    return frozenset(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def near_pairs(texts, least=0.8):
    """All pairs of ids whose texts are near copies."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common_count = defaultdict(int)
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common_count[min(a, b), max(a, b)] += 1
    return {p for p, n in common_count.items() if n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


def groups(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted(pairs):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_stages(spark):
    docs = common.documents(spark, SF)
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    marked = {r["doc_id"]: r["toxic"] for r in common.labels(spark, SF).collect()}
    clean = common.stored(STAGES["toxicity"](spark, docs, SF), "t1")
    ids = {r["doc_id"] for r in clean.collect()}
    assert sum(marked[i] == 0 for i in ids if i in marked) >= 0.99 * sum(1 - t for t in marked.values())
    assert clean.columns == columns
    single = common.stored(STAGES["simhash_near_dedup"](spark, clean, SF), "t2")
    kept = {r["doc_id"] for r in single.collect()}
    expected = groups(ids, near_pairs({i: before[i] for i in ids}))
    # Nothing goes but near copies of what stays; few near copies are missed, no exact one.
    assert kept >= set(expected.values())
    assert len(kept - set(expected.values())) <= 0.1 * sum(i != g for i, g in expected.items())
    texts = [before[i] for i in kept]
    assert len(texts) == len(set(texts))
    sample = single.filter("doc_id < 120")
    cut = {r["doc_id"]: r for r in STAGES["suffix_array_dedup"](spark, sample, SF).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in sample.collect())
    for (i, _), (n, gone, _, _) in zip(rows, removed_plainly([t for _, t in rows]), strict=True):
        assert (i in cut) == (gone < n or n == 0)
        if i in cut:
            assert n - gone - 8 <= len(cut[i]["text"].encode()) <= n - gone and cut[i]["n_chars"] == len(cut[i]["text"])
    masked = STAGES["secret_scan"](spark, single, SF)
    assert masked.columns == columns and masked.filter("text LIKE '%[SECRET]%'").count() > 0
    assert STAGES["best_fit_packing"](spark, sample, SF).select("doc_id").distinct().count() == sample.count()


def test_odd_rows(spark):
    """One of repeated rows and one of the texts without words stay; rows without an id are judged, too."""
    rows = [(1, "a b c", "en", "s", 3), (1, "a b c", "en", "s", 3), (None, None, None, None, None), (None, "x", "en", "s", 1), (3, "", "en", "s", 0), (None, "A b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF), "odd")
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1, 3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


#: Names that the stages use for columns of their own.
CLASHES = "rid row text_ spans score toxicity_score kept kept_id kept_text n_removed n_bytes n_spans cut_id least fp key rules row_key found_key at runs packed open labelled y length piece".split()


@pytest.mark.parametrize("stage", [k for k in STAGES if k != "best_fit_packing"])
def test_columns_of_any_name_pass_whole(spark, stage):
    texts = ["plain words of no harm, one two three", "token=abcdef123456 and more", "", "q" * 5_000_000, "é" * 70 + "unique tail"]
    rows = [(i, t, 7, *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    out = STAGES[stage](spark, docs, SF)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(range(5)) and all(got[i][c] == f"{c}{i}" for i in got for c in CLASHES)
    assert STAGES[stage](spark, docs.limit(0), SF).count() == 0


def test_near_copies_of_five_words_go(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for i in range(30):
        base = rng.choices(words, k=150)
        copy, half = list(base), base[:75] + rng.choices(words, k=75)
        copy[40] = copy[41] = "changed"
        rows += [(i, " ".join(base)), (100 + i, " ".join(copy)), (200 + i, " ".join(half))]
    docs = spark.createDataFrame([*rows, (300, rows[0][1]), (None, rows[0][1]), (None, "alone without an id")], "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SF).collect()]
    assert {i for i in kept if i is not None} >= {*range(30), *range(200, 230)} and kept.count(None) == 1 and 300 not in kept
    assert sum(100 <= i < 130 for i in kept if i is not None) <= 3


def test_copies_without_words_are_one_group(spark):
    docs = spark.createDataFrame([(4, " "), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, SF).select("doc_id", F.length("text")).collect()] == [(2, 0)]


def flipped(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("seed", range(3))
def test_leaders_by_all_pairs(seed):
    """Strangers in a bucket hide no pair; a chain of batches finds what one batch does."""
    rng = random.Random(seed)
    rows = []
    for variant in range(40):
        base = rng.getrandbits(64)
        near = [flipped(rng, base, rng.randrange(1, 5)) for _ in range(rng.randrange(6))]
        rows += [(variant, simhash.signed(x)) for x in {base, *near, *(rng.getrandbits(64) for _ in range(rng.randrange(8)))}]
    rows.sort()
    v, fp = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    links = set()
    for step in (len(v), 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + step]) for x in (v, fp)], ["variant", "fp"]) for i in range(0, len(v), step)]
        found = {tuple(p) for b in simhash.buckets(batches) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= simhash.REACH for a, b in found)
        reached = groups(fp.tolist(), found)
        for g in range(40):
            own = fp[v == g].tolist()
            for a in own:
                near = [b for b in own if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.REACH]
                assert not near or any(reached[a] == reached[b] for b in near)
        links = links or found
    assert len(links) > 40


def test_buckets_hold_few_strangers():
    for texts in (10**4, 10**6, 10**9, 5 * 10**10):
        assert simhash.strangers(texts, simhash.blocks_for(texts)) <= simhash.STRANGERS
    assert simhash.blocks_for(10**6) == 3 and simhash.blocks_for(5 * 10**10) == 4


@pytest.mark.parametrize(("bits", "least"), [(4, 1.0), (8, 0.75)])
def test_links_among_many_strangers(spark, bits, least):
    """Planted pairs are found as often among 50,000 strangers as alone."""
    rng = random.Random(bits)
    planted = [(x, flipped(rng, x, bits)) for x in (rng.getrandbits(64) for _ in range(150))]
    rows = [(simhash.signed(x),) for pair in planted for x in pair]
    alone = {tuple(r) for r in simhash.far_links(spark.createDataFrame(rows, "fp long")).collect()}
    crowd = spark.createDataFrame(rows, "fp long").unionByName(spark.range(50_000).select(F.xxhash64("id").alias("fp")))
    among = {tuple(r) for r in simhash.far_links(crowd).collect()}
    sought = {tuple(sorted(map(simhash.signed, p))) for p in planted}
    assert len(sought & alone) >= least * 150 and sought & alone == sought & among


def test_links_do_not_depend_on_the_size_of_the_input(spark, monkeypatch):
    """A pair that only keys of three blocks find is found whatever a bucket may hold."""
    rng = random.Random(5)
    planted = [(x, flipped(rng, x, 7)) for x in (rng.getrandbits(64) for _ in range(100))]
    fps = spark.createDataFrame([(simhash.signed(x),) for pair in planted for x in pair], "fp long")
    few = {tuple(r) for r in simhash.far_links(fps).collect()}
    monkeypatch.setattr(simhash, "STRANGERS", 0)
    assert {tuple(r) for r in simhash.far_links(fps).collect()} == few and len(few) > 50


def test_parities_rule_out_only_what_is_unlike():
    """Texts of one hot group: close fingerprints, but few pairs with the similarity that is asked for."""
    rng, rows, sets = random.Random(6), [], {}
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    for _ in range(400):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 12)):
            words[at] = f"x{rng.randrange(10**6)}"
        text = " ".join(words)
        fp = simhash.signed(simhash.fingerprint(text.encode()))
        sets[fp] = simhash.shingles(text, 5)
    for fp, hashes in sets.items():
        rows += [(m & fp, fp, *simhash.parities(hashes)) for m in map(simhash.signed, simhash.block_masks()[:5])]
    rows.sort()
    columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
    for size in (len(rows), 97):
        batches = lambda k, size=size: [pa.RecordBatch.from_arrays(columns[:k], list("vfnst")[:k]).slice(i, size) for i in range(0, len(rows), size)]
        every = {p for b in simhash.buckets(batches(2)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        told = {tuple(p[:2]): p[2] for b in simhash.buckets(batches(5), 0.8) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        alike = {p for p in every if simhash.similarity(sets[p[0]], sets[p[1]]) >= 0.8}
        least = {b: min(a for a, x in every if x == b) for _, b in every}
        assert alike and alike <= {p for p, like in told.items() if like} <= every
        assert {(a, b) for b, a in least.items()} <= set(told)
        assert sum(told.values()) < len(alike) + (len(every) - len(alike)) / 2
