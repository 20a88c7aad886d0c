"""Deobfuscation against all paths of the lattice, and masking of very many secrets."""

import itertools
import random
import time

import numpy as np
import pytest

from mnemospark.llm import common, noisy, secrets, toxicity


@pytest.fixture(scope="module")
def cost(spark):
    return toxicity.character_costs(common.documents(spark, "/root/testdata/sf0.01"))


def all_paths(word, cost):
    """The least cost of every text that some combination of a word's signs stands for."""
    out = {}
    for path in itertools.product(*noisy.lattice(word)):
        a = b = noisy.EDGE
        total, text = 0.0, ""
        for extra, put in path:
            total += extra
            for k in put:
                total += cost[a, b, k]
                a, b, text = b, k, text + (chr(97 + k) if k < 26 else "?")
        total += cost[a, b, noisy.EDGE]
        out[text] = min(total, out.get(text, np.inf))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_viterbi_is_the_best_of_all_paths(cost, seed):
    rng = random.Random(seed)
    for _ in range(120):
        word = "".join(rng.choice("aeiostr1034@$!*.-7éz") for _ in range(rng.randrange(9)))
        paths = all_paths(word, cost)
        assert paths[noisy.restore(word, cost)] == pytest.approx(min(paths.values()), abs=1e-9)


@pytest.mark.parametrize("text", ["hello,1d10t", "stone/1d10t/river", "well...1d10t", "1d10t,hello", "x:1d10t", "a_1d10t", "hello,1d10t," * 4, "(1d10t)", "so;idiooot;then"])
def test_words_joined_by_signs_are_restored(cost, text):
    assert "idiot" in noisy.Restorer(cost).words(text)


def test_plain_words_bring_nothing_new(cost):
    assert noisy.Restorer(cost).words("river,stone well.then") >= {"river", "stone", "well", "then"}
    assert noisy.parts("river,stone")[0] == ["river,stone"]


def masked_plainly(text, spans):
    out, at = "", 0
    for s in spans:
        if s["start"] >= at:
            out += text[at : s["start"]] + secrets.MASK
        at = max(at, s["end"])
    return out + text[at:]


def test_masking_by_a_plain_loop(spark):
    rng = random.Random(4)
    rows = []
    for i in range(12):
        bits = [rng.choice(["token=abcdef1234", "AKIA" + "X" * 20, "é" * 5, "\n", "password: 0123456789abcdef0123456789abcdef", "中文 ", "𝄞", "plain words "]) + rng.choice(["", " ", "\n"]) for _ in range(rng.choice([3, 70, 400]))]
        rows.append((i, "".join(bits)))
    docs = spark.createDataFrame([*rows, (50, None), (51, ""), (52, "none")], "doc_id long, text string")
    spans = {r["row"]["doc_id"]: (r["text"], r["spans"]) for r in secrets.scan(docs).collect()}
    for r in secrets.redact(docs).collect():
        text, found = spans[r["doc_id"]]
        assert r["text"] == (None if text is None else masked_plainly(text, found))


def test_masking_time_grows_with_the_text(spark):
    def took(n):
        docs = spark.createDataFrame([(1, " and some words between them ".join(["token=abcdef123456"] * n))], "doc_id long, text string")
        began = time.perf_counter()
        masked = secrets.redact(docs).first()["text"]
        assert masked.count(secrets.MASK) == n
        return time.perf_counter() - began

    took(50)
    assert took(20_000) < 2.5 * took(2000) + 2
