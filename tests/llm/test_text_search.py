"""Phrase collocations, main text of pages and ranked search against brute force."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from mnemospark.llm import collocations, lexical, pages, queries

SF = "/root/testdata/sf0.001"
ODD = ("f", "key", "phrase", "phrases", "bucket", "rank", "a", "l", "r", "n", "k", "score", "words", "cut", "row", "rid", "qid", "ids", "tfs", "terms", "part")


def documents(spark, rows):
    """doc_id, text, lang, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, *["x"] * len(ODD)) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in ODD)).repartition(3)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- collocations --------------------------------------------------------------------------------


def phrases_of(rows, most=3):
    counts, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return counts, total


def plain_collocations(rows, most=3, least=10, first=2000):
    counts, total = phrases_of(rows, most)
    out = []
    for lang in total:
        found = []
        own = {p: c for (x, p), c in counts.items() if x == lang and len(p) > 1 and c >= least}
        for p, a in own.items():
            score, k = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            within = any(len(q) > len(p) and 100 * c >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in own.items())
            if not within:
                found.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    words = ["The", "of", "new", "york", "city", "été", "ZÉ", "a", " x", "ß", "run-of-the-mill", "中", "1", "\x1c"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "! ", ".", "\r\n"]) for _ in range(rng.randrange(40)))
        out.append((i, text + " New York City hall." * rng.randrange(3), rng.choice(["en", "en", "en", "de", None, "a.b", ""])))
    return [*out, (900, None, "en"), (901, "", "fr"), (902, " ., \n", "fr"), (903, "tie tie " * 3000, "en"), (None, "new york " * 12, None), (None, "new york " * 12, None), out[3]]


FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("bucket", "fan", "most", "first"), [(2 << 20, 1024, 3, 2000), (200, 4, 3, 7), (1000, 1024, 4, 2000)])
def test_collocations(spark, monkeypatch, bucket, fan, most, first):
    """Also with many small buckets, which takes a second deal, and with longer phrases."""
    monkeypatch.setattr(collocations, "BUCKET", bucket)
    monkeypatch.setattr(collocations, "FAN", fan)
    rows = corpus()
    got = sorted(tuple(r[c] for c in FIELDS) for r in collocations.collocations(documents(spark, rows), most, 10, first).collect())
    assert got == plain_collocations(rows, most, 10, first) and len(got) >= 8


def test_collocations_of_nothing(spark):
    for rows in ([], [(1, None, None), (2, " .", "en")]):
        assert collocations.collocations(documents(spark, rows)).collect() == []


def test_large_counts_score_exactly(spark):
    """Products pass 64 bits: the score is floored as integers are."""
    a, l, r = 3_037_000_500_123, 3_037_000_500_999, 9_007_199_254_740_993
    got = spark.sql(f"SELECT (1000000BD * a * a) div (l * r) AS s FROM (SELECT CAST({a} AS DECIMAL(19,0)) a, CAST({l} AS DECIMAL(19,0)) l, CAST({r} AS DECIMAL(19,0)) r)").first()["s"]
    assert got == 10**6 * a * a // (l * r)


def online(pieces, depth):
    """End positions of every phrase up to depth, by the usual online construction, cut there."""
    nxt, link, length, ends = [{}], [-1], [0], [set()]

    def state(n):
        nxt.append({})
        link.append(0)
        length.append(n)
        ends.append(set())
        return len(nxt) - 1

    place = 0
    for piece in pieces:
        last = 0
        for w in piece:
            if w in nxt[last] and length[nxt[last][w]] == length[last] + 1:
                last = nxt[last][w]
            else:
                cur, p = state(length[last] + 1), last
                clone_only = w in nxt[last]
                if clone_only:
                    q = nxt[last][w]
                    cur_is = state(length[last] + 1)
                    nxt[cur_is], link[cur_is], link[q], ends[cur_is] = dict(nxt[q]), link[q], cur_is, set(ends[q])
                    while p >= 0 and nxt[p].get(w) == q:
                        nxt[p][w] = cur_is
                        p = link[p]
                    last = cur_is
                else:
                    while p >= 0 and w not in nxt[p]:
                        nxt[p][w] = cur
                        p = link[p]
                    if p < 0:
                        link[cur] = 0
                    else:
                        q = nxt[p][w]
                        if length[q] == length[p] + 1:
                            link[cur] = q
                        else:
                            copy = state(length[p] + 1)
                            nxt[copy], link[copy], ends[copy] = dict(nxt[q]), link[q], set(ends[q])
                            while p >= 0 and nxt[p].get(w) == q:
                                nxt[p][w] = copy
                                p = link[p]
                            link[q] = link[cur] = copy
                    last = cur
            v = last
            while v > 0:
                ends[v].add(place)
                v = link[v]
            place += 1
        place += 1
    # Walk from the root: each phrase up to depth and the positions where it ends.
    out, todo = {}, [(0, ())]
    while todo:
        v, p = todo.pop()
        if len(p) < depth:
            for w, u in nxt[v].items():
                out[(*p, w)] = frozenset(ends[u])
                todo.append((u, (*p, w)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_automaton_has_the_states_of_the_online_one(seed):
    rng = random.Random(seed)
    pieces = [[rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(25)]
    words = np.array([x for p in pieces for x in (*p, -1)])
    a, phrases = collocations.automaton(words, 3), online(pieces, 3)
    # A state is a set of end positions; its longest phrase of the depth names it.
    classes = collections.defaultdict(list)
    for p, ends in phrases.items():
        classes[ends].append(p)
    got = {}
    for k, (end, length) in enumerate(zip(a.end, a.length, strict=True)):
        got[tuple(words[end - length + 1 : end + 1])] = k
    assert set(got) == {max(ps, key=len) for ps in classes.values()}
    for ends, ps in classes.items():
        longest = max(ps, key=len)
        k = got[longest]
        assert a.count[k] == len(ends)
        rest = [longest[i:] for i in range(1, len(longest)) if phrases[longest[i:]] != ends]
        assert a.link[k] == (got[max(classes[phrases[rest[0]]], key=len)] if rest else -1)
    found = {tuple(words[e - n + 1 : e + 1]): c for n, end, count in collocations.enumerated(a) for e, c in zip(end, count, strict=True)}
    assert found == {p: len(e) for p, e in phrases.items()}


# --- main text -----------------------------------------------------------------------------------

BODY = ["A first paragraph that is long enough to be the main text of a page, with some more words.", "The second one goes on at length about the very same matter, and adds to it &amp; ends here.", "Short."]
TEXT = [BODY[0], BODY[1].replace("&amp;", "&"), "Short."]
P = "".join(f"<p>{x}</p>" for x in BODY)
NOISE = '<div class="cookie-notice">We use cookies on this site, all of them long and crumbly, to bake you a better experience every day.</div>'
PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style><script>var x='</p><p>no</p>';</script></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1>{P}</article><footer>Foot of the page, with many words in it so that it is long enough to count.</footer></body></html>", ["Head", *TEXT]),
    (f"<body><div class=header><p>Site name and its long and winding motto, which is no text at all, but long.</p></div>{NOISE}<div id=main-content><h1>Head</h1>{P}</div><div class='sidebar'><p>{'More things to read. ' * 9}</p></div></body>", ["Head", *TEXT]),
    (f"<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><h2>Head</h2>{P}<p><a href=x>Next</a><p><a href=y>Last</a><p><a href=z>Top</a></body>", ["Head", *TEXT]),
    (f"<article>{P}<div class='comments'><p>{'I do not agree with that at all. ' * 8}</p></div><form><p>Write one</p><input></form><section id=comments><article class=comment>{'First! ' * 40}</article></section></article>", TEXT),
    (f"<main><article><header><h1>Head</h1><p class=byline>By Somebody</p></header><p>{BODY[0]}<aside>Related: {'x ' * 90}</aside><p>{BODY[1]}<div class=ad>Buy!</div><p>Short.</article></main>", ["Head", *TEXT]),
    ("<article><h1>I</h1><p>Go.</p></article><div class=ad>An advert that is much longer than the text of the page itself, as they often are.</div>", ["I", "Go."]),
    (f"<nav><ul><li>Left open<article>{P}</article>", TEXT),
    (f"<article><p>one<br>line<p>two<br><br>lines<b> bold</b>&nbsp;&#233;&copy;<!-- <p>no</p> --><p title='a > b'>quoted<table><tr><td>a<td>b<tr><td>c</table>{P}<pre> x\n  y </pre></article>", ["one line", "two", "lines bold é©", "quoted", "a b", "c", *TEXT, "x y"]),
    (f"<article>{P}<p>1 < 2 and a<b>c</b>, <a href=\"no end>x</a><p>after</article>", None),
    ("", []), ("<nav>only</nav><footer>these</footer>", []), ("just words without any markup", ["just words without any markup"]),
    (f"<body class='has-sidebar menu'><div class='page header'><article class='post comment-open'>{P}</article></div></body>", TEXT),
]


@pytest.mark.parametrize(("page", "expected"), PAGES)
def test_main_text(page, expected):
    got = pages.main_text(page)
    if expected is None:  # a broken quote loses no text after it
        assert got.split("\n")[:3] == TEXT and got.endswith("after")
    else:
        assert got == "\n".join(expected)


@pytest.mark.parametrize("seed", range(4))
def test_stretches_by_all_windows(seed):
    rng = random.Random(seed)
    for _ in range(200):
        weights = [rng.choice([0, 0, 0, 5, 40, 200]) for _ in range(rng.randrange(25))]
        at = [sum(weights[i : i + 3]) for i in range(len(weights))]
        bound = min(86, max(at, default=0) / 2)
        inside, expected = False, set()
        for i, s in enumerate(at):
            inside = (inside and s > 0) or (weights[i] > 0 and s > bound)
            expected |= {i} if inside else set()
        assert {i for a, b in pages.stretches(weights) for i in range(a, b)} == expected


def test_marked_pages_by_their_template():
    """All test pages against the element that their generator puts the text into."""
    import html

    for (page,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        body = page[page.index("<article>") : page.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>", body)]
        assert pages.main_text(page) == "\n".join(x for x in parts if x)


def test_extraction_of_a_table(spark):
    long = "<article>" + "<p>word word</p>" * 200_000 + "</article>"
    rows = [(1, "u", PAGES[0][0], "z"), (2, None, None, "z"), (None, "v", PAGES[1][0], None), (None, "v", PAGES[1][0], None), (3, "w", "", "z"), (4, "w", long, "z"), (5, "w", "<p " * 20000, "z"), (6, "w", '<a "' * 20000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = collections.Counter((r["page_id"], r["url"], r["text"]) for r in got.collect() if r["page_id"] not in (5, 6))
    assert found == collections.Counter((i, u, pages.main_text(h or "")) for i, u, h, _ in rows if i not in (5, 6))
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert pages.extract(df.limit(0)).collect() == []


# --- ranked search -------------------------------------------------------------------------------


def plain_search(docs, items, k=20):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))

    split = [(i, terms(t)) for i, t, _ in docs]
    number, total = sum(1 for _, ts in split if ts), sum(len(ts) for _, ts in split)
    df = collections.Counter(t for _, ts in split for t in set(ts))
    out = []
    for item, text in items:
        asked, scored = terms(text), []
        for place, (i, ts) in enumerate(split):
            tf, score = collections.Counter(ts), 0
            for t in asked:
                if tf[t]:
                    m = 75 + 25 * len(ts) * number // total
                    score += math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, place, i))
        out += [(item, rank, x[-1], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=20):
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, qid string")
    return sorted((tuple(r) for r in lexical.ranked(documents(spark, docs), asked, k).collect()), key=repr)


@pytest.mark.parametrize(("block", "k"), [(4 << 20, 20), (60, 3)])
def test_search(spark, monkeypatch, block, k):
    """Ties, repeats, nulls and both sides' odd rows; also with the queries in many blocks."""
    monkeypatch.setattr(lexical, "QUERY_BYTES", block)
    docs = corpus(2, 120)
    docs += [(500 + i, "same same text 中 x", "en") for i in range(30)]
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices(["the", "THE", "new", "york", "hall", "same", "tie", "x1", "été", "run", "of", "1"], k=rng.randrange(1, 9)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, " .,"), (23, "nowhere"), (None, "new york"), (7, "same"), (7, "same")]
    assert searched(spark, docs, items, k) == plain_search(docs, items, k)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a", "en")], []) == [] and searched(spark, [(1, None, "en")], [(1, "a")]) == []


def segment(rng, documents_, terms):
    rows = [(t, d, rng.choice([5, 5, 100, 1000, 40_000])) for t in range(terms) for d in range(documents_) if rng.random() < (0.9 if t == 0 else 0.2)]
    ids, docs, impact = (np.array(x) for x in zip(*rows, strict=True))
    return rows, lexical.Segment(ids, docs.astype(np.int32), impact, terms + 1)


@pytest.mark.parametrize("seed", range(5))
def test_treaps_and_their_walk(monkeypatch, seed):
    """Search order by document, heap order by impact; a walk in small blocks finds the first k of all scores."""
    monkeypatch.setattr(lexical, "RANGES", 3)
    rng = random.Random(seed)
    rows, s = segment(rng, 90, 5)

    def walk(node):
        if node < 0:
            return []
        for child in (s.left[node], s.right[node]):
            assert child < 0 or s.impact[child] <= s.impact[node]
        return [*walk(s.left[node]), int(s.docs[node]), *walk(s.right[node])]

    for t in range(5):
        assert walk(s.root[t]) == [d for x, d, _ in rows if x == t]
    assert s.root[5] == -1
    for k in (1, 7, 200):
        weights = np.array([rng.randrange(4) for _ in range(6)])
        scores = collections.Counter()
        for t, d, x in rows:
            scores[d] += x * int(weights[t])
        expected = sorted((-v, d) for d, v in scores.items() if v >= 1)[:k]
        found, docs = s.search(np.arange(6), weights, 90, k, 1)
        assert sorted((-int(v), int(d)) for v, d in zip(found, docs, strict=True))[:k] == expected


def test_lengths_without_overflow():
    n = np.array([0, 5, 4_000_000_000], np.int64)
    assert lexical.lengths(n, 10**13, 10**16).tolist() == [75 + 25 * x * 10**13 // 10**16 for x in n.tolist()]


def test_pruning_skips_documents(monkeypatch):
    """A rare heavy term decides: few of the frequent term's documents are looked at."""
    seen = []
    original = lexical.Segment.impacts
    monkeypatch.setattr(lexical.Segment, "impacts", lambda self, node, doc: seen.append(node.shape[1]) or original(self, node, doc))
    n = 20_000
    ids = np.concatenate([np.zeros(n, int), np.ones(30, int)])
    docs = np.concatenate([np.arange(n), np.arange(30) * 600]).astype(np.int32)
    impact = np.concatenate([np.random.default_rng(1).integers(400, 500, n), np.full(30, 900)])
    s = lexical.Segment(ids, docs, impact, 2)
    found, _ = s.search(np.array([0, 1]), np.array([100, 5000]), n, 20, 1)
    assert len(found) == 20 and sum(seen) < n / 10


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op13_lexical_search"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    expected = con.sql(queries.ORACLE_SQL[name])
    at = [expected.columns.index(c) for c in got.columns]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[k] for k in at) for r in expected.fetchall())
