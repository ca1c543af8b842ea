"""Chosen-path join, whitening and ranked search."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from intervale.llm import chosen_path, oracles, ranked_search, whitening

from .conftest import DOCS, rows


def word_sets(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def classes_by_hand(texts, part=17, whole=20):
    sets, up = word_sets(texts), list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and whole * common >= part * (len(a) + len(sets[j]) - common):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(texts))]


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice(([f"new{rng.random()}"], [], [words[at], f"more{rng.random()}"]))
    return " ".join(words)


def near_texts(rng):
    """Groups of near copies of all sizes, a star whose copies are not similar to each other, and a shared passage."""
    texts = []
    for n in (1, 3, 5, 7, 12, 40, 150, 600):
        base = [f"b{n}-{rng.randrange(500)}" for _ in range(n)]
        texts += [" ".join(base), " ".join(base).upper(), *(edited(rng, base, k) for k in (1, 2, 3, n // 60 + 1, n // 40 + 1, n // 25 + 1))]
    large = [f"g{i}" for i in range(200)]
    texts += [edited(rng, large, rng.randrange(1, 8)) for _ in range(150)]
    passage = [f"p{i}" for i in range(90)]
    texts += [" ".join(passage + [f"own{rng.random()}" for _ in range(rng.randrange(10, 60))]) for _ in range(80)]
    rng.shuffle(texts)
    return texts


def joined(spark, texts, **k):
    return {r.doc_id: r for r in chosen_path.near_duplicates(spark.createDataFrame(rows(texts), DOCS), **k).collect()}


def test_chosen_path_against_brute_force(spark, odd_texts, smallest, no_docs):
    texts = odd_texts + [r.text for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()] + near_texts(random.Random(5))
    sets, want = classes_by_hand(texts)
    assert len(set(want)) < len(texts) - 50
    got = joined(spark, texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i)
    assert chosen_path.near_duplicates(no_docs).count() == 0


def test_chosen_path_branches_large_nodes(spark, monkeypatch):
    """With few open pairs to a node, large groups meet hubs, branch, and end in blocks."""
    rng = random.Random(8)
    large = [f"g{i}" for i in range(120)]
    star = [edited(rng, large, rng.randrange(1, 6)) for _ in range(120)]
    half = [" ".join(large[:60] + [f"own{rng.random()}" for _ in range(60)]) for _ in range(60)]
    texts = star + half + near_texts(rng)
    _, want = classes_by_hand(texts)
    calls = []
    branch = chosen_path.Join.branch
    monkeypatch.setattr(chosen_path.Join, "branch", lambda self, rows, depth: calls.append(depth) or branch(self, rows, depth))
    for setting in ({"OPEN": 40, "BLOCK": 16}, {"OPEN": 12, "DENSE": 60, "DEPTH": 3}):
        for name, value in setting.items():
            monkeypatch.setattr(chosen_path, name, value)
        got = joined(spark, texts)
        assert [got[i].component_id for i in range(len(texts))] == want
    assert calls.count(1) == 2 and 2 in calls


def test_chosen_path_repeats_and_nulls(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    made = [(7, one), (7, two), (3, two.upper()), (None, one), (None, "null only here"), (5, None), (6, " "), (7, one)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "x", 0.5, "y", "z") for i, t in made], DOCS)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_duplicates(docs).collect())
    assert got == Counter({(7, 26, 7, True): 2, (7, 26, 3, False): 1, (3, 26, 3, True): 1, (None, 26, 7, False): 1, (None, 1, None, True): 1, (5, 0, 5, True): 1, (6, 0, 6, True): 1})


def shared_paragraphs(spark, n):
    """Documents of ten out of forty paragraphs; few are similar."""
    rng = random.Random(n)
    paragraphs = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    texts = ["\n".join(rng.sample(paragraphs, 10)) for _ in range(n)]
    return spark.createDataFrame(rows(texts), DOCS)


def test_shared_paragraphs_lead_to_few_comparisons(spark):
    verified = []
    for n in (1000, 2000):
        join = chosen_path.Join(shared_paragraphs(spark, n), (4, 5))
        seen = []
        whole = join.verified
        join.verified = lambda pairs, n: seen.append(n) or whole(pairs, n)
        join.links()
        verified.append(sum(seen))
    assert verified[1] < 2000


def below_threshold(n):
    """Edits of one text, most pairs of which are a little less similar than the threshold."""
    rng, base, texts = random.Random(n), [f"g{i}" for i in range(200)], []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(200), 3):
            words[at] = f"new{rng.random()}"
        texts.append(" ".join(words))
    return texts


def test_near_candidates_make_no_rows(spark, monkeypatch):
    """Pairs that only the sketches let through are refused where they meet; units by weight find the same links."""
    made = []
    stored = chosen_path.materialize

    def counted(df, name):
        made.append((stored(df, name), name))
        return made[-1][0]

    monkeypatch.setattr(chosen_path, "materialize", counted)
    texts = below_threshold(300)
    sets, want = classes_by_hand(texts)
    assert len(set(want)) > 20 and len(set(want)) < len(texts)
    assert sum(17 * (len(a) + len(b)) > 37 * len(a & b) for i, a in enumerate(sets) for b in sets[:i]) > 30_000
    for held in (chosen_path.HELD, 3000):
        monkeypatch.setattr(chosen_path, "HELD", held)
        made.clear()
        got = joined(spark, texts)
        assert [got[i].component_id for i in range(len(texts))] == want
        rows = {name: sum(df.count() for df, n in made if n == name) for name in ("found", "pairs", "links", "confirmed")}
        assert max(rows.values()) < 20 * len(texts), rows


def test_recall_of_trees():
    """The chance of a miss, by drawing paths of pairs at the threshold."""
    rng = np.random.default_rng(3)
    assert chosen_path.missed(0.85) == pytest.approx(0.0311, abs=1e-3)
    assert chosen_path.trees_for(0.85, 0.99999) == 4

    def lives(depth):
        return depth == 0 or any(rng.random() < 0.85 and lives(depth - 1) for _ in range(2))

    assert np.mean([not lives(6) for _ in range(4000)]) < 0.045


def test_chosen_path_against_sql(spark, smallest):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{smallest}/documents.parquet'")
    got = chosen_path.near_duplicates(spark.read.parquet(f"{smallest}/documents.parquet"))
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {columns} FROM ({oracles.oracle_sql()['op12_chosen_path']})").fetchall())


def whiten_by_hand(vectors, components=4):
    """(vec_id, x, deviation, whitened) by numpy on whole numbers of any size, up to signs."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    order = order[values[order] > 1e-12 * values.sum()]
    out = []
    for i, x in kept:
        d = np.array(x, object) * n - s
        out.append((i, int((d * d).sum()), (d.astype(float) / n) @ axes[:, order] / np.sqrt(values[order])))
    return n, out, values[order] / values.sum()


def embedded(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in vectors], "vec_id long, embedding array<float>, label int, n string, whitened double")


def check_whitened(spark, vectors):
    n, want, explained = whiten_by_hand(vectors)
    got = whitening.whitened(spark, embedded(spark, vectors)).collect()
    k = len(explained)
    by = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-6
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-6)
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    assert len(got) == k * len(want)
    signs = None
    for i, deviation, values in want:
        rows_ = sorted(by[i, deviation], key=lambda r: r.component)
        assert {r.component for r in rows_} == set(range(1, k + 1))
        mine = np.array([r.whitened for r in rows_[:: len(rows_) // k]])
        if signs is None and np.abs(values).min() > 1e-3:
            signs = np.sign(values * mine)
        if signs is not None and len(rows_) == k:
            assert mine * signs == pytest.approx(values, abs=1e-6)
    assert signs is not None


def test_whitening_against_numpy(spark, smallest):
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(200, 8)) @ rng.normal(size=(8, 8))
    vectors = [(i, v.tolist()) for i, v in enumerate(mixed)]
    vectors += [(300, None), (301, []), (302, [0.0] * 7 + [None]), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (305, [-0.0] * 8), (306, vectors[0][1]), (306, vectors[0][1]), (307, vectors[1][1])]
    check_whitened(spark, vectors)
    check_whitened(spark, [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{smallest}/embeddings.parquet").collect()])
    check_whitened(spark, [(i, [3.0 * (i % 7), 1.0, 2.0]) for i in range(30)])  # one direction only


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened(spark, embedded(spark, [])).count() == 0
    assert whitening.whitened(spark, embedded(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    lengths = [(1, [1.0]), (2, [2.0]), (None, [4.0]), (4, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [0.0, 0.5])]
    got = whitening.whitened(spark, embedded(spark, lengths)).collect()
    assert Counter((r.vec_id, r.n) for r in got) == Counter({(1, 3): 1, (2, 3): 1, (None, 3): 1, (4, 3): 2, (5, 3): 2, (6, 3): 2})
    huge = whitening.whitened(spark, embedded(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 9.0])])).collect()
    assert huge and all(r.deviation is None for r in huge if r.vec_id != 3)


def ranked_by_hand(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    total, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 25 + (75 * sum(c.values()) * total) // length
            if s := sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in split(text) if c[w]):
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_search_against_brute_force(spark, odd_texts, smallest, no_docs, monkeypatch):
    monkeypatch.setattr(ranked_search, "CLUSTER", 24)
    monkeypatch.setattr(ranked_search, "POSTINGS", 2000)
    monkeypatch.setattr(ranked_search, "VISITS", 3)
    texts = odd_texts + [r.text for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()] + ["tie words here"] * 30
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{smallest}/benchmark.parquet").collect()]
    bench += [(901, None), (902, ""), (903, "tie TIE words"), (904, "nowhere-to-be-found"), (905, "日本語 Größe İstanbul été"), (906, texts[-40])]
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in bench + bench[:2]], "item_id long, text string, doc_id string, rank int")
    docs = spark.createDataFrame(rows(texts), DOCS)
    search = ranked_search.Search(ranked_search.Index(docs), items)
    assert sorted(map(tuple, search.run().collect())) == ranked_by_hand(list(enumerate(texts)), bench)
    assert 0 < search.visited() < 1
    assert search.index.rows.count() > 8
    assert ranked_search.search(no_docs, items).count() == 0 == ranked_search.search(docs, items.limit(0)).count()


def test_search_prunes_topics(spark, monkeypatch):
    """On documents of separate topics the reordering parts them, and few clusters are opened."""
    monkeypatch.setattr(ranked_search, "CLUSTER", 32)
    rng = random.Random(4)
    texts = [" ".join(f"topic{i % 16}w{rng.randrange(40)}" for _ in range(30)) for i in range(1024)]
    docs = spark.createDataFrame(rows(texts), DOCS)
    asked = [(i, " ".join(texts[i].split()[:8])) for i in range(0, 64)]
    search = ranked_search.Search(ranked_search.Index(docs), spark.createDataFrame(asked, "item_id long, text string"))
    assert sorted(map(tuple, search.run().collect())) == ranked_by_hand(list(enumerate(texts)), asked)
    assert search.reach.count() < 0.1 * 64 * search.index.rows.count()


def test_search_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "red fox", "en", "a", 0, "x", 0.5, "y", "z"), (1, "red fox", "en", "a", 0, "x", 0.5, "y", "z"), (None, "red fox", "en", "a", 0, "x", 0.5, "y", "z"), (4, "dog", "en", "a", 0, "x", 0.5, "y", "z")], DOCS)
    items = spark.createDataFrame([(1, "fox"), (None, "fox"), (2, "red dog")], "item_id long, text string")
    got = [(r.item_id, r["rank"], r.doc_id) for r in ranked_search.search(docs, items).orderBy("item_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 1), (1, 3, None), (2, 1, 4), (2, 2, 1), (2, 3, 1), (2, 4, None)]


def test_bisection_parts_two_topics():
    topic = np.random.default_rng(1).permutation(np.arange(40) % 2)
    words = np.array([w for t in topic for w in ([0, 1, 2] if t else [3, 4, 5])])
    ends = np.arange(0, len(words) + 1, 3)
    right, a, b = ranked_search.bisect(ends, words, 6)
    assert len(set(right[topic == 0])) == 1 == len(set(right[topic == 1]))
    assert sorted([a[0], b[0]]) == [0, 20]
    order = ranked_search.reordered(ends, words)
    assert sorted(order.tolist()) == list(range(40)) and len(set(topic[order[:20]])) == 1


def test_search_against_sql(spark, smallest):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{smallest}/{t}.parquet'")
    got = ranked_search.search(*(spark.read.parquet(f"{smallest}/{t}.parquet") for t in ("documents", "benchmark")))
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {columns} FROM ({oracles.oracle_sql()['op13_ranked_search']})").fetchall())
