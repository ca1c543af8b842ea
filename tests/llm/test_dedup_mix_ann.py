"""SimHash, components, line dedup, mixing and nearest neighbours."""

import random
import re
import time
from collections import defaultdict

import duckdb
import numpy as np
import xxhash
from intervale.llm import ann, common, line_dedup, mixing, oracles, simhash
from intervale.llm.components import connected
from pyspark.sql import functions as F

from .conftest import DOCS, rows


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, reach=2):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= reach):
            a, b = find(i), find(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_brute_force(spark, odd_texts, smallest, no_docs):
    base = " ".join(f"w{i}" for i in range(120))
    near = [base.replace(f"w{i}", "zz", 1) for i in (0, 60, 119)]
    texts = odd_texts + [base, base.upper(), *near] + ["dup dup dup"] * 5 + [r.text for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()]
    got = {r.doc_id: r for r in simhash.digests(simhash.near_duplicates(spark.createDataFrame(rows(texts), DOCS))).collect()}
    fps = np.array([fingerprint(t) for t in texts], np.uint64)
    roots = components(fps)
    for i in range(len(texts)):
        assert got[i].fingerprint == f"{int(fps[i]):016x}"
        assert got[i].component_id == roots[i]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_xxhash_is_sparks(spark):
    words = ["", "a", "the quick brown", "naïve 日本", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] & (2**64 - 1) for r in got] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


def test_shards_and_dense_balls_lose_no_link():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [c ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for c in centre for a, b in rng.integers(0, 63, (30, 2))]
    ball = [np.uint64(5) ^ np.uint64((1 << int(a)) | (1 << int(b)) | (1 << int(c))) for a, b, c in rng.integers(0, 63, (900, 3))]
    fps = np.unique(np.array([*centre, *flips, *ball, *rng.integers(0, 2**63, 800, dtype=np.uint64)], np.uint64))
    want = components(fps)
    for leaf, dense in ((16, 10_000), (256, 10_000), (64, 70), (8, 9)):
        assert simhash.linked(fps, 2, leaf, dense).tolist() == want
    tree = simhash.ShardTree(fps[::3], 16, 2)
    home = defaultdict(set)
    for shard, at in tree.route(fps):
        for i in at.tolist():
            home[i].add(shard)
    assert set(home) == set(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 2):
            assert home[i] & home[int(j)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000), (7, 3)]
    links += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    rng.shuffle(links)
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def lines_by_hand(docs, least=3):
    sites, first = defaultdict(set), {}
    order = sorted({(i, t or "", s) for i, t, s in docs if t is not None}, key=lambda x: (x[0], xxh(x[1])))
    for i, t, s in order:
        for k, line in enumerate(t.split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                sites[line].add(s)
                first.setdefault(line, (i, t, k))
    out = []
    for i, t, _ in docs:
        kept = [x for k, x in enumerate((t or "").split("\n")) if not (len(sites.get(x, ())) >= least and first[x] != (i, t, k))]
        out.append(None if t is None else "\n".join(kept))
    return out


def xxh(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def test_lines_against_brute_force(spark, odd_texts, no_docs):
    rng = random.Random(6)
    pool = [f"line number {i} of some pages" for i in range(30)] + ["", "  ", "x"]
    texts = odd_texts + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    made = rows(texts)
    made += [made[70], made[70], (999, made[71][1], *made[71][2:])]
    docs = spark.createDataFrame(made, DOCS)
    got = line_dedup.dedup_lines(docs)
    want = lines_by_hand([(r[0], r[1], r[3]) for r in made])
    assert sorted((r.doc_id, r.text or "", r.text is None) for r in got.collect()) == sorted((r[0], t or "", t is None) for r, t in zip(made, want))
    assert set(docs.columns) <= set(got.columns)
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_lines_with_many_sites(spark):
    """More sites than the near band, so the sketch alone decides."""
    made = [(i, f"shared by all\nown {i}\npair {i // 2}", f"site{i % 40}") for i in range(200)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()}
    assert got[0].startswith("shared by all") and not any("shared" in got[i] for i in range(1, 200))
    assert all(f"own {i}" in got[i] and f"pair {i // 2}" in got[i] for i in range(200))


def test_lines_against_sql(spark, smallest):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{smallest}/documents.parquet'")
    want = con.sql(oracles.oracle_sql()["op9_line_dedup"]).fetchall()
    got = line_dedup.digests(line_dedup.dedup_lines(spark.read.parquet(f"{smallest}/documents.parquet"))).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_lines_of_a_long_text(spark):
    """200,000 lines, half of them on many sites."""
    long = "\n".join(f"line {i}" for i in range(200_000))
    half = "\n".join(f"line {i}" for i in range(0, 200_000, 2))
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate([half, half + " ", half, long])], "doc_id long, text string, source string")
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - began < 60
    assert got[0].text == half and got[2].text == "" and got[3].text == "\n".join(f"line {i}" for i in range(1, 200_000, 2))
    assert (got[3].n_lines, got[3].n_removed) == (200_000, 100_000)


def test_sketches_decide(spark, monkeypatch):
    """Exact counts see the lines near the threshold only: a line on many sites goes by its sketch."""
    made = [(i, f"wide\nnear {i % 50}\nown {i}", f"site{i % 40}") for i in range(200)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    found = line_dedup.lines(docs)
    assert line_dedup.boilerplate(found).count() == 51 and line_dedup.boilerplate(found, 5).count() == 1
    monkeypatch.setattr(line_dedup, "BAND", -0.5)  # no line is near: the sketches alone are asked
    assert line_dedup.boilerplate(found, 20).count() == 1


def water_fill(size, weights=(5, 2, 1), share=1.5, top=2.0):
    w = np.array([weights[i % 3] for i in range(len(size))], float)
    cap, full = top * np.array(size, float), np.zeros(len(size), bool)
    while True:
        rest = share * sum(size) - cap[full].sum()
        t = np.where(full, cap, w / max(w[~full].sum(), 1e-9) * rest)
        over = (t > cap + 1e-9) & ~full
        if not over.any():
            return t
        full |= over


def mix_case(spark, texts, sources, **k):
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, sources))], "doc_id long, text string, source string")
    return mixing.mix(docs, **k)


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    names = ["b", "a", None, "ä", "Z", "empty"]
    sources = [rng.choices(names[:5], [6, 1, 1, 1, 1])[0] for _ in range(400)] + ["empty", "empty"]
    texts = [" ".join("w" for _ in range(rng.randrange(0, 90))) for _ in range(400)] + [None, " "]
    got, slots = mix_case(spark, texts, sources, block_words=64, chunk_docs=32)
    got, slots = got.collect(), slots.collect()
    by = sorted({s for s in sources if s is not None}, key=lambda s: s.encode()) + [None]
    size = [sum(len((t or "").split()) for t, s in zip(texts, sources) if s == n) for n in by]
    want = dict(zip(by, water_fill(size)))
    assert len(got) == len(texts)
    for r in got:
        assert r["size"] == len((texts[r.doc_id] or "").split()) and r.source_size == size[by.index(r.source)]
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
    for n in by:
        assert abs(sum(r.taken for r in got if r.source == n) - want[n]) <= 1
    # each source's slots are numbered without gaps, and every prefix is near the mix
    ranks = defaultdict(list)
    for s in sorted(slots, key=lambda s: (s.slot, s.r)):
        ranks[s["rank"]].append(s.r)
    assert all(v == list(range(len(v))) for v in ranks.values())
    order = [s["rank"] for s in sorted(slots, key=lambda s: (s.slot, s.r))]
    for k, v in ranks.items():
        for n in range(10, len(order), 7):
            assert abs(order[:n].count(k) - n * len(v) / len(order)) < 5
    again, _ = mix_case(spark, texts, sources, block_words=64, chunk_docs=32)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_targets_of_many_sources(spark):
    """Running sums over sources, which no one task orders, against the filling by hand."""
    rng = random.Random(4)
    size = [rng.randrange(0, 500) ** 2 for _ in range(700)]
    names = sorted({f"host{rng.random()}" for _ in range(900)})[:700]
    sized = spark.createDataFrame([(n, s, 1) for n, s in zip(names, size)], "source string, size long, copies long")
    got = {r.source: r for r in mixing.targets(sized).collect()}
    want = water_fill(size)
    for i, n in enumerate(names):
        assert got[n]["rank"] == i and got[n].source_size == size[i] and abs(got[n].target - want[i]) < 1e-6 * max(1, want[i])


def mix_of(spark, n=500):
    rng = random.Random(10)
    sources = [rng.choices("abcd", [6, 2, 1, 1])[0] for _ in range(n)]
    texts = [" ".join(f"w{i}" for _ in range(rng.randrange(1, 60))) for i in range(n)]
    return spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, sources))], "doc_id long, text string, source string")


def test_the_schedule_orders_the_mix(spark, monkeypatch):
    docs = mix_of(spark)
    rows, _, stream = mixing.mixed(docs, block_words=32, chunk_docs=40)
    rows, stream = rows.collect(), sorted(stream.collect(), key=lambda r: (r.slot, r["at"]))
    goal = {r.source: r.target for r in rows}
    total, met, near = sum(goal.values()), defaultdict(int), 0
    for r in stream:
        met[r.source] += r.words
        near += r.words
        for s, t in goal.items():  # every prefix of the mix nears the targets
            assert abs(met[s] - near * t / total) < 5 * 32
    by = defaultdict(lambda: [0, 1 << 60])
    for r in stream:
        by[r.doc_id] = [by[r.doc_id][0] + r.words, min(by[r.doc_id][1], r.slot)]
    assert all((r.taken, r.first_slot) == ((by[r.doc_id][0], by[r.doc_id][1]) if r.taken else (0, None)) for r in rows)
    whole = mixing.whole_documents(mixing.mixed(docs, block_words=32, chunk_docs=40)[2])
    took = defaultdict(int)
    size = {r.doc_id: r["size"] for r in rows}
    for r in whole.collect():
        took[r.source] += size[r.doc_id]
    assert all(abs(took[s] - t) <= 60 for s, t in goal.items())  # within a document of the target
    # another sequence of slots gives another mix of the same amounts
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    others, _, other = mixing.mixed(docs, block_words=32, chunk_docs=40)
    other = sorted(other.collect(), key=lambda r: (r.slot, r["at"]))
    assert [r.doc_id for r in other] != [r.doc_id for r in stream]
    others = {r.doc_id: r for r in others.collect()}
    assert all(others[r.doc_id].taken == r.taken for r in rows) and any(others[r.doc_id].first_slot != r.first_slot for r in rows)


def test_running_sums_in_levels(spark, monkeypatch):
    rng = random.Random(2)
    made = [(rng.choice("xxxy"), i, rng.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(made, "g string, i long, v long").withColumn("part", F.expr("i div 5"))
    want = {}
    for g in "xy":
        at = 0
        for _, i, v in sorted(r for r in made if r[0] == g):
            want[i], at = at, at + v
    for fan in (1024, 3):
        monkeypatch.setattr(common, "FAN", fan)
        assert {r.i: r.out for r in common.two_level_sum(df, ["g"], "part", ["i"], "v", "out", 120).collect()} == want
    got = common.running_sums(df, ["v", "i"], n=F.lit(1), s=F.col("v")).orderBy("v", "i").collect()
    assert [r.n for r in got] == list(range(600)) and [r.s for r in got] == [sum(x.v for x in got[:k]) for k in range(600)]


def test_mix_odd_cases(spark, no_docs, odd_docs, odd_texts):
    assert mixing.mix(no_docs)[0].count() == 0
    assert mixing.mix(odd_docs)[0].count() == len(odd_texts)
    one, _ = mix_case(spark, ["a b c"] * 4 + [None], ["s"] * 5)
    assert [(r.target, r.taken) for r in one.orderBy("doc_id").collect()][-1] == (18.0, 0)
    assert one.agg(F.sum("taken")).first()[0] == 18
    docs = spark.createDataFrame([(1, "a b", "s")] * 6 + [(None, "a", "t")], "doc_id long, text string, source string")
    assert mixing.mix(docs)[0].count() == 7
    nothing, _ = mix_case(spark, [None, ""], ["s", None])
    assert [tuple(r)[2:] for r in nothing.collect()] == [(0, 0, 0.0, 0)] * 2


def cosine(v, w):
    """Sums from the first component to the last."""
    dot = own = other = 0.0
    for x, y in zip(v.tolist(), w.tolist()):
        dot, own, other = dot + x * y, own + x * x, other + y * y
    return float(dot / (np.sqrt(other) * np.sqrt(own)))


def nearest_by_hand(vectors, every=50, k=5):
    usable = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault((i, tuple(v)), None)
    items = [(i, np.array(v, float)) for i, v in usable]
    out = {}
    for q, v in items:
        if q % every == 0:
            scores = sorted((-cosine(v, w), i) for i, w in items if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def vectors_of(seed, n, dim, copies=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).astype(np.float32)
    m[: copies or 0] = m[0]
    return [(int(i), [float(x) for x in row]) for i, row in enumerate(m)]


def test_nearest_is_exact_at_factor_one(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_SIZE", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    vectors = vectors_of(1, 600, 8, copies=60) + [(700, None), (701, []), (702, [0.0] * 8), (703, [float("nan")] * 8), (704, [None] * 8), (750, [1.0, 2.0]), (751, [2.0, 1.0]), (None, [1.0] * 8)]
    vectors += [vectors[3], vectors[50]]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = nearest_by_hand(vectors)
    assert set(got) == {q for q, v in want.items() if v}
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in want[q]]
        assert [s for _, s in found] == [s for _, s in want[q]]


def test_recall_of_relaxed_search(spark, smallest):
    df = spark.read.parquet(f"{smallest}/embeddings.parquet")
    want = nearest_by_hand([(r.vec_id, list(r.embedding)) for r in df.collect()])
    for factor, least in ((1.0, 1.0), (1.1, 0.9)):
        got = defaultdict(set)
        for r in ann.nearest(df, factor=factor).collect():
            got[r.query_id].add(r.vec_id)
        recall = np.mean([len(got[q] & {i for i, _ in v}) / len(v) for q, v in want.items()])
        assert recall >= least
    assert ann.nearest(df.limit(0)).count() == 0 and ann.visited(df.limit(0)) == 0.0


def test_pruning_on_clustered_vectors(spark, monkeypatch):
    """Where vectors lie in clusters, exact search leaves most shards out; a larger factor leaves out more."""
    monkeypatch.setattr(ann, "SHARD_SIZE", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    made = [(i, (centres[i % 12] + 0.05 * rng.normal(size=16)).tolist()) for i in range(900)] + [(1000, [1.0, 2.0, 3.0]), (1050, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    exact, relaxed = ann.visited(df), ann.visited(df, factor=3.0)
    assert relaxed <= exact < 0.5
    want, found = nearest_by_hand(made), defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert found == {q: [i for i, _ in v] for q, v in want.items() if v}
    monkeypatch.setattr(ann, "SHARD_SIZE", 4)  # parts of a shard, and more shards than the sample's leaves
    assert sorted((r.query_id, r.vec_id) for r in ann.nearest(df).collect()) == sorted((q, i) for q, v in found.items() for i in v)


def test_nearest_against_sql(spark, smallest):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{smallest}/embeddings.parquet'")
    want = con.sql(oracles.oracle_sql()["op10_nearest"]).fetchall()
    got = ann.nearest(spark.read.parquet(f"{smallest}/embeddings.parquet")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
