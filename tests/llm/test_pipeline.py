"""The pipeline's stages, and the guard that lets the subpackage go."""

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import xxhash
from intervale.llm import queries
from intervale.llm.common import materialize
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .conftest import DOCS, rows
from .test_dedup_mix_ann import lines_by_hand, water_fill, xxh
from .test_text_models import toxicity_by_hand


def test_stages(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    before = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, smallest), "test")
        assert after.columns == columns
        sizes.append(after.count())
        if name in ("toxicity", "simhash_near_dedup"):
            assert after.exceptAll(before).count() == 0 and after.count() < before.count()
        if name == "line_dedup":
            assert after.count() == before.count() and after.agg(F.sum("n_chars")).first()[0] < before.agg(F.sum("n_chars")).first()[0]
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, smallest)
    assert last.count() == sizes[-1]
    whole = queries.pipeline(spark, smallest)
    assert sorted(map(tuple, whole.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, last.select("doc_id", "ids_sha256").collect()))


def test_all_are_registered():
    import __spark_entry__

    made = __spark_entry__.queries()
    assert "pipeline" in made and all(any(n.startswith(f"op{i}_") for n in made) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(made)


def test_stages_take_odd_rows(spark, odd_docs, odd_texts, no_docs):
    for docs in (odd_docs.unionByName(odd_docs.limit(9)).unionByName(odd_docs.limit(4).withColumn("doc_id", F.lit(None).cast("long"))), no_docs):
        n = docs.count()
        lines = corpus_pipeline.dedup_lines(spark, docs, "")
        assert lines.count() == n and lines.columns == docs.columns
        unique = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        ids = [r.doc_id for r in unique.select("doc_id").collect()]
        assert unique.columns == docs.columns and len(set(ids) - {None}) == len([i for i in ids if i is not None]) and ids.count(None) == (4 if n else 0)
        mixed = corpus_pipeline.mix_sources(spark, docs, "")
        assert mixed.columns == docs.columns and (mixed.count() > 0) == (n > 0)
        assert corpus_pipeline.encode(spark, docs, "").count() == n


def word_sets(texts):
    """Five-word shingles by hand."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def copies_by_hand(texts):
    """For each text the place of the first one that pairs of similarity 0.8 or more lead to."""
    sets, up = word_sets(texts), list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited(rng, words, times):
    words = list(words)
    for k in range(times):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice(([f"new{rng.random()}"], [], [words[at], f"more{rng.random()}"]))
    return " ".join(words)


def test_near_copies_against_brute_force(spark, odd_texts, smallest):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(90)]
    texts = odd_texts + [r.text for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()]
    for n in (3, 7, 12, 40, 150, 600):
        base = [f"b{n}-{rng.randrange(500)}" for _ in range(n)]
        texts += [" ".join(base), " ".join(base).upper(), *(edited(rng, base, k) for k in (1, 2, 3, n // 60 + 1, n // 40 + 1, n // 25 + 1, n // 10 + 1))]
    large = [f"g{i}" for i in range(200)]
    texts += [edited(rng, large, rng.randrange(1, 8)) for _ in range(150)]
    texts += [" ".join(passage + [f"own{rng.random()}" for _ in range(rng.randrange(10, 60))]) for _ in range(80)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(rows(texts), DOCS)
    want = copies_by_hand(texts)
    assert len(set(want)) < len({frozenset(s) for s in word_sets(texts)}) - 80
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()]
    assert sorted(got) == sorted(set(want))


def test_texts_that_share_an_id_stay(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    made = [(7, one), (7, two), (7, two.upper()), (7, one), (8, one + " end"), (9, three), (None, three)]
    docs = spark.createDataFrame([(i, t, "en", "ab"[k % 2], len(t), "x", 0.5, "y", "z") for k, (i, t) in enumerate(made)], DOCS)
    found = [sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, d, "").collect()), key=str) for d in (docs, docs.orderBy(F.desc("source"), "text").repartition(3))]
    assert found[0] == found[1]
    # What a group keeps has one of its texts; a null id stays.
    assert sorted((r[0] or 0, r[1].lower()) for r in found[0]) == sorted([(7, one), (7, two), (9, three), (0, three)])


def corpus(rng):
    """Plain, toxic, copied, nearly copied and boilerplate documents: (doc_id, text, source), and labels."""
    texts, labels = [], {}
    for i in range(90):
        words = [f"calm{rng.randrange(60)}" for _ in range(rng.randrange(12, 30))]
        if i % 6 == 0:
            words[5:5] = [f"vile{rng.randrange(5)}" for _ in range(4)]
        texts.append(" ".join(words))
        if i % 4:
            labels[i] = int(i % 6 == 0)
    long = [f"tale{i}" for i in range(150)]
    texts += [" ".join(long), " ".join(long).upper(), edited(rng, long, 1), edited(rng, long, 2), edited(rng, long, 60)]
    texts += [texts[1], texts[2], texts[2]] + [None, ""]
    texts = [t if k % 3 or t is None else f"{t}\nsubscribe to our letter\nown line {k}" for k, t in enumerate(texts)]
    return [(i, t, ("a", "b", "c", "d", None)[i % 5]) for i, t in enumerate(texts)], labels


def mixed_by_hand(docs):
    """The mix in whole documents: each source's words, shuffled by hash, up to its target, twice at most."""
    sources = sorted({s for _, _, s in docs if s is not None}, key=lambda s: s.encode()) + ([None] if any(s is None for _, _, s in docs) else [])
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    goal = water_fill([sum(size(t) for _, t, s in docs if s == n) for n in sources])

    def mark(doc_id, text):
        h = 42
        for part in (struct.pack("<q", doc_id), struct.pack("<q", xxh(text)), struct.pack("<i", 1)):
            h = xxhash.xxh64_intdigest(part, h)
        return h - 2**64 if h >= 2**63 else h

    taken = Counter()
    for n, t in zip(sources, goal):
        stream = sorted((mark(i, text), i, size(text)) for i, text, s in docs if s == n and size(text))
        at, words = 0, round(t)
        for _ in range(2):
            for _, i, k in stream:
                taken[i] += 2 * (min(at + k, words) - at) >= k
                at += k
    return taken


def test_run_against_brute_force(spark, tmp_path, tokenizers):
    docs, labels = corpus(random.Random(21))
    made = [(i, t, "en", s, len(t or "")) for i, t, s in docs]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    scores, _ = toxicity_by_hand([t for _, t, _ in docs], labels)
    clean = [d for d, x in zip(docs, scores) if x < 0.7]
    assert 5 < len(docs) - len(clean) < 20
    lined = [(i, t, s) for (i, _, s), t in zip(clean, lines_by_hand(clean))]
    assert sum("subscribe" in (t or "") for _, t, _ in lined) == 1
    roots = copies_by_hand([t for _, t, _ in lined])
    unique = [d for k, d in enumerate(lined) if roots[k] == k]
    assert len(lined) - len(unique) > 4
    taken = mixed_by_hand(unique)
    assert set(taken.values()) == {0, 1, 2}
    library, want = Tokenizer.from_file(tokenizers("word_bpe_49k.json")), Counter()
    for i, t, _ in unique:
        want[i, hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()] = taken[i]
    got = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


def test_the_mix_comes_in_the_order_of_the_schedule(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    words = {r.doc_id: (r.source, len((r.text or "").split())) for r in docs.collect()}
    ordered = [words[r.doc_id] for r in corpus_pipeline.mix_sources(spark, docs, smallest).collect()]
    whole, total, longest = defaultdict(int), sum(n for _, n in ordered), max(n for _, n in words.values())
    for s, n in ordered:
        whole[s] += n
    met, near = defaultdict(int), 0
    for s, n in ordered:  # the share of every source is near its own at every place
        met[s], near = met[s] + n, near + n
        assert all(abs(met[k] - near * v / total) < 3 * longest + 3 * 1024 for k, v in whole.items())


def test_the_order_of_the_mix_lasts_to_the_end(spark, tmp_path, monkeypatch):
    """What the schedule puts first comes first in the files of ``run``."""
    docs, labels = corpus(random.Random(22))
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    mixed = []

    def keeps(spark, docs, sf_dir):
        made = materialize(corpus_pipeline.mix_sources(spark, docs, sf_dir), "kept")
        mixed.extend(r.doc_id for r in corpus_pipeline.placed(made).orderBy("place").collect())
        return corpus_pipeline.mix_sources(spark, docs, sf_dir)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, keeps if n == "mixing" else f) for n, f in corpus_pipeline.STAGES])
    made = corpus_pipeline.run(spark, str(tmp_path))
    rows = [(r.place, r.doc_id) for r in made.collect()]
    assert [p for p, _ in rows] == list(range(len(mixed))) and [i for _, i in rows] == mixed != sorted(mixed)


def test_fingerprints_give_first_candidates(spark):
    """Equal fingerprints of unlike texts make no link; near ones are confirmed on the sets."""
    from intervale.llm import chosen_path, near_copies

    long = [f"w{i}" for i in range(300)]
    texts = [" ".join(long), " ".join([*long, "end"]), " ".join(["start", *long]), "other text of its own", "OTHER text of its own", None, ""]
    docs = spark.createDataFrame(rows(texts), DOCS)
    pairs = near_copies.fingerprint_pairs(docs, chosen_path.Join(docs, near_copies.LEAST))
    assert 0 < pairs.count() <= 3
    roots = {r.doc_id: r.root for r in near_copies.near_copies(docs).collect()}
    assert roots[0] == roots[1] == roots[2] != roots[3] == roots[4] != roots[5] == roots[6]


def test_near_candidates_make_no_rows(spark, monkeypatch):
    """Texts of which most pairs lie below the threshold: candidates make few rows, and all links are found."""
    from intervale.llm import chosen_path, near_copies

    from .test_join_whiten_search import below_threshold, classes_by_hand

    made, stored = [], chosen_path.materialize

    def counted(df, name):
        made.append((stored(df, name), name))
        return made[-1][0]

    monkeypatch.setattr(chosen_path, "materialize", counted)
    texts = below_threshold(200)
    _, want = classes_by_hand(texts, 4, 5)
    roots = {r.doc_id: r.root for r in near_copies.near_copies(spark.createDataFrame(rows(texts), DOCS)).collect()}
    assert 1 < len(set(want)) < len(texts) and len(set(zip(roots.values(), (want[i] for i in roots)))) == len(set(want)) == len(set(roots.values()))
    assert sum(df.count() for df, name in made if name == "found") < 20 * len(texts)
