"""Language ID, importance resampling, fertility rules and toxicity."""

import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
from intervale.llm import langid, quality_classifier, quality_rules, queries, toxicity
from pyspark.sql import functions as F

from .conftest import DOCS, rows


def test_language_of_held_out_documents(spark, smallest):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    held = got.where("held_out AND lang IS NOT NULL").select("lang", "lang_pred", "score").collect()
    assert len(held) > 100
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_of_odd_texts(odd_docs, odd_texts, no_docs):
    docs = odd_docs.withColumn("held_out", langid.held_out())
    got = {r.doc_id: r for r in langid.identify(docs, docs).collect()}
    assert len(got) == len(odd_texts)
    for i, t in enumerate(odd_texts):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
        assert 0 <= got[i].score <= 1
    assert {r.lang_pred for r in langid.identify(docs, docs.where("lang = 'xx'")).collect()} == {"und"}
    assert langid.identify(no_docs.withColumn("held_out", F.lit(True)), docs).count() == 0


def test_bundles_are_sums_of_bound_vectors():
    made = langid.Profiles(64)
    text = "Ab c"
    got = made.bundle([text], np.array([0]), 1)[0]
    line, want = " ab c ", np.zeros(64)
    for i in range(len(line) - 2):
        v = np.ones(64)
        for k, c in enumerate(line[i : i + 3]):
            base = np.random.default_rng(ord(c)).integers(0, 2, 64) * 2 - 1
            v *= np.roll(base, 2 - k)
        want += v
    assert (got == want).all()


def bundle_by_hand(text, dimensions):
    """The sum of the n-grams' bound vectors, letter by letter."""
    symbols = [32]
    for c in text.lower():
        if c.isalpha():
            symbols.append(ord(c))
        elif symbols[-1] != 32:
            symbols.append(32)
    if symbols[-1] != 32:
        symbols.append(32)
    base = {c: np.random.default_rng(c).integers(0, 2, dimensions) * 2 - 1 for c in set(symbols)}
    total = np.zeros(dimensions)
    for i in range(len(symbols) - 2):
        total += np.roll(base[symbols[i]], 2) * np.roll(base[symbols[i + 1]], 1) * base[symbols[i + 2]]
    return total


def test_predictions_against_brute_force(spark, odd_texts, monkeypatch):
    rng = random.Random(7)
    words = {"en": "the house was old and full of light".split(), "de": "das haus war alt und voller licht".split(), "zh": ["房子", "很旧", "光线", "充满"], "el": ["ΣΑΣ", "οδος", "φως"]}
    texts = [(" ".join(rng.choice(v) for _ in range(rng.randrange(1, 30))), k) for k, v in words.items() for _ in range(25)]
    texts += [(t if t is None or len(t) < 1000 else t[:1000], None) for t in odd_texts]
    docs = spark.createDataFrame([(i, t, k, i % 3 == 0) for i, (t, k) in enumerate(texts)], "doc_id long, text string, lang string, held_out boolean")
    sums = defaultdict(lambda: np.zeros(64))
    vectors = [bundle_by_hand(t or "", 64) for t, _ in texts]
    for i, (_, k) in enumerate(texts):
        if k and i % 3:
            sums[k] += vectors[i]
    names = sorted(sums)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    made = unit(np.array([sums[k] for k in names]))
    made = unit(made - made.mean(axis=0))
    for slice_, cells in ((600_000, 1 << 23), (16, 10)):  # texts whole or in slices, sums by matrix or one by one
        monkeypatch.setattr(langid, "SLICE", slice_)
        monkeypatch.setattr(langid, "CELLS", cells)
        profiles = langid.Profiles(64)
        assert (profiles.bundle([t or "" for t, _ in texts], np.arange(len(texts)), len(texts)) == np.array(vectors)).all()
    for r in langid.identify(docs, docs.where("NOT held_out"), 64).collect():
        v = vectors[r.doc_id]
        if not np.linalg.norm(v):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = made @ v / np.linalg.norm(v)
        assert cosines[names.index(r.lang_pred)] >= cosines.max() - 1e-6
        assert abs(r.score - 1 / np.exp(langid.SHARPNESS * (cosines - cosines.max())).sum()) < 1e-3


WIDE = """
import resource, sys
sys.path.insert(0, %r)
import numpy as np
from intervale.llm import langid
rng = np.random.default_rng(0)
letters = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FA0, n)))
made = langid.Profiles()
many = made.bundle([letters(60) for _ in range(10_000)], np.arange(10_000), 10_000)
one = made.bundle([letters(6_000_000)], np.zeros(1, int), 1)
assert (np.abs(many).sum(axis=1) > 0).all() and np.abs(one).sum() > 0
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""


def test_memory_for_wide_alphabets_and_long_texts():
    """10,000 short Chinese texts and one of six million letters: under 2 GB."""
    out = subprocess.run([sys.executable, "-c", WIDE % sys.path[0]], capture_output=True, text=True, timeout=300, check=True).stdout
    assert int(out) < 2_000_000


def test_resampling_prefers_the_target(spark, smallest):
    got = queries.op3_importance_resampling(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    share = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.95 and share[0] < 0.5


def test_resampling_weights_and_kth(spark, odd_docs, odd_texts, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10, 40)], "doc_id long, quality int, toxic int")
    got = quality_classifier.resample(odd_docs, labels, share=0.5).collect()
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert sum(r.kept for r in got) == round(0.5 * len(odd_texts))
    assert min(r.gumbel_key for r in got if r.kept) == keys[sum(r.kept for r in got) - 1]
    # brute force of the weights
    b, hashes = quality_classifier.BUCKETS, quality_classifier._Hashes()
    model = np.zeros((2, b))
    for i, t in enumerate(odd_texts):
        found = np.bincount(quality_classifier.ngram_buckets(t or "", hashes, b), minlength=b)
        model[0] += found
        model[1] += found * (10 <= i < 40 and i % 2)
    share = (model + 0.5) / (model.sum(axis=1, keepdims=True) + 0.5 * b)
    for r in got:
        want = np.log(share[1] / share[0])[quality_classifier.ngram_buckets(odd_texts[r.doc_id] or "", hashes, b)].sum()
        assert abs(r.log_weight - want) < 1e-6
    assert quality_classifier.resample(no_docs, labels).count() == 0
    assert quality_classifier.resample(odd_docs, labels.limit(0)).count() == len(odd_texts)


def test_shares_of_labels(spark, odd_docs, odd_texts):
    """No good label keeps nothing, no label at all keeps everything."""
    bad = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, quality int")
    assert quality_classifier.resample(odd_docs, bad).where("kept").count() == 0
    assert quality_classifier.resample(odd_docs, bad.limit(0)).where("kept").count() == len(odd_texts)
    assert quality_classifier.resample(odd_docs, bad.withColumn("quality", F.lit(1))).where("kept").count() == len(odd_texts)


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 10) for _ in range(500)] + [1.5] * 100
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 200, 333, 599, 600):
        assert quality_classifier.kth_largest(df, "x", k, bins=8, few=20) == sorted(values, reverse=True)[k - 1]


def base_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), failed


def test_base_rules(spark, odd_texts, smallest, tokenizers, no_docs):
    texts = odd_texts + ["a b c d e f a b c d e f g", "x y " * 40, "a # $\na # $\nb\n\n\nb", "w " * 9 + "|<>"]
    texts += [r.text for r in spark.read.parquet(f"{smallest}/documents.parquet").limit(80).collect()]
    docs = spark.createDataFrame(rows(texts), DOCS)
    got = {r.doc_id: r for r in quality_rules.judge(docs, tokenizers("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_measures(t), t
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(no_docs, tokenizers("piece_bpe_32k.model")).count() == 0


def test_fertility_measures_and_bands(spark, tokenizers):
    import sentencepiece

    path = tokenizers("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    plain = [" ".join(rng.choice("the house was old and full of quiet light near water".split()) + rng.choice(["", "s", "ly"]) for _ in range(80)) for _ in range(60)]
    junk = " ".join("".join(chr(rng.randrange(0x13000, 0x13400)) for _ in range(4)) + str(i) for i in range(80))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*plain, junk])], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge(docs, path).collect()}
    assert all(got[i].kept for i in range(60)) and not got[60].kept
    ids = sp.encode(junk)
    assert abs(got[60].chars_per_token - sum(map(len, junk.split())) / len(ids)) < 1e-9
    assert abs(got[60].byte_share - np.mean([sp.is_byte(i) for i in ids])) < 1e-9
    _, n = np.unique(ids, return_counts=True)
    assert abs(got[60].token_entropy - -(n / n.sum() * np.log2(n / n.sum())).sum()) < 1e-9


def verdicts_by_hand(texts, langs, path):
    """The bands and the verdicts, from the library's ids of each word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows, groups = [], defaultdict(list)
    for t, lang in zip(texts, langs):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        ids = [i for w in words for i in sp.encode(w)]
        failed, m = base_measures(t)[5], len(ids)
        row = None
        if m:
            share = np.array(list(Counter(ids).values())) / m
            entropy = -(share * np.log2(share)).sum() - np.log2(min(m, 500))
            row = (sum(map(len, words)) / m, np.mean([sp.is_byte(i) for i in ids]), entropy, m)
        rows.append((failed, lang, row))
        if not failed:
            groups[lang].append(row)
    kept = []
    for failed, lang, row in rows:
        good = not failed
        for k, floor in enumerate((0.1, 0.02, 0.3)):
            if good:
                values = sorted(r[k] for r in groups[lang])
                q1, mid, q3 = (values[max(0, int(np.ceil(p * len(values))) - 1)] for p in (0.25, 0.5, 0.75))
                x = mid + (row[k] - mid) * np.sqrt(min(row[3], 500) / 500)
                top = np.inf if k == 2 else max(q3 + 2.5 * (q3 - q1), mid + floor)
                good = min(q1 - 2.5 * (q3 - q1), mid - floor) <= x <= top
        kept.append(bool(good))
    return kept


def test_verdicts_against_brute_force(spark, odd_texts, tokenizers):
    path = tokenizers("piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL").limit(250).collect()
    texts, langs = [r.text for r in docs] + odd_texts, [r.lang for r in docs] + [("xx", "en")[i % 2] for i in range(len(odd_texts))]
    texts += ["".join(chr(0x13000 + (i * 7 + k) % 900) + " " * (k % 4 == 0) for k in range(400)) for i in range(3)]
    langs += ["en"] * 3
    made = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality_rules.judge(made, path).collect()}
    want = verdicts_by_hand(texts, langs, path)
    assert [got[i] for i in range(len(texts))] == want
    assert 0 < sum(want) < len(want) - 3 and not any(want[-3:])


def test_script_of_a_text():
    assert quality_rules.script_of("http://a.b слово и ещё много слов") == "cyrillic"
    assert quality_rules.script_of("日本 kanji 漢字漢字") == "cjk"
    assert quality_rules.script_of("ab яб") == "cyrillic" and quality_rules.script_of("1 + 2") == "none"


def test_repeat_words():
    assert quality_rules.repeat_words(np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 8, 7, 6])) == 10
    assert quality_rules.repeat_words(np.zeros(12, np.int64)) == 12
    assert quality_rules.repeat_words(np.array([], np.int64)) == 0


def maximal_by_definition(scores):
    """Ruzzo and Tompa's recursion: the best segment, then both sides of it."""
    out, todo = [], [(0, len(scores))]
    while todo:
        lo, hi = todo.pop()
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] <= 0:
            continue
        _, _, i, j = best
        out.append((i, j, best[0]))
        todo += [(lo, i), (j, hi)]
    return sorted(out)


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 1000 for _ in range(rng.randrange(0, 14))]
        got = toxicity.maximal_segments(np.array(scores))
        assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _ in maximal_by_definition(scores)]
        assert np.allclose([s for _, _, s in got], [s for _, _, s in maximal_by_definition(scores)])


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[(1, 1)] / (n[(1, 1)] + n.get((1, 0), 0)) > 0.8
    assert n.get((0, 1), 0) / (n[(0, 0)] + n.get((0, 1), 0)) < 0.01


def test_toxicity_odd_cases(spark, odd_docs, odd_texts, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 40)] + [(10, 0), (11, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd_docs, toxicity.train(odd_docs, labels)).collect()
    assert len(got) == len(odd_texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.score < 1e-9 for r in toxicity.score(odd_docs, toxicity.train(odd_docs, labels.where("toxic = 0"))).collect())
    assert toxicity.score(no_docs, toxicity.Model()).count() == 0
    assert toxicity.drop_toxic(odd_docs, toxicity.Model(curve=(-40.0, 0.0))).columns == odd_docs.columns


def toxicity_by_hand(texts, labels):
    """Training and scoring without Spark: counts by sets, segments by their definition."""
    tokens = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    counts = {k: defaultdict(lambda: [0, 0]) for k in "wp"}
    for i, y in labels.items():
        found = set(tokens[i])
        for k, kind in (("w", found), ("p", {w[:n] for n in (5, 4, 3) for w in found if len(w) >= n})):
            for x in kind:
                counts[k][x][1 - y] += 1
    toxic, clean = sum(labels.values()), len(labels) - sum(labels.values())
    rate = toxic / len(labels)
    told = {k: {x: (t, c) for x, (t, c) in v.items() if t + c >= 2 and abs(t - rate * (t + c)) / np.sqrt((t + c) * rate * (1 - rate)) > 1.5} for k, v in counts.items()}
    model = toxicity.log_odds(told["w"], told["p"], toxic, clean)

    def score(w):
        known = model.words.get(w)
        for n in (5, 4, 3):
            if known is None and len(w) >= n:
                known = model.prefixes.get(w[:n])
        return (known or 0.0) - toxicity.DRIFT

    found = [[s for _, _, s in maximal_by_definition([score(w) for w in words])] for words in tokens]
    own = [i for i, y in labels.items() if not y]
    model.location, model.scale = toxicity._gumbel(np.array([float(len(tokens[i])) for i in own]), np.array([max(found[i], default=0.0) for i in own]))
    heights = [sum(max(0.0, (s - model.location[0] - model.location[1] * np.log(max(len(w), 1))) / model.scale - toxicity.SIGNIFICANT) for s in f) for w, f in zip(tokens, found)]
    rows = list(labels)
    a, b = toxicity._logistic(np.log1p(np.array([heights[i] for i in rows])), np.array([float(labels[i]) for i in rows]))
    return [1 / (1 + np.exp(-(a + b * np.log1p(h)))) for h in heights], heights


def test_toxicity_against_brute_force(spark):
    rng = random.Random(12)
    plain, bad = [f"calm{i}" for i in range(30)], [f"vile{i}" for i in range(6)]
    texts, labels = [None, "", "calm1"], {}
    for i in range(3, 83):
        words = [rng.choice(plain) for _ in range(rng.randrange(3, 22))]
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad) for _ in range(rng.randrange(1, 6))]
        texts.append(" ".join(words))
        if i % 5:
            labels[i] = int(i % 4 == 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    want, heights = toxicity_by_hand(texts, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want))
    found = defaultdict(list)
    for r in toxicity.passages(docs, model).collect():
        assert texts[r.doc_id][r.start : r.end] == r.passage and "vile" in r.passage and r.evidence > 0
        found[r.doc_id].append(r.evidence)
    assert all(abs(sum(found.get(i, [])) - h) < 1e-9 for i, h in enumerate(heights)) and found
    assert toxicity.passages(docs.limit(0), model).count() == 0


def test_calibration_is_apart_from_the_counts(spark):
    """With enough texts of each label, the curve comes from texts whose words were not counted."""
    rng = random.Random(13)
    made = [(i, " ".join([f"calm{rng.randrange(40)}" for _ in range(9)] + ([f"vile{rng.randrange(5)}"] if i % 2 else [])) + f" own{i}", i % 2) for i in range(900)]
    docs = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    scored = toxicity.score(docs, model).join(docs, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in scored]) > 0.95


def test_toxicity_prefixes_carry_to_new_words():
    words = {f"vequ{s}": (9, 0) for s in ("ta", "no", "ez")} | {"calm": (10, 90), "vest": (5, 45)}
    prefixes = {"vequt": (9, 0), "vequ": (27, 0), "veq": (27, 0), "ves": (5, 45), "calm": (10, 90)}
    scores = toxicity.Scores(toxicity.log_odds(words, prefixes, 100, 900))
    assert scores["vequxyz"] > 2 and scores["vest"] < 0 and scores["unknown"] == -toxicity.DRIFT


def test_quartiles_do_not_depend_on_partitions(spark):
    """Exact, and the same under three partitionings, over more values than a sketch would keep."""
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.normal(4, 1, 29_000), np.full(1_000, 4.0)])
    df = spark.createDataFrame([("en", float(v)) for v in values] + [("de", 1.0), ("de", 3.0), ("fr", None), (None, 2.0)], "grp string, x double")
    found = [sorted(map(tuple, quality_rules.quartiles(df.repartition(n), "grp", "x").where("grp IS NOT NULL").collect())) for n in (1, 3, 16)]
    ordered = np.sort(values)
    want = [float(ordered[-(-k * len(ordered) // 4) - 1]) for k in (1, 2, 3)]
    assert found[0] == found[1] == found[2] == [("de", 1.0, 1.0, 3.0), ("en", *want)]
