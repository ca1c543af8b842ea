"""Covariates, tree growth, readers, sinks, the engine and its streaming service."""

import random
from dataclasses import replace

import numpy as np
import pytest
from intervale.functions.model import CELLS, Params, class_table
from intervale.operators import covset as cov
from intervale.operators.covset import Layout, Subset
from intervale.plans import engine as en
from intervale.plans import fit, tree
from intervale.sources import readers, sinks
from intervale.streaming.jobs import fit_arrivals
from pyspark.sql import functions as F

DEFINITION = """
# a small set
covset tiny ann_dir cts_dir
covariate splice ANN MONO 1 2
1 near close to a splice site
2 far  all else
covariate rna CTS MONO 1 3
0 NULL MissingValue
1 low few reads
2 mid some reads
3 high many reads
covariate kind CTS NONMONO 2 2
1 x ex
2 y why
end
"""
TRUTH = Params(0.4, 0.8, 0.9, 0.05, 0.01, 0.75, 0.2, 0.05)


@pytest.fixture(scope="module")
def tiny():
    return cov.parse_covset(DEFINITION)


def test_definition(tiny):
    assert [c.name for c in tiny.covariates] == ["splice", "rna", "kind"] and tiny["rna"].top == 3
    assert tiny["splice"].values[0] == ("NULL", "MissingValue") and tiny["rna"].values[3] == ("high", "many reads")
    assert not tiny["kind"].monotonic and tiny["kind"].cell_specific
    for bad in (DEFINITION.replace("2 far", "3 far"), DEFINITION.replace("CTS MONO 1 3", "CTS MONO 1 4"), "covariate a CTS MONO 1 0"):
        with pytest.raises(ValueError):
            cov.parse_covset(bad)


def test_templates_round_trip(tiny):
    for text in ("ANN:*:CTS:*", "ANN:{splice;1}:CTS:{rna;1,3},{kind;2}", "ANN:*:CTS:{kind;1,2}"):
        assert Subset.parse(text, tiny).template(tiny) == text
    assert Subset().can_split(tiny) and not Subset({"splice": (0, 1), "rna": (2,), "kind": (1,)}).can_split(tiny)
    with pytest.raises(ValueError):
        Subset.parse("ANN:*:CTS:{rna;9}", tiny)


def test_bits(spark, tiny):
    cts = Layout.of(tiny.of(True))
    rows = [(f"{a}{b:02d}",) for a in range(4) for b in range(3)] + [("900",), ("x01",)]
    got = spark.createDataFrame(rows, "t string").select("t", cts.encode(F.col("t")).alias("b"), cts.decode(cts.encode(F.col("t"))).alias("back")).collect()
    for r in got:
        good = r.t not in ("900", "x01")
        assert (r.b is not None) == good and (not good or (bin(r.b).count("1") == 2 and r.back == r.t))
    subset = Subset.parse("ANN:*:CTS:{rna;1,3},{kind;2}", tiny)
    inside = spark.createDataFrame(rows, "t string").where(cov.in_set(cts.encode(F.col("t")), subset.mask(cts))).collect()
    assert sorted(r.t for r in inside) == ["102", "302"]


def test_splits(tiny):
    assert cov.ordered_splits(Subset(), tiny["rna"]) == [((1,), (2, 3)), ((1, 2), (3,))]
    assert cov.ordered_splits(Subset(), tiny["kind"], {1: 0.9, 2: 0.1}) == [((2,), (1,))]
    assert cov.ordered_splits(Subset({"rna": (2,)}), tiny["rna"]) == []


def planted(spark, tiny):
    """rho depends on rna only: low 0.15, others 0.7. A position is a run of one."""
    rng = np.random.default_rng(2)
    ann, cts = Layout.of(tiny.of(False)), Layout.of(tiny.of(True))
    aligned, sites, at = [], [], 0
    place = {"a": (1.0, 0.0), "i": (0.0, 1.0), "o": (0.0, 0.0)}
    for splice in (1, 2):
        for rna in (0, 1, 2, 3):
            for kind in (1, 2):
                table = class_table(replace(TRUTH, rho=0.15 if rna == 1 else 0.7))
                for cell, n in zip(table, rng.multinomial(60_000, list(table.values()))):
                    if n:
                        sites.append(("c", at, at + int(n), cell[0], *place[cell[1]], TRUTH.lam, TRUTH.theta))
                        at += int(n)
                start = at - sum(s[2] - s[1] for s in sites if s[1] >= (aligned[-1][2] if aligned else 0))
                aligned.append(("c", start, at, ann.bits("splice", [splice]), "one", cts.bits("rna", [rna]) | cts.bits("kind", [kind])))
    a = spark.createDataFrame(aligned, "chrom string, st long, en long, ann long, cell string, tagb long")
    s = spark.createDataFrame(sites, "chrom string, st long, en long, cls string, x_maj double, x_min double, lambda double, theta double")
    return a, s


def test_planted_split_is_found(spark, tiny):
    aligned, sites = planted(spark, tiny)
    options = tree.Options(min_gain=25.0, max_depth=3)
    first = tree.grow(spark, tiny, aligned, sites, TRUTH, options, levels=1)
    assert [n.status for n in first] == ["split", "pending", "pending"]
    stored = tree.load_nodes(tree.node_table(spark, first, tiny), tiny, TRUTH)
    nodes = tree.grow(spark, tiny, aligned, sites, TRUTH, options, nodes=stored)
    root = nodes[0]
    assert root.status == "split" and root.split["cov"] == "rna" and {tuple(root.split["set"]), tuple(root.split["coset"])} == {(1,), (2, 3)}
    assert {n.status for n in nodes[1:]} == {"leaf"} and len(nodes) == 3
    high = next(n for n in nodes if n.node_id == "0h")
    assert high.subset.allowed["rna"] == (2, 3) and abs(high.params.rho - 0.7) < 0.1
    table = tree.node_table(spark, nodes, tiny).collect()
    assert [r.subset_template for r in table if r.node_id == "0h"] == ["ANN:*:CTS:{rna;2,3}"]


def test_candidate_scores(spark):
    rows = [("n", "a", [1], [2], 100.0, 0.5, 10.0, 10.0, 0.6, 0.3, 0.01, 0.01, 40.0, 50.0), ("n", "a", [2], [1], 100.0, 0.5, 10.0, 10.0, 0.3, 0.6, 0.5, 0.5, 40.0, 55.0), ("n", "b", [1], [2], 100.0, 0.5, 0.0, 10.0, 0.3, 0.6, 0.1, 0.1, 0.0, 9.0)]
    spec = "node_id string, cov string, set_values array<int>, coset_values array<int>, parent_nll double, parent_rho double, n_set double, n_cos double, rho_set double, rho_cos double, err_set double, err_cos double, nll_set double, nll_cos double"
    got = tree.score_candidates(spark.createDataFrame(rows, spec), tree.Options(max_p1=0.05)).orderBy("rank").collect()
    assert [(r.gain_nats, r.passes, r["rank"]) for r in got] == [(10.0, True, 1), (5.0, False, 2)]
    assert all(r.rho_hi == 0.6 and r.rho_lo == 0.3 for r in got)
    assert tree.expected_gain(100, 0.6, 0.01, 100, 0.3, 0.01, 200)[1] > 0


def test_expected_gains_in_tasks(spark):
    rows = [("n", "a", [1], [2], 100.0, 0.5, 40.0, 60.0, 0.6, 0.3, e, 0.05, 40.0, 50.0) for e in (0.05, None, 0.0)]
    spec = "node_id string, cov string, set_values array<int>, coset_values array<int>, parent_nll double, parent_rho double, n_set double, n_cos double, rho_set double, rho_cos double, err_set double, err_cos double, nll_set double, nll_cos double"
    got = tree.score_candidates(spark.createDataFrame(rows, spec), tree.Options(min_directed_bits=0.1)).collect()
    want = tree.expected_gain(40.0, 0.6, 0.05, 60.0, 0.3, 0.05)
    for r in got:
        assert r.passes == (r.err_set == 0.05)
        assert (r.expected_bits, r.directed_bits) == ((None, None) if r.err_set != 0.05 else (r.expected_bits, r.directed_bits))
        assert r.err_set != 0.05 or (abs(r.expected_bits - want[0]) < 1e-9 and abs(r.directed_bits - want[1]) < 1e-9)


def test_reports_of_growth(spark, tiny):
    aligned, sites = planted(spark, tiny)
    kept = {}
    tree.grow(spark, tiny, aligned, sites, TRUTH, tree.Options(min_gain=25.0), levels=1, kept=kept)
    report = sinks.partition_table(kept["partitions"][0]).collect()
    assert sum(r.best for r in report) == 1 and sum(r.best_of_covariate for r in report) == 3
    assert {(r.cov, r.value) for r in kept["singles"][0].collect()} == {("kind", 1), ("kind", 2)}
    assert {r["cov"]: r.positions for r in tree.value_summary(kept["singles"][0]).collect()}["kind"] > 0


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture()
def database(spark, tmp_path):
    rng = random.Random(1)
    blocks = write(tmp_path / "block.bedg", "chr1\t0\t100\t0.0010 0.0050\nchr1\t120\t200\t0.0011 0.0040\nchr2\t0\t150\t0.0009 0.0060\n")
    sites = sorted({("chr1", rng.randrange(200)) for _ in range(12)} | {("chr2", rng.randrange(150)) for _ in range(8)})
    lines = "".join(f"{c}\t{p}\t{p + 1}\t{rng.choice('LH')}\t{rng.randrange(1, 4)}\t{rng.randrange(1, 4)}\n" for c, p in sites)
    codes = bytes(rng.choice([0, 1, 1, 1, 2, 3]) for _ in range(350))
    (tmp_path / "mono.db").write_bytes(codes)
    write(tmp_path / "mono.chroms", "chr1\t0\t200\nchr2\t0\t150\n")
    write(tmp_path / "mono.tags", "1 0.99\n2 0.5\n3 0.01\n")
    polys = write(tmp_path / "poly.bedg", lines)
    db = en.Database(readers.read_blocks(spark, blocks), readers.read_polys(spark, polys), readers.read_polys(spark, polys), readers.read_mono(spark, str(tmp_path / "mono"), chunk=64), readers.read_dictionary(spark, str(tmp_path / "mono.tags")))
    return db, codes, lines


LOCI = [("chr1", 10, 60, 1), ("chr1", 90, 130, 3), ("chr1", 105, 110, 2), ("chr2", 20, 140, 1), ("chr2", 140, 149, 0), ("chr9", 0, 5, 1)]


def test_join_against_positions(spark, database):
    db, codes, lines = database
    blocks = [("chr1", 0, 100), ("chr1", 120, 200), ("chr2", 0, 150)]
    at = {"chr1": 0, "chr2": 200}
    polys = [line.split("\t") for line in lines.splitlines()]
    want = {}
    for c, s, e, w in LOCI:
        for p in range(s, e):
            b = next((x for x in blocks if x[0] == c and x[1] <= p < x[2]), None)
            if b and codes[at[c] + p]:
                key = (f"{b[0]}:{b[1]}:{b[2]}", "M", codes[at[c] + p], None)
                want[key] = want.get(key, 0) + w
            for x in polys:
                if b and x[0] == c and int(x[1]) == p:
                    key = (f"{b[0]}:{b[1]}:{b[2]}", x[3], int(x[4]), int(x[5]))
                    want[key] = want.get(key, 0) + w
    from intervale.operators.patterns import pattern_counts

    loci = spark.createDataFrame(LOCI, "chrom string, st long, en long, weight int")
    got = {(r.block_id, r.cls, r.maj_idx, r.min_idx): r.n for r in pattern_counts(en.Engine(db).sites(loci)).collect()}
    assert got == want


def test_engine_fit_and_outputs(spark, database, tmp_path):
    db, _, _ = database
    e = en.Engine(db)
    loci = spark.createDataFrame(LOCI, "chrom string, st long, en long, weight int")
    result = e.fit(loci, en.Config(max_weight=3.0, resolution=2))
    assert 0.001 <= result.fit.params.rho <= 0.999 and result.fit.nll > 0 and result.stats["loci"] == 6
    out = e.posterior(result)
    assert abs(out["marginals"].where("axis = 'rho'").agg(F.sum("post")).first()[0] - 1) < 1e-9
    per = e.site_posteriors(loci, result.fit.params).count()
    assert per == e.site_posteriors(loci, result.fit.params, "alleles").count() == e.site_posteriors(loci, result.fit.params, "counterfactual", 2).count() > 0
    assert {r.cls for r in e.summary(loci)["weighted"].collect()} <= set("MLH")
    rows = sinks.model_rows(spark, "job", result.fit, result.stats, prior=en.HG19)
    text = sinks.model_text(rows).first().value
    parsed = readers.parse_model_text(text)
    assert abs(float(parsed["PARAMETERS"]["Rho"][0]) - result.fit.params.rho) < 1e-12
    assert sinks.summary_row(spark, result.fit).count() == 1
    mono = e.sites(loci).where("cls = 'M'").count()
    assert mono > 0
    lines = sinks.interchange_lines(db.blocks, spark.createDataFrame([("chr1:0:100", "chr1", 5, "M", 0.9, 0.1)], "block_id string, chrom string, pos long, cls string, x_maj double, x_min double"), 108)
    sinks.write_lines(lines, str(tmp_path / "ins"))
    got = [r.value for r in spark.read.text(str(tmp_path / "ins")).collect()]
    assert sorted(got)[-2:] == ["samples 108", "site chr1:5\tM\t0.900000"] and sum(x.startswith("block chr1:0-100") for x in got) == 1
    head = spark.createDataFrame([(x,) for x in got if x.startswith("block chr1:0")], "line string").select(*readers.parse_block_header(F.col("line"))).first()
    assert (head.chrom, head.st, head.en) == ("chr1", 0, 100)


def test_readers(spark, tmp_path, tiny):
    bed = write(tmp_path / "a.bed", "chr1\t5\t9\t4\nchr2\t1\t3")
    assert [r.weight for r in readers.read_weighted_bed(spark, bed, 5).orderBy("chrom").collect()] == [4, 1]
    assert [r.weight for r in readers.read_weighted_bed(spark, bed).collect()] == [1, 1]
    with pytest.raises(Exception, match="frequency class"):
        readers.read_polys(spark, write(tmp_path / "p.bedg", "chr1\t1\t2\tQ\t1\t1\n")).collect()
    runs = readers.read_covariate_runs(spark, write(tmp_path / "c.bedg", "chr1\t0\t70000\t102\nchr1\t70000\t70010\t301\n"), Layout.of(tiny.of(True)), "E1")
    genome = readers.reference_genome(spark, write(tmp_path / "g.bed", "chr1\t0\t70010\n"))
    assert runs.where("tagb IS NOT NULL AND cell = 'E1'").count() == 2 and readers.uncovered(runs, genome).count() == 0
    assert readers.uncovered(runs.limit(1), genome).count() == 1
    assert readers.reference_genome(spark).agg(F.sum("en")).first()[0] == 2_881_033_286
    write(tmp_path / "x.model", "PARAMETERS:\nRho:\t0.5\nEta: 1\n\nSTATS\nInLoci: 7\n")
    assert {(r.section, r.key): r.value for r in readers.read_models(spark, str(tmp_path / "x.model")).collect()} == {("PARAMETERS", "Rho"): "0.5", ("PARAMETERS", "Eta"): "1", ("STATS", "InLoci"): "7"}
    sized = tmp_path / "bad"
    (tmp_path / "bad.db").write_bytes(b"123")
    write(tmp_path / "bad.chroms", "chr1\t0\t5\n")
    with pytest.raises(ValueError, match="3 bytes"):
        readers.read_mono(spark, str(sized))
    assert set(CELLS) == set(class_table(TRUTH))


def test_bytes_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: offsets above 2^31 are read where they are."""
    far = (1 << 31) + 1000
    with open(tmp_path / "big.db", "wb") as f:
        for at, codes in ((5, b"\1\1\2"), (far - 2, b"\3\3\3\3"), (far + 700, b"\4")):
            f.seek(at)
            f.write(codes)
        f.truncate(far + 1000)
    write(tmp_path / "big.chroms", f"chr1\t0\t{far}\nchr2\t0\t1000\n")
    got = sorted(map(tuple, readers.read_mono(spark, str(tmp_path / "big"), chunk=1 << 26).collect()))
    assert got == [("chr1", 5, 7, 1), ("chr1", 7, 8, 2), ("chr1", far - 2, far, 3), ("chr2", 0, 2, 3), ("chr2", 700, 701, 4)]


def test_whole_result_files(spark):
    rows = [(j, s, k, "-1" if (j, k) == ("b", "Eta") else "0.5 x") for j in "abc" for s, k in readers.REQUIRED if (j, k) != ("c", "Beta3")]
    got = readers.whole_models(spark.createDataFrame(rows, "job string, section string, key string, value string"))
    assert {r.job for r in got.collect()} == {"a"} and got.count() == 9


def test_streaming_service(spark, database, tmp_path):
    db, _, _ = database
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    write(inbox / "one.bed", "chr1\t10\t60\t1\nchr1\t120\t160\t1\n")
    write(inbox / "two.bed", "chr2\t20\t140\t1\n")
    query = fit_arrivals(spark, en.Engine(db), str(inbox), str(tmp_path / "out"), str(tmp_path / "ck"), en.Config())
    query.awaitTermination(120)
    assert query.exception() is None
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.select("job").distinct().count() == 2 and rows.where("key = 'Rho' AND section = 'PARAMETERS'").count() == 2
    assert fit.NAMES == ("rho", "eta", "gamma")


def test_command_line(spark, database, tmp_path):
    from intervale import cli

    options, start = cli.config(cli.arguments().parse_args(["fit", "d", "x", "-o", "o", "--rho", "0.4,0,0.3", "--lambda", "0.01,0", "--betas", "2,1,1"]))
    assert (start, options.fixed, options.refine_lambda_theta) == ({"rho": 0.4, "lam": 0.01}, ("rho",), False)
    assert options.prior.rho == 0.3 and options.prior.beta1 == 0.5
    for name in ("db", "chroms", "tags"):
        (tmp_path / f"mono.{name}").rename(tmp_path / f"monoDB.{name}")
    (tmp_path / "polyn.bedg").write_text((tmp_path / "poly.bedg").read_text())
    bed = write(tmp_path / "in.bed", "chr1\t10\t60\t1\nchr2\t20\t140\t2\n")
    out = tmp_path / "out"
    cli.main(["fit", str(tmp_path), bed, "-o", str(out), "--max-weight", "2", "--expect", "--resolution", "2", "--sites", "posterior", "--summary", "--interchange"])
    made = {p.name for p in out.iterdir()}
    assert {"model", "model_text", "summary", "map", "posterior_marginals", "sites_posterior", "alleles_weighted", "interchange", "interchange_neutral"} <= made
    model = spark.read.parquet(str(out / "model"))
    assert readers.whole_models(model).count() == model.count()  # a result that the tree can read again
    assert {r.section for r in model.select("section").distinct().collect()} == {"PARAMETERS", "UNCERTAINTY", "STATS", "STATSN", "NEUTRAL_MODEL", "ARGS", "PRIOR_MODEL", "PRIORN_MODEL"}
    assert spark.read.parquet(str(out / "summary")).first().runtime > 0
    cli.main(["convert", str(tmp_path), "-o", str(tmp_path / "tables")])
    cli.main(["fit", str(tmp_path / "tables"), bed, "-o", str(tmp_path / "again"), "--max-weight", "2"])
    first, again = (spark.read.parquet(str(p)).where("section = 'PARAMETERS' AND key IN ('Rho', 'Lambda')").select("key", F.col("value").cast("double")) for p in (out / "model", tmp_path / "again" / "model"))
    assert abs(dict(again.collect())["Lambda"] - dict(first.collect())["Lambda"]) < 1e-12
    assert spark.read.parquet(str(out / "summary")).first()["mode"] == "Expectation"


def test_tree_command_restarts(spark, database, tmp_path):
    from intervale import cli

    for name in ("db", "chroms", "tags"):
        (tmp_path / f"mono.{name}").rename(tmp_path / f"monoDB.{name}")
    (tmp_path / "polyn.bedg").write_text((tmp_path / "poly.bedg").read_text())
    write(tmp_path / "set.txt", DEFINITION)
    runs = tmp_path / "runs"
    runs.mkdir()
    write(runs / "ANN.bedg", "chr1\t0\t120\t1\nchr1\t120\t200\t2\nchr2\t0\t150\t2\n")
    write(runs / "E1.bedg", "chr1\t0\t90\t101\nchr1\t90\t200\t302\nchr2\t0\t150\t201\n")
    write(tmp_path / "g.bed", "chr1\t0\t200\nchr2\t0\t150\n")
    base = ["tree", str(tmp_path / "set.txt"), str(tmp_path), str(runs), "--genome", str(tmp_path / "g.bed"), "--cells", "E1", "--min-gain", "-1000", "--max-depth", "2"]
    cli.main([*base, "-o", str(tmp_path / "one"), "--levels", "1", "--expected"])
    first = spark.read.parquet(str(tmp_path / "one" / "nodes"))
    assert {r.status for r in first.collect()} == {"split", "pending"}
    report = spark.read.parquet(str(tmp_path / "one" / "partitions"))
    assert report.where("best").count() == 1 and "expected_bits" in report.columns
    assert spark.read.parquet(str(tmp_path / "one" / "singles")).count() > 0
    cli.main([*base, "-o", str(tmp_path / "two"), "--restart", str(tmp_path / "one" / "nodes")])
    assert {r.status for r in spark.read.parquet(str(tmp_path / "two" / "nodes")).collect()} <= {"split", "leaf"}
