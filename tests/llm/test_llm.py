from __future__ import annotations

import warnings
from collections import Counter
from pathlib import Path

import numpy as np
import oracle
import pytest
from conftest import days
from pyspark.sql import functions as F

from kisaran.llm import aliases, clusters, consensus, mixing, packing, queries, subjects, tokens

BASE = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(BASE).exists(), reason="no test tables")


@tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    df = queries.QUERIES[name](spark, BASE)
    if name in queries.SQL:
        assert oracle.compare(df, oracle.connect(BASE), queries.SQL[name]) == ""
    else:
        assert df.count() > 0


# ---- names

LIST = [("Jagung Pipil", "jagung"), ("Jeruk Manis", "jeruk"), ("Kecap Manis", "kecap"), ("Gula Aren", "gula-aren"), ("Gula Aren Semut", "gula-aren"), ("Gula Batu", "gula-batu"), ("Minyak Kelapa", "minyak"), ("Susu Segar", "susu"), ("Kacang Tanah", "kacang")]


@pytest.fixture(scope="module")
def matcher():
    return aliases.Matcher(LIST)


@pytest.mark.parametrize(
    ("name", "slug"),
    [
        ("Harga Jagung Pipil (eceran)", "jagung"), ("JAGUNG\xa0PIPIL", "jagung"), ("pipil, jagung", "jagung"), ("jgung pippil", "jagung"), ("J4gung P1pil", "jagung"), ("Djagoeng Pipil", "jagung"),
        ("gula aren semut [pagi]", "gula-aren"), ("5usu sgr.", "susu"), ("myk klp", "minyak"), ("KACANG&NBSP;TANAH", "kacang"), ("tanahkacang", "kacang"), ("* ke​cap manis *", "kecap"), ("Minyak Kela", "minyak"),
        ("Jeruk Nipis", "unmatched"), ("Kecap Asin", "unmatched"), ("Gula Cair", "unmatched"), ("Minyak Tanah", "unmatched"), ("Minyak Kayu Putih", "unmatched"), ("Batu Bata", "unmatched"), ("Susu Kental", "unmatched"),
        ("", "unmatched"), ("   ", "unmatched"), ("​", "unmatched"), ("!!!", "unmatched"), (None, "unmatched"),
    ],
)
def test_match(matcher, name, slug):
    assert matcher.match(name)[0] == slug


def test_longest_mention_wins_and_none_overlap(matcher):
    m = matcher.mentions("campur gula aren semut dan gula batu")
    assert [x[2] for x in m] == ["gula-aren", "gula-batu"] and m[0][1] - m[0][0] == len("gula aren semut")


def test_very_long_name(matcher):
    assert matcher.match("x " * 50_000 + "jeruk manis")[0] == "jeruk"


def test_empty_list():
    assert aliases.Matcher([]).match("gula aren")[0] == "unmatched"


def test_map_names_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "gula aren", "a"), (2, "gula aren", "b"), (3, None, "c"), (4, "batu bata", "d")], "id int, entered string, slug string")
    got = {r.id: (r._slug, r.slug) for r in aliases.map_names(rows, "entered", LIST).collect()}
    assert got == {1: ("gula-aren", "a"), 2: ("gula-aren", "b"), 3: ("unmatched", "c"), 4: ("unmatched", "d")}
    assert aliases.map_names(rows.limit(0), "entered", LIST).count() == 0


# ---- clusters


def blobs(n=600, seed=2):
    rng = np.random.default_rng(seed)
    centres = np.array([(0, 0), (6, 0), (0, 6), (6, 6)])
    return np.vstack([rng.normal(c, 0.2, (n // 4, 2)) for c in centres]), np.repeat(np.arange(4), n // 4)


def test_tree_keeps_the_sums():
    x, _ = blobs()
    tree = clusters.CFTree(2, 0.05, max_leaves=60)
    for part in np.array_split(x, 7):
        tree.add_points(part)
    f = tree.summaries()
    assert len(f) <= 61 and f.n.sum() == len(x)
    assert np.allclose(f.ls.sum(axis=0), x.sum(axis=0)) and np.isclose(f.ss.sum(), (x**2).sum())


def test_ward_against_brute_force():
    x = np.random.default_rng(0).normal(0, 1, (9, 2))
    _, heights = clusters.ward(clusters.Features(np.ones(9), x, (x**2).sum(axis=1)))
    groups, want = [[i] for i in range(9)], []
    sse = lambda g: ((x[g] - x[g].mean(axis=0)) ** 2).sum()
    while len(groups) > 1:
        cost, a, b = min((sse(g + h) - sse(g) - sse(h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        want.append(cost)
        groups[a] = groups[a] + groups[b]
        del groups[b]
    assert np.allclose(heights, want)


def test_cluster_rows(spark):
    x, truth = blobs()
    data = [(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, truth))] + [(9001, 6.0, None, -1), (9002, None, None, -1), (9003, float("nan"), float("nan"), -1)]
    df = spark.createDataFrame(data, "id int, a double, b double, _hit int").repartition(5)
    got, centres = clusters.cluster_rows(df.withColumnRenamed("_hit", "t"), {"a": F.col("a"), "b": F.col("b")})
    rows = got.collect()
    assert len(centres) == 4
    pairs = Counter((r.t, r._cluster) for r in rows if r.t >= 0)
    assert len(pairs) == 4 and set(pairs.values()) == {150}
    by = {r.id: r._cluster for r in rows}
    assert by[9001] is not None and by[9002] is None and by[9003] is None
    told = clusters.describe(got, "id", 3).collect()
    assert sum(r.n_rows for r in told) == 601 and all(len(r.typical) == 3 for r in told)


def test_cluster_nothing(spark):
    df = spark.createDataFrame([], "id int, a double")
    got, centres = clusters.cluster_rows(df, {"a": F.col("a")})
    assert got.count() == 0 and len(centres) == 0


def test_cluster_equal_rows(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(20)], "id int, a double")
    assert {r._cluster for r in clusters.cluster_rows(df, {"a": F.col("a")})[0].collect()} == {0}


def test_missing_figures_come_from_the_prices(spark):
    d = days(60)
    p = 100 * np.exp(np.cumsum(np.random.default_rng(1).normal(0, 0.02, 60)))
    daily = spark.createDataFrame([(i, "g", "k", x, float(v), False, i) for i, (x, v) in enumerate(zip(d, p))], "point_id long, commodity string, region string, obs_date date, price_median double, is_imputed boolean, updated_at int")
    got = {r.period_month.month: r for r in clusters.monthly_features(daily).collect()}
    steps = np.diff(np.log(p[:31]))
    assert got[1].volatility == pytest.approx(steps.std(ddof=1)) and got[1].cum_change == pytest.approx(p[30] / p[0] - 1)


# ---- labels


def simulate(n_items=800, seed=3):
    rng = np.random.default_rng(seed)
    names = list(consensus.LABELS)
    good = np.array([0.95, 0.9, 0.9, 0.6, 0.5, 0.4, 0.35, 0.1])
    truth, rows = rng.choice(3, n_items, p=[0.35, 0.5, 0.15]), []
    for i, t in enumerate(truth):
        for a in rng.choice(8, 5, replace=False):
            label = t if rng.random() < good[a] else rng.choice([x for x in range(3) if x != t])
            rows.append((len(rows), i, f"a{a}" if rng.random() < 0.9 else f" A{a} ", names[label] if rng.random() < 0.9 else names[label].upper() + ".", len(rows)))
    return truth, rows


LABELS = "label_id long, candidate_id long, annotator_code string, label string, labeled_at long"


def test_messages_come_to_rest_or_tell(spark):
    """Two annotators who never agree flip every message each round; a bound that is
    too low is told."""
    quarrel = [(i, c, a, "anomali" if a == "A" else "normal") for i, (c, a) in enumerate((c, a) for c in range(6) for a in "AB")]
    edges = spark.createDataFrame([(c, a, x) for _, c, a, x in quarrel], "candidate_id long, annotator string, label string")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        _, weights = consensus.annotator_weights(edges)
    assert weights.count() == 2
    mixed = spark.createDataFrame([(c, a, x) for c in range(8) for a, x in zip("ABC", ["ragu", "ragu", "normal"] if c % 3 else ["normal", "anomali", "normal"])], edges.schema)
    with pytest.warns(RuntimeWarning, match="still move"):
        consensus.annotator_weights(mixed, max_rounds=1)


def test_consensus_beats_the_majority(spark):
    truth, rows = simulate()
    df = spark.createDataFrame(rows, LABELS)
    got = {r.candidate_id: r.label for r in consensus.consensus(df).collect()}
    names = list(consensus.LABELS)
    right = np.mean([got[i] == names[t] for i, t in enumerate(truth)])
    votes = {}
    for _, i, _, label, _ in rows:
        votes.setdefault(i, Counter())[label.lower().strip(".")] += 1
    plain = np.mean([max(sorted(votes[i]), key=votes[i].get) == names[t] for i, t in enumerate(truth)])
    assert right > 0.9 and right > plain + 0.08
    edges, weights = consensus.annotator_weights(consensus.usable_labels(df))
    told = {r.annotator: r for r in consensus.reliabilities(edges, weights).collect()}
    assert told["A0"].agreement > 0.9 > told["A3"].agreement > told["A7"].agreement
    assert told["A0"].reliability > told["A3"].reliability > told["A5"].reliability > told["A7"].reliability


def test_usable_labels(spark):
    rows = [(1, 1, "a1", "normal", 5), (2, 1, " A1", "ANOMALI", 9), (3, 1, "A1", None, 99), (4, 1, "b2", "ragu2", 1), (5, 1, "c3", "nrml", 1), (6, 1, None, "normal", 1), (7, None, "a1", "normal", 1), (8, 2, "d4", "xyz", 1), (9, 1, "c3", "normal.", 1)]
    got = {(r.candidate_id, r.annotator): r.label for r in consensus.usable_labels(spark.createDataFrame(rows, LABELS)).collect()}
    assert got == {(1, "A1"): "anomali", (1, "B2"): "ragu", (1, "C3"): "normal"}


def test_few_annotators_and_no_labels(spark):
    rows = [(i, 1, f"a{i}", "normal", 1) for i in range(3)] + [(9, 2, "a1", "ragu", 1), (10, 2, "a2", "ragu", 1)]
    assert [tuple(r)[:2] for r in consensus.consensus(spark.createDataFrame(rows, LABELS)).collect()] == [(1, "normal")]
    assert consensus.consensus(spark.createDataFrame([], LABELS)).count() == 0


# ---- tokens, packing, mixing

DOCS = "doc_id long, text string, source string"


def test_tokens_round_trip():
    enc = tokens.encoder(tokens.VOCABULARY)
    for text in ("Harga gula naik 5 persen.", "ünïcode ✓ ​ x", "a" * 70_000, "kata " * 20_000 + "x" * 45_000):
        assert enc.decode(tokens.encode(text)) == text


def test_nnls_against_grid():
    rng = np.random.default_rng(0)
    a, b = rng.random((8, 3)), rng.random(8)
    x = packing.nnls(a, b)
    grid = np.stack(np.meshgrid(*[np.linspace(0, 1.5, 31)] * 3), -1).reshape(-1, 3)
    assert (x >= 0).all() and ((a @ x - b) ** 2).sum() <= ((grid @ a.T - b) ** 2).sum(axis=1).min() + 1e-9


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_everything(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.3, 1, rng.integers(1, 4000)).astype(int), 1, 2048)
    groups = packing.plan(Counter(lengths.tolist()))
    held = Counter()
    for g in groups:
        used = sum(k * n for k, n in g.content.items())
        assert g.count > 0 and 0 <= g.room == 2048 - used
        for k, n in g.content.items():
            held[k] += n * g.count
    assert held == Counter(lengths.tolist())
    assert sum(g.count for g in groups) <= int(np.ceil(lengths.sum() / 2048) * 1.02) + 2


def test_pack(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(["harga"] * int(n)), "s") for i, n in enumerate(rng.integers(1, 900, 300))]
    docs += [(1000, "kata " * 9000, "s"), (1001, None, "s"), (1002, "", "s"), *[(2000 + i, "sama saja", "s") for i in range(150)]]
    df = spark.createDataFrame(docs, DOCS).withColumn("container", F.lit("clash")).repartition(6)
    rows = packing.pack(df, salts=8).collect()
    size = {i: len(tokens.encode(t)) for i, t, _ in docs if t}
    sums, by_doc = Counter(), Counter()
    for r in rows:
        sums[r.container] += r.n_tokens
        by_doc[r.doc_id] += r.n_tokens
    assert by_doc == Counter(size) and max(sums.values()) <= 2048
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert Counter(r.doc_id for r in rows if size[r.doc_id] <= 2048).most_common(1)[0][1] == 1
    assert len(sums) <= sum(size.values()) / 2048 * 1.02 + 2
    assert packing.pack(df.limit(0)).count() == 0


def test_budgets():
    got = {b.source: b for b in mixing.budgets([("a", 0.5, 1), ("b", 0.5, 4), ("c", 0.2, 2), ("d", 0.1, 0)][:2], {"a": 1000, "b": 300})}
    assert (got["a"].budget, got["b"].budget, got["b"].epochs, got["b"].rest) == (1000, 1000, 3, 100)
    empty = {b.source: b.budget for b in mixing.budgets([("a", 0.5, 2), ("x", 0.5, 2)], {"a": 10})}
    assert empty == {"a": 20, "x": 0}


def test_mix(spark):
    docs = [(i, f"dokumen nomor {i} tentang harga " * (1 + i % 5), "big" if i % 10 else "small") for i in range(600)] + [(9001, None, "big"), (9002, "tanpa sasaran", None), (9003, "lain", "other")]
    df = spark.createDataFrame(docs, DOCS).withColumn("key", F.lit(1))
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("none", 0.1, 1), ("big", None, 9)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, targets)
    told = {r.source: r for r in report.collect()}
    assert told["none"].mixed_tokens == 0
    share = {s: told[s].mixed_tokens / (told["big"].mixed_tokens + told["small"].mixed_tokens) for s in ("big", "small")}
    assert share["big"] == pytest.approx(0.7, abs=0.005)
    repeats = {r.doc_id: (r.source, r.repeats) for r in chosen.collect()}
    assert all(n <= (3 if s == "small" else 1) for s, n in repeats.values()) and not {9001, 9002, 9003} & set(repeats)
    counts = Counter(n for s, n in repeats.values() if s == "small")
    assert max(counts) - min(counts) <= 1  # whole epochs first
    again, _ = mixing.mix(df.repartition(7), targets)
    assert repeats == {r.doc_id: (r.source, r.repeats) for r in again.collect()}
    assert mixing.mix(df.limit(0), targets)[0].count() == 0 and mixing.mix(df, targets.limit(0))[0].count() == 0


def test_better_documents_are_taken_more_often(spark):
    docs = [(i, ("harga beras naik lagi hari ini " * 4) if i % 2 else ("<p>### 123 $$$ 456</p> ab " * 4), "s") for i in range(800)]
    df = spark.createDataFrame([*docs, *[(5000 + i, "x y z " * 40, "t") for i in range(20)]], DOCS)
    targets = spark.createDataFrame([("s", 0.5, 1), ("t", 0.5, 3)], "source string, target_share double, max_repeats int")
    taken = Counter(r.doc_id % 2 for r in mixing.mix(df, targets)[0].where("source = 's'").collect())
    assert taken[1] > 1.5 * taken[0]


# ---- subjects

TALK = {
    "weather": ["heavy rain and wind over the ridge", "the forecast sees fog and drizzle", "hujan dan angin di lembah", "prakiraan kabut pagi"],
    "law": ["the court dismissed the injunction", "a judge set the hearing", "pengadilan menjatuhkan denda", "majelis hakim menunda sidang"],
    "sport": ["the team won the match in the league", "a late goal took the cup", "pelatih dan penyerang menang di liga", "wasit memberi penalti"],
}


def corpus(n=240, seed=4):
    rng = np.random.default_rng(seed)
    docs, truth = [], {}
    for i in range(n):
        chosen = list(rng.choice(list(TALK), int(rng.integers(1, 3)), replace=False))
        said = [f"Today {rng.choice(TALK[s])} according to two callers." for s in chosen for _ in range(4)]
        other = next(s for s in TALK if s not in chosen)
        if rng.random() < 0.5:
            said.append(f"Today {TALK[other][0]} according to two callers.")
        rng.shuffle(said)
        docs.append((i, " ".join(said), "x"))
        truth[i] = set(chosen)
    return docs, truth


def test_subjects(spark):
    docs, truth = corpus()
    df = spark.createDataFrame([*docs, (9001, None, "x"), (9002, "", "x"), (9003, " ​ 123 !!", "x"), (9004, docs[0][1], "x")], DOCS).withColumn("subject", F.lit("clash"))
    got = {}
    for r in subjects.subject_areas(df).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert np.mean([got.get(i, set()) == s for i, s in truth.items()]) > 0.95
    assert not {9001, 9002, 9003} & set(got) and got[9004] == got[0]
    assert subjects.subject_areas(df.limit(0)).count() == 0


def test_mixtures_lower_the_divergence():
    rng = np.random.default_rng(0)
    v = rng.poisson(2.0, (6, 12)) + 0.0
    v[:, 0] += 1
    h = rng.random((3, 12))
    h /= h.sum(axis=1, keepdims=True)
    r, c = np.nonzero(v)
    loss = []
    for inner in (1, 3, 9, 27):
        w, _ = subjects.mixtures(r, c, v[r, c], 6, h, inner)
        wh = np.maximum(w @ h, 1e-12)
        loss.append((wh - v * np.log(wh)).sum())
    assert loss == sorted(loss, reverse=True)
    assert np.allclose(w.sum(axis=1), v.sum(axis=1), rtol=1e-3)
