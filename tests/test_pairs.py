"""Pairs, ranking, texts, structure, graph, clusters, decisions."""

import json
import random
import subprocess
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seams.config import EngineConfig
from seams.functions import text as T
from seams.operators import clusters, feedback, graph, pairs, rank, similarity, structure
from seams.schemas import FEATURES

BEHAVIOR = "comp_a string, comp_b string, " + ", ".join(f"{c} double" for c in FEATURES[6:10])
EVOLUTION = "comp_a string, comp_b string, " + ", ".join(f"{c} double" for c in FEATURES[10:14])


def build(spark, edges=(), sims=(), behavior=(), evolution=(), units=None, semantic=()):
    units = units or [("A", ["os", "sys", "json"], ["X", "Y"], ["controller"]), ("B", ["os", "sys", "re"], ["Y"], ["repository"]), ("C", [], [], ["controller"])]
    u = spark.createDataFrame(units, "unit_id string, imports array<string>, annotations array<string>, domain_hints array<string>")
    e = spark.createDataFrame(list(edges), "source string, target string, kind string, weight bigint")
    s = spark.createDataFrame(list(sims), "a string, b string, sim double")
    b, h = spark.createDataFrame(list(behavior), BEHAVIOR), spark.createDataFrame(list(evolution), EVOLUTION)
    c = spark.createDataFrame([("A", 0.3, 0.1), ("B", 0.5, 0.2)], "unit_id string, pagerank double, betweenness double")
    found = pairs.candidates(e, s, b, h, u)
    rows = pairs.assemble(found, u, e, s, spark.createDataFrame(list(semantic), "a string, b string, sim double"), c, b, h)
    return {(r.comp_a, r.comp_b): r for r in rows.collect()}


def test_feature_names():
    assert len(FEATURES) == len(set(FEATURES)) == 19


def test_candidates(spark):
    got = build(spark, [("C", "A", "import", 1), ("B", "A", "import", 2), ("A", "Ghost", "import", 1)], [("B", "C", 0.01)])
    assert set(got) == {("A", "B"), ("A", "C")}
    assert set(build(spark, sims=[("B", "C", 0.8)])) == {("B", "C")}
    assert set(build(spark, behavior=[("B", "A", 0.1, 0.0, 0.0, 0.0)])) == {("A", "B")}
    assert set(build(spark, evolution=[("A", "C", 0.1, 0.0, 0.0, 0.0)])) == {("A", "C")} and not build(spark)


def test_features(spark):
    got = build(spark, [("A", "B", "import", 7), ("B", "A", "import", 3), ("A", "C", "inheritance", 1)], [("A", "B", 0.6)], [("B", "A", 0.8, 3.0, 0.6, 0.9)], [("A", "B", 0.3, 1.5, 0.7, 0.85)], semantic=[("B", "A", 0.4)])
    r, c = got["A", "B"], got["A", "C"]
    assert (r.structural_coupling_weight, r.tfidf_cosine_similarity, r.semantic_similarity, r.shared_import_count, r.shared_annotation_count) == (7.0, 0.6, 0.4, 2.0, 1.0)
    assert (r.inheritance_linked, c.inheritance_linked, r.cross_layer_flag, c.cross_layer_flag) == (0.0, 1.0, 1.0, 0.0)
    assert (r.pagerank_a, r.betweenness_a, r.pagerank_b, r.betweenness_b) == (0.3, 0.1, 0.5, 0.2)
    assert [r[f] for f in FEATURES[6:14]] == [0.8, 3.0, 0.6, 0.9, 0.3, 1.5, 0.7, 0.85] and c.runtime_call_frequency == 0.0


def test_labels(spark):
    schema = "comp_a string, comp_b string, label int, seq bigint"
    stored = spark.createDataFrame([("A", "B", 1, 0), ("B", "A", 0, 1), ("B", "C", 1, 2)], schema)
    given = spark.createDataFrame([("C", "B", 0, 0), ("A", "B", None, 1)], schema)
    assert {(r.comp_a, r.comp_b): r.label for r in pairs.merge_labels(stored, given).collect()} == {("A", "B"): 0, ("B", "C"): 0}


def test_tokens_and_names(spark):
    cases = {"OrderService": ["order", "service", "rder", "ervice"], "HTTPServer": ["http", "server", "erver"], "USER_ID": ["use"], "A-B-CDE": ["cde"]}
    frame = spark.createDataFrame([(c,) for c in cases], "s string")
    assert {r.s: r.t for r in frame.select("s", T.tokenize(F.col("s")).alias("t")).collect()} == cases
    named = spark.createDataFrame([("x.OrderService", "y.PayDao"), ("x.Service", "y.Repo")], "a string, b string").select(T.suggest_name(F.col("a"), F.col("b")).alias("n"))
    assert [r.n for r in named.collect()] == ["OrderService", "x.ServiceService"]


@pytest.mark.parametrize(("n", "sizes"), [(500, [500, 50]), (451, [451]), (461, [461, 11]), (10, []), (0, [])])
def test_chunks(spark, n, sizes):
    frame = spark.createDataFrame([(" ".join(["w"] * n),)], "s string")
    assert [len(c.text.split()) for c in frame.select(T.chunks(F.col("s")).alias("c")).first().c] == sizes


def test_tfidf_equals_plain_numbers(spark):
    texts = {"a": "red blue red green", "b": "red blue yellow", "c": "green yellow yellow blue red blue"}
    rows = {(r.unit, r.term): r.weight for r in similarity.tfidf(spark.createDataFrame(list(texts.items()), "unit string, text string")).collect()}
    grams = {u: [w for w in t.split()] + [" ".join(x) for x in zip(t.split(), t.split()[1:])] for u, t in texts.items()}
    vocabulary = sorted({g for x in grams.values() for g in x})
    raw = {u: np.array([x.count(g) * (np.log(4 / (1 + sum(g in y for y in grams.values()))) + 1) for g in vocabulary]) for u, x in grams.items()}
    for u, v in raw.items():
        v = v / np.linalg.norm(v)
        for g, x in zip(vocabulary, v):
            assert rows.get((u, g), 0.0) == pytest.approx(x)


@pytest.mark.parametrize(("most", "least", "words"), [(7, None, 500_000), (12, 3, 500_000), (7, None, 2), (40, 1, 500_000)])
def test_tfidf_counts_only_what_can_be_chosen(spark, monkeypatch, most, least, words):
    """The most frequent terms, by all counts; rare pairs are not counted by unit."""
    monkeypatch.setattr(similarity, "MOST_WORDS", words)
    rng = random.Random(5)
    texts = [(f"u{i % 7}", " ".join(f"w{min(int(rng.expovariate(0.4)), 15)}" for _ in range(rng.randrange(25)))) for i in range(60)] + [("u0", None), ("u1", "")]
    counts = {}
    for u, t in texts:
        w = (t or "").split()
        for term in w + [" ".join(x) for x in zip(w, w[1:])]:
            counts.setdefault(term, {}).setdefault(u, 0)
            counts[term][u] += 1
    kept = sorted((t for t, n in counts.items() if len(n) >= (least or 2)), key=lambda t: (-sum(counts[t].values()), t))[:most]
    raw = {(u, t): n * (np.log(8 / (1 + len(counts[t]))) + 1) for t in kept for u, n in counts[t].items()}
    norm = {u: np.sqrt(sum(x * x for (v, _), x in raw.items() if v == u)) for u, _ in raw}
    frame = spark.createDataFrame(texts, "unit string, text string")
    chosen = similarity.vocabulary(frame, most, least or 2)
    assert {r.term for r in chosen.collect()} == set(kept)
    got = {(r.unit, r.term): r.weight for r in similarity.tfidf(frame, most, least).collect()}
    assert got == pytest.approx({(u, t): x / norm[u] for (u, t), x in raw.items()})


@pytest.mark.parametrize(("most", "parts"), [(100_000, 1_000_000), (100_000, 500), (10, 1_000_000)])
def test_word_vectors_of_any_vocabulary(spark, monkeypatch, most, parts):
    """Words of one subject are near each other, whether the driver holds the vocabulary or not; units are the mean of their rows."""
    monkeypatch.setattr(similarity, "MOST_VOCABULARY", most)
    monkeypatch.setattr(similarity, "PARTITION_WORDS", parts)
    monkeypatch.setattr(similarity.skipgram, "STRETCH", 4000)
    rng = random.Random(3)
    rows = [(u, [f"{u[0]}{rng.randrange(12)}" for _ in range(40)]) for u in ("a1", "a2", "b1", "b2") for _ in range(60)] + [("a1", [])]
    texts = spark.createDataFrame(rows, "unit string, words array<string>").coalesce(2)
    model = similarity.word_vectors(texts.select("words"), size=8, rounds=5)
    assert isinstance(model, type(texts)) == (most == 10)  # else the driver has all words
    table = model if most == 10 else None
    units = similarity.mean_vectors(similarity.unit_vectors(model, texts, 8), 8)
    got = {r.unit: np.array(r.v) for r in units.collect()}
    cos = lambda x, y: got[x] @ got[y] / np.linalg.norm(got[x]) / np.linalg.norm(got[y])
    assert min(cos("a1", "a2"), cos("b1", "b2")) > 0.9 > 0.5 > max(cos(x, y) for x in ("a1", "a2") for y in ("b1", "b2"))
    if table is not None:
        v = {r.word: np.array(r.v) for r in table.collect()}
        assert set(v) == {w for _, x in rows for w in x}
        want = np.mean([np.mean([v[w] for w in x], axis=0) if x else np.zeros(8) for u, x in rows if u == "a1"], axis=0)
        assert got["a1"] == pytest.approx(want)


def test_pagerank_both_ways(spark):
    rng = random.Random(3)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(20)], "unit_id string")
    edges = spark.createDataFrame([(f"n{rng.randrange(15)}", f"n{rng.randrange(20)}", rng.randrange(1, 5)) for _ in range(40)], "source string, target string, weight bigint")
    near = {r.unit_id: r.pagerank for r in graph.pagerank(nodes, edges, rounds=4, tolerance=0).collect()}
    far = {r.unit_id: r.pagerank for r in graph.pagerank(nodes, edges, rounds=4, tolerance=0, most=0, every=2).collect()}
    assert sum(near.values()) == pytest.approx(1) and all(far[k] == pytest.approx(v) for k, v in near.items())


def test_betweenness_on_a_path_and_a_star(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "unit_id string")
    path = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "source string, target string, weight bigint")
    got = {r.unit_id: r.betweenness for r in graph.betweenness(nodes, path).collect()}
    assert got == pytest.approx({"a": 0, "b": 2 / 6, "c": 2 / 6, "d": 0})
    heavy = spark.createDataFrame([("a", "b", 1), ("b", "d", 1), ("a", "c", 5), ("c", "d", 1)], "source string, target string, weight bigint")
    assert {r.unit_id: r.betweenness for r in graph.betweenness(nodes, heavy).collect()}["c"] == 0


def test_clusters_are_found():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (20, 3)), [[50.0, 50, 50]]])
    labels = clusters.hdbscan(points)
    assert labels[-1] == -1
    a, b = labels[:20], labels[20:40]
    assert {x for x in a if x >= 0}.isdisjoint({x for x in b if x >= 0}) and (a >= 0).mean() > 0.5 and (b >= 0).mean() > 0.5
    assert set(clusters.hdbscan(points[:4])) == {-1}


def scored(spark, n=60, labels=True):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        y = i % 2
        rows.append((f"a{i:02}", f"b{i:02}", *[float(rng.random() + (y if f in FEATURES[:2] else 0)) for f in FEATURES[:-1]], float(i % 7 == 0), y if labels else None))
    return spark.createDataFrame(rows, "comp_a string, comp_b string, " + ", ".join(f"{f} double" for f in FEATURES) + ", label int")


def test_composite(spark):
    frame = rank.channels(scored(spark))
    weights = rank.adaptive_weights(frame, frame)
    w = weights.first()
    assert w.adapted == 1 and w.w_structural + w.w_behavioral + w.w_evolutionary == pytest.approx(1)
    few = rank.adaptive_weights(frame, frame.limit(4)).first()
    assert (few.w_structural, few.adapted) == (0.4, 0)
    ranked = rank.composite(frame, weights).collect()
    assert len(ranked) == 60 and all(0 <= r.boundary_score <= 1 for r in ranked) and len(ranked[0].rationale) == 8
    one = rank.composite(rank.channels(scored(spark, 1)), weights).first()
    assert one.boundary_score == pytest.approx(0.15)
    assert rank.composite(rank.channels(scored(spark).limit(0)), weights).count() == 0


def test_supervised(spark):
    frame = scored(spark).cache()
    assert rank.train(frame.limit(19)) is None
    config = EngineConfig(trees=8)
    model = rank.train(frame, config)
    rows = {r.comp_a: r for r in rank.supervised(frame, model).collect()}
    truth = {r.comp_a: r.label for r in frame.collect()}
    assert np.mean([(rows[k].boundary_score > 0.5) == y for k, y in truth.items()]) > 0.8
    assert all(len(r.rationale) == 8 for r in rows.values())
    assert list(rank.importances(model).values()) == sorted(rank.importances(model).values(), reverse=True)
    uneven = frame.where("label = 0 or comp_a < 'a11'")
    made = {r.label: r["count"] for r in rank.smote(uneven).groupBy("label").count().collect()}
    assert made[0] == made[1]


def labelled_pairs(spark, n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = int(i % 5 == 0)
        rows.append((f"a{i:04}", f"b{i:04}", *[rng.random() + 0.3 * label for _ in FEATURES], label))
    rows += [(f"c{i}", "d", *rows[0][2:]) for i in range(2)]  # equal rows
    return spark.createDataFrame(rows, "comp_a string, comp_b string, " + ", ".join(f"{f} double" for f in FEATURES) + ", label int")


def test_resampled_rows_lie_between_neighbours(spark):
    frame = labelled_pairs(spark, 300)
    began = time.time()
    rows = rank.smote(frame).collect()
    assert time.time() - began < 60  # the plan once grew without end
    own = [np.array(r[2:-1], float) for r in frame.where("label = 1").collect()]
    made = [np.array(r[:-1], float) for r in rows if r.label == 1]
    assert sum(r.label == 0 for r in rows) == len(made) == 240
    old = {tuple(x) for x in own}
    near = []
    for i, x in enumerate(own):
        far = sorted((((x - y) ** 2).sum(), j) for j, y in enumerate(own) if i != j)
        near += [(x, own[j]) for d, j in far if d <= far[2][0] + 1e-12]

    def between(x, a, b):
        length = ((b - a) ** 2).sum()
        t = (x - a) @ (b - a) / length if length else 0
        return -1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * (b - a), x)

    fresh = [x for x in made if tuple(x) not in old]
    assert all(any(between(x, a, b) for a, b in near) for x in fresh)
    assert len(fresh) > 100
    assert rank.smote(frame.limit(0)).count() == 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(rank, "MOST_MINORITY", 5)
        with pytest.raises(rank.TooMany):
            rank.smote(frame)


def test_boosting_stops_early_and_models_are_loaded(spark, tmp_path):
    assert rank.stop_after([3, 2, 1, 1, 1, 1], 3) == 6 and rank.stop_after([3, 2, 1], 3) is None and rank.stop_after([1, 2, 2], 2) == 3
    frame = labelled_pairs(spark, 60)
    model = rank.train(frame, EngineConfig(trees=6, patience=1))
    assert 1 <= model.getNumTrees <= 6
    short = rank._first_trees(model, 1)
    assert short.getNumTrees == 1 and 0 <= rank.supervised(frame, short).first().boundary_score <= 1
    rank.save(model, str(tmp_path / "m"))
    again = rank.load(str(tmp_path / "m"))
    assert [r.boundary_score for r in rank.supervised(frame, again).orderBy("comp_a").collect()] == [r.boundary_score for r in rank.supervised(frame, model).orderBy("comp_a").collect()]
    assert rank.load(str(tmp_path / "none")) is None


def test_cross_validation(spark):
    got = rank.cross_validate(labelled_pairs(spark, 60), EngineConfig(trees=4), folds=3).collect()
    assert [r.fold for r in got] == [0, 1, 2] and all(0 <= r.auc <= 1 for r in got)
    assert got[0].mean == pytest.approx(np.mean([r.auc for r in got])) and got[0].std == pytest.approx(np.std([r.auc for r in got]))


def test_ranks_leave_out_unknown_ends(spark):
    nodes = spark.createDataFrame([("a",), ("c",)], "unit_id string")
    edges = spark.createDataFrame([("a", "c", 1), ("a", "b", 5), ("z", "c", 5)], "source string, target string, weight long")
    plain = {r.unit_id: r.pagerank for r in graph.pagerank(nodes, edges.limit(1)).collect()}
    for most in (100, 0):
        assert {r.unit_id: pytest.approx(r.pagerank) for r in graph.pagerank(nodes, edges, most=most).collect()} == plain


def test_feedback_log(spark, tmp_path):
    log = feedback.FeedbackLog(spark, f"{tmp_path}/log")
    assert log.stats().first().last_updated == "never"
    log.record("A", "B", 1)
    log.record("B", "A", 0)
    assert [(r.comp_a, r.comp_b, r.label) for r in log.entries().collect()] == [("B", "A", 0)]
    rows = spark.createDataFrame([("C", "D", "true", 0), ("", "D", "1", 1), ("E", "F", None, 2), ("E", "F", "maybe", 3), ("G", "H", "0", 4)], "comp_a string, comp_b string, label string, seq bigint")
    assert log.bulk(rows) == (2, 3)
    assert log.delete("D", "C") and not log.delete("D", "C") and not log.delete("x", "y")
    s = log.stats().first()
    assert (s.total, s.accepted, s.rejected) == (2, 0, 2)
    log.compact()
    assert log.clear() == 2 and log.entries().count() == 0


@pytest.mark.parametrize(("yes", "no", "enough"), [(3, 6, 0), (3, 7, 1), (2, 20, 0)])
def test_sufficiency(spark, yes, no, enough):
    rows = spark.createDataFrame([(1, "t")] * yes + [(0, "t")] * no, "label int, decided_at string")
    assert feedback.sufficiency(feedback.stats(rows)).first().sufficient == enough


def test_module_ids_and_parsers():
    assert structure.module_id("src/app/a/b.py") == "a.b"
    unit = structure.parse_python("x/y.py", 'import os, a.b\nfrom m import z\nfrom . import q\n# note\nclass UserService(Base):\n    """Doc."""\n    def go(self):\n        if 1 and 2: pass\n')
    assert unit["imports"] == ["os", "a.b", "m"] and unit["class_names"] == ["UserService"] and unit["domain_hints"] == ["service"] and unit["comments"] == "Doc. note"
    assert structure.parse_python("x/bad.py", "def (")["unit_id"] == "bad"
    java = structure.parse_java("A.java", "package p.q;\nimport a.b.C;\n/* note */\n@Service\npublic class OrderService extends Base {\n public void run(int x) { if (x > 0) { go(); } }\n class Inner { }\n}\ninterface I {}")
    assert java["class_names"] == ["p.q.OrderService", "p.q.Inner"] and java["imports"] == ["a.b.C"] and java["annotations"] == ["Service"] and "run" in java["method_names"] and "if" not in java["method_names"]
    assert structure.parse_generic("a.js", "// one\nx = 1 # two")["comments"] == " one  two"


def test_imports(spark):
    units = spark.createDataFrame([(0, "u0", ["a.B"]), (1, "u1", ["c.B", "a.B.c"]), (2, "none", [])], "unit_idx bigint, unit_id string, class_names array<string>")
    table = {r.symbol: r.unit_id for r in structure.symbol_table(units).collect()}
    assert table == {"a.B": "u0", "u0": "u0", "B": "u0", "c.B": "u1", "a.B.c": "u1", "u1": "u1", "c": "u1"}
    asked = spark.createDataFrame([("s", 0, "a.B.c.d"), ("s", 1, "x.B"), ("s", 2, "no.thing")], "source string, pos int, name string")
    small = structure.symbol_table(units.where("unit_idx = 0"))
    assert {r.pos: r.target for r in structure.resolve_imports(asked, small).collect()} == {0: "u0", 1: "u0", 2: None}


@pytest.mark.parametrize("most", [200_000, 1])
def test_imports_are_not_sent_to_the_driver(spark, monkeypatch, most):
    """Only the symbols may be broadcast; repeated and unresolved imports, and those without a name or source, stay."""
    monkeypatch.setattr(structure, "MOST_SYMBOLS", most)
    rows = [("s", 0, "a.B.C"), ("s", 0, "a.B.C"), ("s", 1, "none.at"), ("s", 2, None), (None, 3, "a.B"), ("s", 4, "z.B")]
    imports = spark.createDataFrame(rows, "source string, pos int, name string")
    symbols = spark.createDataFrame([("a.B", "U"), ("B", "V")], "symbol string, unit_id string")
    found = structure.resolve_imports(imports, symbols)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted([("s", 0, "a.B.C", "U"), ("s", 0, "a.B.C", "U"), ("s", 1, "none.at", None), ("s", 2, None, None), (None, 3, "a.B", None), ("s", 4, "z.B", "V")], key=key)
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastHashJoin") == (most > 1)


def test_whole_analysis(spark, tmp_path):
    from seams.plans.engine import Engine

    root = tmp_path / "project"
    (root / "src").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "node_modules").mkdir()
    code = {"src/orders.py": "import payments\nclass OrderService:\n    def place(self): pass\n", "src/payments.py": "class PaymentService:\n    def pay(self): pass\n", "src/__init__.py": "", "src/_store.py": "from orders import OrderService\nclass OrderStore: pass\n", "node_modules/x.py": "class No: pass\n", "web.js": "// view\nlet x = 1;\n"}
    for p, t in code.items():
        (root / p).write_text(t)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for i in range(4):
        (root / "src/orders.py").write_text(code["src/orders.py"] + f"# {i}\n")
        (root / "src/payments.py").write_text(code["src/payments.py"] + f"# {i}\n")
        git("add", "-A")
        git("commit", "-qm", f"change {i}")
    trace = tmp_path / "trace.log"
    trace.write_text("CALL OrderService -> PaymentService [depth=2]\n" * 4)
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# Design\n" + "the order service calls the payment service " * 10)
    labels = tmp_path / "labels.json"
    labels.write_text(json.dumps([{"comp_a": "orders", "comp_b": "payments", "label": 1, "_comment": "x"}, {"comp_a": "a", "comp_b": "b", "label": None}]))
    config = EngineConfig(code_roots=(str(root),), document_folder=str(docs), trace_files=(str(trace), str(tmp_path / "missing.log")), repository=str(root), labels_file=str(labels), output=str(tmp_path / "out"), top_k=5)
    result = Engine(spark, config).analyze()
    units = {r.unit_id: r for r in result.units.collect()}
    assert {"orders", "payments", "__init__", "_store", "web"} <= set(units) and units["web"].language == "javascript"
    rows = {(r.comp_a, r.comp_b): r for r in result.features.collect()}
    r = rows["orders", "payments"]
    assert r.runtime_call_frequency in (0.0, 1.0) and r.co_change_frequency > 0 and r.label == 1
    report = json.loads((tmp_path / "out/report.json").read_text())
    assert report["meta"]["mode"] == "composite" and report["units_scanned"] == len(units) and len(report["top_boundaries"]) <= 5 and len(report["commits"]) == 4
    nothing = Engine(spark, EngineConfig(code_roots=(str(tmp_path / "none"),))).analyze()
    assert nothing.ranked is None


def test_ranking_is_written_when_clusters_and_betweenness_are_refused(spark, tmp_path, monkeypatch):
    from seams.plans.engine import Engine

    (tmp_path / "src").mkdir()
    for name, text in {"orders": "from payments import PaymentService\nclass OrderService: pass\n", "payments": "class PaymentService: pass\n", "store": "from orders import OrderService\nclass OrderStore: pass\n"}.items():
        (tmp_path / "src" / f"{name}.py").write_text(text)
    monkeypatch.setattr(graph, "MOST_EDGES", -1)
    monkeypatch.setattr(clusters, "MOST_UNITS", 0)
    result = Engine(spark, EngineConfig(code_roots=(str(tmp_path / "src"),), output=str(tmp_path / "out"))).analyze()
    report = json.loads((tmp_path / "out/report.json").read_text())
    assert set(result.refused) == {"betweenness", "clusters"} == set(report["meta"]["refused"])
    assert report["top_boundaries"] and report["service_clusters"] == {} and result.clusters is None
    assert {(r.betweenness_a, r.betweenness_b) for r in result.features.collect()} == {(0.0, 0.0)}


def test_docx_and_broken_documents(spark, tmp_path):
    import zipfile

    from seams.sources.documents import extract, read_documents
    from seams.sources.source_tree import read_files

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>One two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.html").write_text("<html><head><title>x</title></head><script>no()</script><p>" + "an entity table &amp; schema " * 5 + "</p></html>")
    got = {r.name: r for r in extract(read_files(spark, str(tmp_path), (".docx", ".html"), False, True)).collect()}
    assert got["a.docx"].text == "One two cell" and got["b.docx"].error and got["b.docx"].text is None and "no()" not in got["c.html"].text
    assert [r.doc_type for r in read_documents(spark, str(tmp_path)).collect()] == ["data-model"]


def test_stream_of_calls(spark, tmp_path):
    from seams.streaming.traces import read_stream, stream_calls

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("CALL a -> b [depth=1]\nCALL a -> b\nnothing\n")
    q = stream_calls(read_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("calls").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert [(r.component, r.target, r.calls, r.depth_sum) for r in spark.table("calls").collect()] == [("a", "b", 2, 1)]


def test_stream_of_windows_equals_the_batch(spark, tmp_path):
    from seams.operators.behavior import parse_lines, window_pairs
    from seams.streaming.traces import read_stream, stream_windows

    (tmp_path / "in").mkdir()
    rng = random.Random(4)
    lines = [f"2024-01-01 10:00:{s:02} - {rng.choice('abc')}x - INFO m" for s in sorted(rng.randrange(60) for _ in range(80))]
    (tmp_path / "in/a.log").write_text("\n".join(lines))
    q = stream_windows(parse_lines(read_stream(spark, str(tmp_path / "in")))).writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r.before, r.after): r.n for r in spark.table("windows").groupBy("before", "after").agg(F.sum("n").alias("n")).collect()}
    batch = parse_lines(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, seq bigint, line string"))
    assert got == {(r.before, r.after): r.n for r in window_pairs(batch).collect()}


def test_stream_drops_late_events(spark, tmp_path):
    from seams.streaming.traces import stream_windows

    (tmp_path / "in").mkdir()
    schema = "file string, seq bigint, ts bigint, component string"
    events = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = stream_windows(events).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start()
    for n, rows in enumerate([[(0, 100, "a"), (1, 102, "b")], [(2, 200, "c"), (3, 201, "a")], [(4, 101, "d"), (5, 202, "b")]]):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps({"file": "f", "seq": s, "ts": t, "component": c}) for s, t, c in rows))
        q.processAllAvailable()
    q.stop()
    assert {(r.before, r.after, r.n) for r in spark.table("late").collect()} == {("a", "b", 1), ("c", "a", 1), ("c", "b", 1)}  # a to b again is a row of its own batch
    assert sum(r.n for r in spark.table("late").collect()) == 4
