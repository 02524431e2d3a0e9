"""Recipes, states, extensions, readers, search."""

import json
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import answers, vectors
from sluice.operators.registry import default_registry
from sluice.operators.score_filter import ExampleLengthFilter
from sluice.plans import extensions, recipe, task
from sluice.plans.state import StateComputer, delta
from sluice.search import evaluators, experiment, loop, proposers, report, space, surrogate
from sluice.sources import records, schema
from sluice.streaming import intake

CATALOG = {
    "families": {
        "budget": {"operators": {"truncate_samples": {"params": {"total_samples": {"default": 10, "range": [5, 100]}}}}},
        "quality": {"operators": {"ngram_entropy": {"params": {"fraction": {"default": 0.5, "range": [0.05, 1.0]}}}}},
    }
}


@pytest.fixture(scope="module")
def pool(spark, sf):
    return schema.documents_pool(spark.read.parquet(f"{sf}/documents.parquet")).cache()


def test_recipe_runs_step_by_step(spark, pool, tmp_path):
    seen = []

    class Hook:
        def after_step(self, step, rows, **_):
            seen.append((step.operator, rows))

    r = recipe.Recipe.of({"name": "a b/c", "steps": [{"operator": "semantic_dedup"}, {"operator": "ngram_entropy", "params": {"fraction": 0.5}, "enabled": False}, {"operator": "ngram_entropy", "params": {"top_k": 20}}, {"operator": "source_mix"}]})
    x = recipe.Executor(pool, min_viable=50, hooks=[Hook()])
    out = x.run(r)
    assert [o for o, _ in seen] == ["semantic_dedup", "ngram_entropy"] and out.rows == 20  # too few rows for the last step
    assert out.steps[1]["step_index"] == 2 and out.steps[1]["delta_glob"]["retain_ratio"] == round(20 / 200 - 1, 6)
    assert {r.sample_id for r in out.ids().collect()} <= {r.sample_id for r in pool.collect()}
    again = x.run(r)
    assert again.steps[0]["trace"]["cost"]["shared"] and [r.sample_id for r in again.ids().orderBy("ord").collect()] == [r.sample_id for r in out.ids().orderBy("ord").collect()]
    recipe.save(out, str(tmp_path), "t")
    assert recipe.load_ids(spark, str(tmp_path), "a b/c").count() == 20
    trace = json.loads(spark.read.text(f"{tmp_path}/a_b_c/trace").first()[0])
    assert trace["output_samples"] == 20 and len(trace["steps"]) == 2
    for steps in ([], [{"operator": "union", "enabled": False}]):
        with pytest.raises(ValueError):
            x.run(recipe.Recipe.of({"steps": steps}))


def test_same_rows_however_partitioned(spark, pool):
    r = recipe.Recipe.of({"steps": [{"operator": "semantic_dedup"}, {"operator": "ngram_entropy", "params": {"fraction": 0.5}}, {"operator": "truncate_samples", "params": {"total_samples": 40}}]})
    got = []
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append([x.sample_id for x in recipe.Executor(pool.repartition(int(n)), min_viable=0, observe=False).run(r).ids().orderBy("ord").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and len(got[0]) == 40


def test_catalog():
    r = recipe.Recipe.of({"operators": {"ngram_entropy": {"fraction": 0.3}, "truncate_samples": {}}}, CATALOG)
    assert [(s.operator, s.params) for s in r.steps] == [("truncate_samples", {"total_samples": 10}), ("ngram_entropy", {"fraction": 0.3})]
    for bad in ({"nope": {}}, {"ngram_entropy": {"nope": 1}}):
        with pytest.raises(ValueError, match="Unknown"):
            recipe.resolve(CATALOG, bad)
    assert recipe.clamp(CATALOG, "truncate_samples", {"total_samples": 1e9, "x": 1}) == {"total_samples": 100, "x": 1}
    assert recipe.deep_merge({"a": {"b": 1}}, {"a": {"c": [2]}, "d": 3}) == {"a": {"b": 1, "c": [2]}, "d": 3}


def test_extension_adds_operator_feature_hook_and_catalog(spark, monkeypatch):
    m = types.ModuleType("length_extension")
    m.register_operators = lambda registry: registry.register("example_length_filter", ExampleLengthFilter)
    m.precompute_features = lambda df, context: df.withColumn("example_length", F.length("text"))
    m.get_recipe_hooks = lambda: [object()]
    m.OPERATOR_CATALOG_PATCH = {"families": {"quality": {"operators": {"example_length_filter": {"params": {"max_chars": {"default": 10}}}}}}}
    monkeypatch.setitem(sys.modules, "length_extension", m)
    registry = default_registry()
    ext = extensions.load("length_extension, length_extension,", registry)
    assert "example_length_filter" in registry and len(ext.hooks) == 1
    assert "example_length_filter" in recipe.catalog_operators(ext.catalog(CATALOG))
    df = spark.createDataFrame([(1, "a", "unit", "short"), (2, "b", "unit", "this sample is intentionally longer")], "ord long, sample_id string, source_name string, text string")
    out = registry.create("example_length_filter", max_chars=10).apply(ext.features(df))
    assert [r.text for r in out.collect()] == ["short"]
    m.get_recipe_hooks = lambda: "text"
    with pytest.raises(TypeError):
        extensions.load("length_extension", default_registry())


def test_states(spark, pool):
    p = pool.withColumn("ifd", F.lit(0.5)).withColumn("mona_scores", F.create_map(F.lit("t"), F.lit(0.25)))
    c = StateComputer(p)
    whole, half = c.compute(p, same=True), c.compute(p.where("ord % 2 = 0").withColumn("ifd", F.lit(2.0)))
    assert (whole.retain_ratio, whole.mean_ifd, whole.mean_varentropy, whole.score_per_task) == (1.0, 0.5, 0.5, {"t": 0.25})
    assert half.mean_ifd == 1.0 and delta(half, whole)["retain_ratio"] == -0.5 and "score_per_task" not in delta(half, whole)
    none = c.compute(p.limit(0))
    assert (none.retain_ratio, none.mean_ifd) == (0.0, 0.5)


def test_readers_and_converters(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "dataset": "d", "messages": [{"role": "user", "content": "hi"}], "metadata": {"source_split": " Val "}}\n\n{"messages": []}\n')
    got = records.read_canonical(spark, str(tmp_path / "x.jsonl"))
    assert [(r.sample_id, r.source_name, (r.metadata or {"source_split": None})["source_split"]) for r in got.collect()] == [("1", "d", "dev"), ("unknown_id", "unknown_source", None)]
    assert [(r.sample_id, r.errors) for r in records.validate(got).collect()] == [("unknown_id", ["no messages"])]
    a = records.from_alpaca(spark.createDataFrame([("do", "this", "done"), ("do", "", "done")], "instruction string, input string, output string"), "s").collect()
    assert [m.messages[0].content for m in a] == ["do\n\nthis", "do"] and a[0].sample_id != a[1].sample_id and len(a[0].sample_id) == 32
    s = spark.createDataFrame([([("system", "be"), ("human", "q"), ("ghost", "x"), ("gpt", "a")], "7"), ([("human", "only")], "8")], "conversations array<struct<from:string,value:string>>, id string")
    s = records.from_sharegpt(s, "s").collect()
    assert [(r.sample_id, len(r.messages), r.target_text, r.has_system_prompt) for r in s] == [("7", 2, "a", True), ("8", 1, None, False)]
    o = spark.createDataFrame([([("user", "q", "w"), ("assistant", "a", None)], None), ([], None)], "messages array<struct<role:string,content:string,weight:string>>, id string")
    o = records.from_openai_chat(o, "s").collect()
    assert len(o) == 1 and o[0].target_text == "a" and o[0].messages[0].metadata == {"weight": "w"}
    t = spark.createDataFrame([("1", [("user", "a"), ("user", "b"), ("tool", "x")], "c"), ("2", [("user", "a")], None)], "sample_id string, messages array<struct<role:string,content:string>>, target_text string")
    (back,) = records.to_sharegpt(t).collect()
    assert [(x["from"], x.value) for x in back.conversations] == [("human", "a\nb"), ("gpt", "c")]
    records.write_records(t.withColumn("embedding", F.array(F.lit(1.0))), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["messages", "sample_id", "target_text"]
    with pytest.raises(Exception, match="unknown split"):
        spark.range(1).select(schema.split_name(F.lit("nope"))).collect()


def test_intake_takes_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.jsonl").write_text(json.dumps({"sample_id": str(i), "messages": []}) + "\n")
        q = intake.append(intake.arriving_records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert sorted(r.sample_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["0", "1", "2"]


def test_vectors_and_answers(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    assert [r[0] for r in df.limit(2).select(vectors.generalized_jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]
    with pytest.raises(Exception, match="unlike length"):
        df.select(vectors.dot(F.col("a"), F.col("b"))).collect()
    lp = np.log([[0.5, 0.5], [0.9, 0.1]])
    want = np.mean([(np.exp(x) * (x - (np.exp(x) * x).sum()) ** 2).sum() for x in lp])
    got = spark.createDataFrame([(lp.tolist(),)], "lp array<array<double>>").select(vectors.varentropy(F.col("lp")), vectors.ifd(F.lit(1.0), F.lit(0.0))).first()
    assert got[0] == pytest.approx(want) and got[1] == 1.0
    assert vectors.sampled_positions(500, "x") == vectors.sampled_positions(500, "x") != vectors.sampled_positions(500, "y") and vectors.sampled_positions(3, "x") == [0, 1, 2]
    with pytest.raises(ValueError):
        vectors.influence(df, spark.createDataFrame([(0, "c", [1.0])], "pos long, checkpoint string, v array<double>"), {"c": 0.0})
    opts = spark.range(1).select(answers.shuffled_options(F.lit("q"), F.array(*map(F.lit, "abcd")))).first()[0]
    assert sorted(opts) == list("abcd")


def test_space():
    seeds = space.warmup(6, 1000)
    assert [r.signature() for r in seeds] == [r.signature() for r in space.warmup(6, 1000)] and all(1 <= len(r.steps) <= 4 for r in seeds)
    points = space.latin_hypercube(8, 5)
    assert all(sorted((points[:, d] * 8).astype(int)) == list(range(8)) for d in range(5))
    assert space.DIMENSIONS == 17 and all(2 <= len(r.steps) <= 4 for r in space.designs(10, 5000))
    assert len(space.encode(seeds[0])) == 69
    acts = space.actions(recipe.Recipe.of({"steps": [{"operator": "ngram_entropy", "params": {"fraction": 1.0}}]}), CATALOG)
    assert {(a.kind, a.operator) for a in acts} == {("enable", "truncate_samples"), ("disable", "ngram_entropy"), ("adjust", "ngram_entropy")}
    assert proposers.json_in('so:\n```json\n{"a": [1]}\n``` ok') == {"a": [1]} and proposers.json_in("x [1, 2] y") == [1, 2] and proposers.json_in("none") is None
    (r,) = proposers.recipes_in('[{"steps": [{"operator": "ngram_entropy", "params": {"fraction": 7}}, {"operator": "bad"}]}]', CATALOG, ("ngram_entropy",), "p")
    assert [(s.operator, s.params) for s in r.steps] == [("ngram_entropy", {"fraction": 1.0})]


def test_surrogate():
    x = np.linspace(0, 1, 12)[:, None]
    y = np.sin(5 * x[:, 0])
    s = surrogate.Surrogate(noise=1e-4).fit(x, y)
    mean, sigma = s.predict(np.array([[0.33], [3.0]]))
    assert mean[0] == pytest.approx(np.sin(5 * 0.33), abs=0.05) and sigma[1] > sigma[0]
    assert surrogate.Surrogate().predict([[1.0]]) == (0.0, 1.0)


def test_search_keeps_its_budget_and_resumes(pool, tmp_path):
    p = pool.withColumn("ifd", F.col("ord") % 7 / 7.0).withColumn("varentropy", F.col("ord") % 5 / 5.0).withColumn("action_object", F.col("ord") % 3 / 3.0).withColumn("mona_score", F.col("ord") % 11 / 11.0)
    make = lambda n, log: loop.Search(recipe.Executor(p, min_viable=0), evaluators.MockEvaluator(), max_evaluations=n, warmups=2, candidates=2, threads=2, patience=2, log=str(tmp_path / log))
    whole = make(4, "a").run()
    make(3, "b").run()
    resumed = make(4, "b").run()
    assert len(whole) == 4 and [(e.recipe_name, round(e.score, 6)) for e in resumed] == [(e.recipe_name, round(e.score, 6)) for e in whole]
    assert len((tmp_path / "b").read_text().splitlines()) == 4 and "4 evaluations" in report.report(whole)
    assert report.trend([3.0, 0.5]) == "declining" and evaluators.utility(1.0, 1.0, 1.0) == 0.85
    s = evaluators.MockEvaluator().evaluate("n", {"retain_ratio": 1.0}).score
    assert s == evaluators.MockEvaluator().evaluate("n", {"retain_ratio": 1.0}).score and 70 < s < 80


def test_experiment(pool):
    x = experiment.Experiment(recipe.Executor(pool, min_viable=0, observe=False), lambda r: 1 - r.rows / 200, rounds=1, candidates=3)
    out = x.run()
    assert out == sorted(out, key=lambda r: -r.objective) and len(out) >= 3
    m = experiment.Metrics
    r = experiment.baselines()[5]
    assert experiment.diagnose(m(0.5, 1.0, 0.2), m(0.6, 2.0, 0.9), r) == ["LOW_TASK_FIT", "OVER_FILTER", "OVER_DEDUP"]
    assert experiment.diagnose(m(0.6, 1.0, 0.9, 2.0), m(0.6, 1.0, 0.9, 1.0), r) == ["HIGH_COST_LOW_GAIN"]
    assert m(0.5, 0.0, 0.2).objective() == round(0.5 - 0.12 * 0.5, 6)


def test_replies_are_read_as_their_benchmarks_say(spark):
    rows = [
        ("gpqa", "Answer: b\n(C)", "b", None, "B"), ("gpqa", "It may be.\n(B).\nno", "B", None, None), ("gpqa", "so\nc\n", "C", None, "C"),
        ("gpqa", "the answer is: A", "A", None, None), ("gpqa", "D", "D", None, "D"), ("gpqa", "D: yes", "D", None, None), ("mmlu", " (a) since", "A", None, "A"),
        ("bbh", "Answer:\nYes\nmore", "yes", None, "yes"), ("bbh", "x\n ..so  it\tis. ", "..so it is", None, "..so it is"),
        ("math500", "The Answer: 12\nthanks", "12", None, "12"), ("math500", "Answer: 50\\%", "50", None, False), ("math500", "Answer: $90^\\circ$", "90", None, False),
        ("math500", "Answer: \\boxed{\\dfrac{4}{2}}", "(4)/(2)", None, "(4)/(2)"), ("math500", "so \\boxed{4/2}", "2.0", None, "4/2"), ("math500", "Answer: \u22123\\pi \\cdot \\sqrt{2}", "-3pi*sqrt(2)", None, "-3pi*sqrt(2)"),
        ("math500", "x\nFinal answer: .5;", ".5", None, ".5"), ("math500", "Answer: 0.5", "1/2", None, False),
        ("graph", "There are 5 nodes.\nAnswer: 7", "7", "flow", "7"), ("graphwiz", "No path in A. Answer: Yes", "yes", "cycle", "yes"), ("graphwiz", "x\n### -4.", "-4", "shortest", "-4"),
        ("graphwiz", "a\nunknown", "no", "cycle", "no"), ("graphwiz", "Answer: 5", "5", "topology", "gone"),
        ("graph_yesno", "yes it is\nAnswer: no", "No.", None, "no"), ("graph_yesno", "no or yes", "yes", None, "yes"), ("graph_yesno", "hm", "perhaps", None, "gone"),
    ]
    for name, said, gold, kind, want in rows:
        df = spark.createDataFrame([(said, gold, kind)], "said string, gold string, kind string")
        got = answers.score(df, name, kind="kind" if kind else None).collect()
        if want == "gone":
            assert not got
        else:
            assert (got[0].correct, got[0].answer) == ((True, want) if want else (False, got[0].answer)), (name, said, got)
    df = spark.createDataFrame([("```python\na\n```\n```\nb\n```", True), ("```js\nx", False), ("Sure:\n\nx = 1\ny", None), ("Here\nimport a\nb", True)], "said string, gold boolean")
    assert [(r.answer, r.correct) for r in answers.score(df, "mbpp").collect()] == [("a", True), ("```js\nx", False), ("\nx = 1\ny", False), ("import a\nb", True)]
    with pytest.raises(KeyError):
        answers.score(df, "math")


def test_heavy_and_numeric_keys_leave_extra(spark, tmp_path):
    extra = '{"feature": [1], "ifd": {"score": 0.5}, "note": "5", "n": 5, "long": [' + ",".join("1" * 300) + '], "similarities": {"a": 1}}'
    df = spark.createDataFrame([("1", extra), ("2", "no json"), ("3", None), ("4", '{"a": "\u00e9"}')], "sample_id string, extra string")
    records.write_records(df.repartition(1), str(tmp_path / "out"))
    got = {r.sample_id: r.extra for r in spark.read.schema("sample_id string, extra string").json(str(tmp_path / "out")).collect()}
    assert got["1"] == '{"ifd": {"score": 0.5}, "note": "5", "n": 5, "similarities": {"a": 1}}'
    assert (got["2"], got["3"], got["4"]) == ("no json", None, '{"a": "\u00e9"}')
    text = {r.sample_id: r.extra for r in records.text_only(df.withColumn("ifd", F.lit(1.0))).collect()}
    assert '"ifd"' not in text["1"] and '"similarities"' not in text["1"] and '"feature"' in text["1"]
    assert records.text_only(df.withColumn("ifd", F.lit(1.0))).columns == ["sample_id", "extra"]


def test_encoding_is_bounded_and_empty_without_union():
    from sluice.plans.recipe import Recipe, Step

    one = Recipe("one", [Step("truncate_samples", {"total_samples": 1_000_000}, "t"), Step("semdedup", {"num_clusters": 50_000}, "s")])
    v = space.encode(one)
    n = (len(v) - 1) // 4
    assert v.max() == 1.0 and not v[n:].any()
    two = Recipe("two", [Step("union", {"source_recipe": "one"}, "u"), Step("mona_filter", {"fraction": 0.25}, "m")])
    assert space.encode(two)[-1] == 1.0 and not space.encode(two)[n:-1].any()
    known = space.encode(two, known={"one": one})
    assert (known[n : 2 * n] == v[:n]).all() and (known[3 * n : -1] == np.maximum(known[:n], v[:n])).all()
    assert space._slots("own_filter", {"jaccard_threshold": 0.3}) == [1.0, 0.3] and space._slots("own_filter", {"ratio": "x"}) == [1.0, 0.5]


def test_batch_task(spark, tmp_path, monkeypatch):
    m = types.ModuleType("length_extension")
    m.register_operators = lambda registry: registry.register("example_length_filter", ExampleLengthFilter)
    m.precompute_features = lambda df, context: df.withColumn("example_length", F.length("text"))
    hooked = []
    m.RECIPE_HOOKS = [types.SimpleNamespace(after_step=lambda step, rows, **_: hooked.append((step.operator, rows)))]
    m.OPERATOR_CATALOG_PATCH = {"families": {"quality": {"operators": {"example_length_filter": {"params": {"max_chars": {"default": 4}}}}}}}
    monkeypatch.setitem(sys.modules, "length_extension", m)
    (tmp_path / "catalog.json").write_text(json.dumps(CATALOG))
    (tmp_path / "a.jsonl").write_text("\n\n".join(json.dumps({"id": f"a{i}", "instruction": "do", "output": "x" * i}) for i in range(30)) + "\n")
    (tmp_path / "c.jsonl").write_text(json.dumps({"sample_id": "c0", "source_name": "c", "messages": [{"role": "user", "content": "short"}], "target": {"text": "one two"}}))
    (tmp_path / "own.jsonl").write_text(json.dumps({"key": 7, "q": "why", "a": "so"}))
    raw = {
        "task_name": "t", "output_dir": str(tmp_path / "out"), "recipe_catalog_path": "catalog.json", "extra": {"min_viable": 0},
        "train_sources": [{"path": f"{tmp_path}/{f}.jsonl", "source_name": n, "format": k} for f, n, k in (("a", "s a", "alpaca"), ("c", "c", "canonical"), ("own", "own", "auto"))],
        "recipe": {"enabled": True, "recipe_name": "r 1", "operators": {"example_length_filter": {"max_chars": 12}, "truncate_samples": {"total_samples": 8}}},
    }
    mapping = lambda df: {"sample_id": F.col("key").cast("string"), "messages": F.array(schema.message(F.lit("user"), F.col("q"))), "target_text": F.col("a")}
    (tmp_path / "task.json").write_text(json.dumps(raw))
    t = task.Task.load(str(tmp_path / "task.json"), "length_extension")
    assert [s.operator for s in t.recipe.steps] == ["truncate_samples", "example_length_filter"]
    run = task.Run(spark, t, mappings={"own": mapping}, modules="length_extension")
    seen = []
    run.on("after_source", lambda split, source, count: seen.append((split, source.source_name, count)))
    out = run.run()
    assert seen == [("train", "s a", 30), ("train", "c", 1), ("train", "own", 1)]
    assert hooked == [("truncate_samples", 8), ("example_length_filter", out.rows)]
    pool = run.pool().orderBy("ord").collect()
    assert [r.sample_id for r in pool] == [f"a{i}" for i in range(30)] + ["c0", "7"] and [r.ord for r in pool] == list(range(1, 33))
    assert pool[30].text == "short\none two" and pool[31].text == "why\nso"
    kept = [r.sample_id for r in out.ids().orderBy("ord").collect()]
    assert [json.loads(x.value)["sample_id"] for x in spark.read.text(f"{tmp_path}/out/recipes/r_1/dataset").collect()] == kept
    assert [r.sample_id for r in recipe.load_ids(spark, f"{tmp_path}/out/recipes", "r 1").collect()] == kept

    t = task.Task.of(raw | {"recipe": {}, "search": {"enabled": True, "search_name": "s", "max_rounds": 1, "max_candidates_per_round": 2}}, str(tmp_path))
    assert t.recipe is None
    run = task.Run(spark, t, mappings={"own": mapping})
    found = run.run()
    assert spark.read.parquet(f"{tmp_path}/out/scored/train/c").first().ngram_entropy == round(float(np.log2(3)), 9)
    best = json.loads(spark.read.text(f"{tmp_path}/out/searches/s/final_recipe").first()[0])
    assert best["recipe_name"] == found[0].recipe.name and found[0].objective == max(x.objective for x in found)

    with pytest.raises(ValueError, match="mapping"):
        task.Run(spark, t).ingest()
    with pytest.raises(ValueError, match="task_name"):
        task.Task.of({"output_dir": "x"})
    with pytest.raises(ValueError, match="stage"):
        task.Task.of(raw | {"recipe": {"input_stage": "raw"}}, str(tmp_path))
    with pytest.raises(ValueError, match="event"):
        run.on("nope", print)


def test_restart_follows_credit(spark, pool):
    f = lambda o, x: {"operator": o, "params": {"fraction": x}}
    s = loop.Search(recipe.Executor(pool, min_viable=0, observe=False), evaluators.MockEvaluator(), seed=3)
    entry = lambda name, steps, score, i, parent=None: loop.Entry(name, steps, score, None, 1.0, score, i, parent, 10)
    assert all([x.operator for x in r.steps][0] == "truncate_samples" and len(r.steps) == 2 for r in s.restart())  # nothing known: a filter
    s.history = [entry("a", [f("ifd_filter", 0.5), f("ngram_entropy", 0.4)], 1.0, 0)]
    assert {tuple(x.operator for x in r.steps[1:]) for r in s.restart()} == {("ifd_filter", "ngram_entropy")}  # the best recipe's
    s.history.append(entry("b", [f("ifd_filter", 0.7), f("ngram_entropy", 0.4)], 1.5, 1, "a"))  # other parameters count as added
    assert loop.credits(spark, s.history) == ([("ifd_filter", 0.5)], [])
    for r in s.restart():
        assert [x.operator for x in r.steps] == ["truncate_samples", "ifd_filter"] and r.steps[1].params["fraction"] in (0.5, 0.7)
        assert 20 <= r.steps[0].params["total_samples"] <= 200
    s.history.append(entry("c", [f("varentropy_filter", 0.2), f("mona_filter", 0.3)], 2.5, 2, "b"))
    assert {tuple(x.operator for x in r.steps[1:]) for r in s.restart()} == {("mona_filter", "varentropy_filter")}
    assert [[(x.operator, x.params) for x in r.steps] for r in s.restart()] == [[(x.operator, x.params) for x in r.steps] for r in s.restart()]
    r = s._execute(recipe.Recipe("x", [recipe.Step("truncate_samples", {"total_samples": 5})]))
    assert r.final.cumulative_cost_ratio == 0.2 == r.steps[-1]["state_after"]["cumulative_cost_ratio"]


def test_ranks_within_keys(spark, monkeypatch):
    from sluice.operators import base, mix

    rows = [(i, str(i), None if i % 7 == 0 else "a" if i % 3 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "ord long, sample_id string, source_name string")
    got = []
    for n in (1_000, 10):  # one window, and ranges
        monkeypatch.setattr(base, "WINDOW_ROWS", n)
        sizes = {r[0]: r[1] for r in df.groupBy("source_name").count().collect()}
        got.append({(r.source_name, r.rn): r.ord for r in base.ranked_within(df, "source_name", [F.desc("ord")], sizes).collect()})
        picked = mix.SourceMix(total_samples=12).apply(df).orderBy("ord").collect()
        assert [r.ord for r in picked] == list(range(12)) and {s: sum(r.source_name == s for r in picked) for s in (None, "a", "b")} == {None: 4, "a": 4, "b": 4}
    want = {}
    for i, _, s in reversed(rows):
        want[s, sum(k[0] == s for k in want) + 1] = i
    assert got == [want, want]


def test_influence_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vec = lambda: [float(x) for x in rng.normal(size=3).round(3)]
    train = [(i, c, vec()) for i in range(7) for c in "ab"]
    valid = [(i, c, vec()) for i in range(12) for c in "ab"]
    t = spark.createDataFrame(train, "train_id long, checkpoint string, v array<double>")
    v = spark.createDataFrame(valid, "pos long, checkpoint string, v array<double>")
    w = {"a": 0.25, "b": 0.75}
    x = {i: [sum(w[c] * float(np.dot(p, q)) for j, c, p in train if j == i for k, d, q in valid if (k, d) == (pos, c)) for pos in range(12)] for i in range(7)}
    for bound in (vectors.BROADCAST_BYTES, 800):
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", bound)
        got = {r.train_id: r.influence for r in vectors.influence(t, v, {"a": 1.0, "b": 3.0}).collect()}
        assert got == pytest.approx({i: max(y) for i, y in x.items()})
        got = {r.train_id: r.influence for r in vectors.influence(t, v, {"a": 1.0, "b": 3.0}, subtasks=3).collect()}
        assert got == pytest.approx({i: max(np.mean(y[k : k + 4]) for k in (0, 4, 8)) for i, y in x.items()})
    none = vectors.influence(t, v.limit(0), w)
    assert none.count() == 0


def test_yes_and_no_between_accented_letters(spark, tmp_path):
    """Scorers go by letters of all scripts; graph_labels goes by ASCII ones, as its SQL does in DuckDB."""
    import duckdb

    from sluice import queries

    said = ["ñno", "noé", "Asíyes, no", "yes", "_no", "n\u0303 no", "\u0130no", "no\u0130", "\u0661no", "known", "no.", "3yes", "no\u0301", None]
    df = spark.createDataFrame([(12 * i + 3, t) for i, t in enumerate(said)], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1] for r in duck.execute(queries.ORACLES["graph_labels"]).fetchall()}
    got = {r.id: r.label for r in queries.QUERIES["graph_labels"](spark, str(tmp_path)).collect()}
    assert got == want and [want[k] for k in (3, 15, 27)] == ["no", "no", "yes"]
    got = df.select(answers.yes_no_label(F.col("text")).alias("b"), "doc_id").orderBy("doc_id").collect()
    assert [r.b for r in got][:6] == [None, None, "no", "yes", None, "no"]


def test_influence_leaves_pairs_in_tasks(spark, monkeypatch):
    """Rows that miss a checkpoint, stand twice or hold nulls count as in a join of all pairs, which isn't made."""
    train = [(1, "a", [1.0, 2.0]), (1, "b", [0.5, 1.0]), (2, "a", [-1.0, 0.0]), (2, "a", [0.0, 3.0]), (3, "b", [None, 1.0]), (4, "c", [9.0, 9.0]), (5, "z", [1.0, 1.0]), (None, "a", [-2.0, -2.0])]
    valid = [(0, "a", [1.0, 1.0]), (0, "b", [2.0, 0.0]), (1, "b", [1.0, 1.0]), (2, "a", [-4.0, 1.0]), (2, "a", [1.0, 1.0]), (3, "a", [None, 1.0]), (3, "c", [1.0, 0.0])]
    w = {"a": 0.25, "b": 0.75}
    pairs: dict = {}
    for i, c, t in train:
        for pos, d, u in valid:
            if c == d:
                x = None if c not in w or None in t or None in u else w[c] * sum(p * q for p, q in zip(t, u, strict=True))
                old = pairs.get((i, pos))
                pairs[i, pos] = x if old is None else old if x is None else old + x
    how = {"max": max, "sum": sum, "mean": lambda x: sum(x) / len(x)}
    some = lambda f, x: how[f]([y for y in x if y is not None]) if any(y is not None for y in x) else None
    ids = {i for i, _ in pairs}
    v = spark.createDataFrame(valid, "pos long, checkpoint string, v array<double>")
    t = spark.createDataFrame(train, "train_id long, checkpoint string, v array<double>")
    for bound in (vectors.BROADCAST_BYTES, 150):
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(vectors, "PRODUCTS", 1 << 21 if bound > 150 else 3)
        for f in how:
            got = vectors.influence(t, v, {"a": 1.0, "b": 3.0}, across=f)
            assert {r.train_id: r.influence for r in got.collect()} == pytest.approx({i: some(f, [x for (k, _), x in pairs.items() if k == i]) for i in ids})
            assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
            got = {r.train_id: r.influence for r in vectors.influence(t, v, {"a": 1.0, "b": 3.0}, subtasks=2, within=f).collect()}
            runs = {i: [some(f, [x for (k, pos), x in pairs.items() if k == i and pos // 2 == p]) for p in (0, 1) if any(k == i and pos // 2 == p for k, pos in pairs)] for i in ids}
            assert got == pytest.approx({i: some("max", x) for i, x in runs.items()})
    with pytest.raises(Exception, match="unlike length"):
        vectors.influence(t.withColumn("v", F.array(F.lit(1.0))), v).collect()


def test_influence_means_take_no_pairs(spark, monkeypatch):
    """A mean over a run is one product with its vectors' sum, however many rows it has."""
    rng = np.random.default_rng(8)
    train = spark.createDataFrame([(i, "a", rng.normal(size=3).tolist()) for i in range(5)], "train_id long, checkpoint string, v array<double>")
    valid = spark.createDataFrame([(i, "a", rng.normal(size=3).tolist()) for i in range(60)], "pos long, checkpoint string, v array<double>")
    rows, block = [], vectors._validation_block
    monkeypatch.setattr(vectors, "_validation_block", lambda t: rows.append(len(t)) or block(t))
    t, v = (np.array([r.v for r in d.collect()]) for d in (train, valid))
    want = {i: max(np.mean(x[k : k + 20]) for k in (0, 20, 40)) for i, x in enumerate(t @ v.T)}
    assert {r.train_id: r.influence for r in vectors.influence(train, valid, subtasks=3).collect()} == pytest.approx(want)
    assert {r.train_id: r.influence for r in vectors.influence(train, valid, across="sum").collect()} == pytest.approx(dict(enumerate((t @ v.T).sum(axis=1))))
    assert sum(rows) == 4
