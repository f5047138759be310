import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.operators import planning, tasks, taxonomy


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize("t, want", [("Hello, World!", "hello_world"), ("  ", "item"), ("", "item"), ("Ünï--Cödé 9", "ünï_cödé_9"), ("a" * 60, "a" * 48), ("a" * 47 + "--b", "a" * 47)])
def test_slug(spark, t, want):
    assert one(spark, T.slug("t"), t=t) == want


def test_text_functions(spark):
    assert one(spark, T.first_text("a", "b"), a="  ", b=" x ") == "x"
    assert one(spark, T.first_raw("a", "b"), a=None, b="  code\n") == "  code\n"
    assert one(spark, T.clean_stdout("a"), a=" \r\na  \r\nb\t\n\n") == "a\nb"
    assert one(spark, T.stable_repr("a"), a="<pkg.mod.Cls object at 0x7fA1> and <C object at 0x1>") == "<Cls object> and <C object>"
    assert one(spark, T.has_unstable_repr("a"), a="<pkg.Cls object at 0x7fA1>") and not one(spark, T.has_unstable_repr("a"), a="<Cls object>")
    assert one(spark, T.completion_code("a"), a='{"final_code": "x=1"}') == "x=1"
    assert one(spark, T.completion_code("a"), a="text\n```python\ny = 2\n```\nmore") == "y = 2"
    assert one(spark, T.completion_code("a"), a="  z = 3 ") == "z = 3"
    assert one(spark, T.numbers_in("a"), a="x1 1.5, -2e3 .5 v2") == [1.5, -2000.0, 0.5]
    assert one(spark, T.context_summary("a"), a="\n".join(["line  ", ""] * 12)) == "\n".join(["line"] * 8)
    long = one(spark, T.context_summary("a"), a="y" * 600)
    assert len(long) == 480 and long.endswith("...")
    import hashlib

    assert one(spark, T.seed_of("a"), a="k") == int(hashlib.md5(b"k").hexdigest()[:8], 16)
    assert one(spark, T.rate(F.lit(1), F.lit(0))) == 0.0
    nan = F.lit(float("nan"))
    assert one(spark, T.close(nan, nan)) and not one(spark, T.close(nan, F.lit(1.0))) and one(spark, T.close(F.lit(1.0), F.lit(1.0 + 5e-7))) and not one(spark, T.close(F.lit(1.0), F.lit(1.00001)))


def test_normalised_demo_rows_route(spark):
    t = tasks.normalize(tasks.demo_rows(spark))
    rows = {r.row_idx: r for r in t.collect()}
    assert rows[1].task_id == "task_demo_1" and rows[3].task_id == "task_train_000003" and rows[2].solution == "a.merge(b)"
    assert rows[1].resource_files == ["reads.fasta"] and rows[2].resource_files == ["a.csv", "b.csv"] and rows[3].raw_metadata == '{"extra":"3"}'
    assert all(r.has_placeholder for r in rows.values())
    got = {r.row_idx: r for r in taxonomy.route(t).collect()}
    assert got[1].primary_domain == "bioinformatics_sequence_structure" and got[1].primary_task_type == "structured_data_processing" and got[1].solution_form == "function_body"
    assert got[2].primary_domain == "biomedical_data_analysis" and got[2].solution_form == "expression_completion" and got[2].verifier_type_hint == "dataframe_equal"
    assert got[3].primary_task_type == "numerical_computation" and got[3].confidence == 0.83
    seeds = tasks.seed_environments(t, taxonomy.route(t))
    assert seeds.count() == 3 and seeds.where("level = 'M1' and gold_solution is not null").count() == 3


def test_substring_rules_keep_their_traps(spark):
    texts = spark.createDataFrame([("read a barcode",), ("hello",), (None,)], "a string")
    got = [r.primary_domain for r in taxonomy.with_rules(texts, F.col("a")).collect()]
    assert got == ["systems_molecular_modeling", "scientific_software_engineering", "scientific_software_engineering"]


@pytest.mark.parametrize(
    "context, signature, want",
    [
        ("@cached.property\n<<insert solution here>>", None, "decorated_function_definition"),
        ("def f(x):\n    <<insert solution here>>", "def f(x)", "function_body"),
        ("y = <<insert solution here>>", None, "expression_completion"),
        ("def g(a):\n    a += 1\n    <<insert solution here>>", None, "statement_block_completion"),
        ("import os\n\n<<insert solution here>>", "def f(x)", "function_definition"),
        ("import os\n<<insert solution here>>", None, "statement_block_completion"),
        ("nothing", None, "statement_block_completion"),
    ],
)
def test_solution_forms(spark, context, signature, want):
    assert one(spark, taxonomy.solution_form(F.lit("do it"), F.col("c"), F.col("s"), F.lit(None)), c=context, s=signature) == want
    assert one(spark, taxonomy.solution_form(F.lit("Fix the bug"), F.col("c"), F.col("s"), F.lit(None)), c=context, s=signature) == "patch_or_bugfix"


def test_routing_validation(spark):
    rows = [
        ("Genomics", [("omics", 0.4), ("pandas", 0.9), ("omics", 0.8), ("genomics", 1.0), ("cli", 0.2)], "file-io", "bugfix", ["tabular", "file_io", "tabular"], "0.9"),
        ("unknown", None, None, "odd", None, "no number"),
    ]
    df = spark.createDataFrame(rows, "primary_domain string, secondary_domains array<struct<domain:string,relevance:double>>, primary_task_type string, solution_form string, secondary_task_types array<string>, confidence string")
    a, b = taxonomy.validate_routing(df, list(taxonomy.DOMAINS), list(taxonomy.TASK_TYPES), 0.5, 0.7).collect()
    assert a.primary_domain == "bioinformatics_sequence_structure" and a.primary_task_type == "io_format_and_cli" and a.solution_form == "patch_or_bugfix" and not a.needs_review
    assert [(h.domain, h.relevance) for h in a.secondary_domains] == [("biomedical_data_analysis", 0.9), ("omics_measurement_analysis", 0.4)] and a.secondary_task_types == ["structured_data_processing"]
    assert b.primary_domain == "scientific_software_engineering" and b.primary_task_type == "code_validation_and_utility" and b.needs_review and b.confidence == 0.0 and b.secondary_domains == []


def test_hints_of_any_shape(spark):
    rows = ['"omics"', '["omics", {"domain": "cli", "relevance": 0.7}]', '{"omics": 0.9, "cli": {"score": 0.2}}', None]
    df = spark.createDataFrame([(r,) for r in rows], "h string").select(taxonomy.coerce_hints(F.col("h")).alias("x"))
    got = [[(h.domain, h.relevance) for h in r.x] for r in df.collect()]
    assert got == [[("omics", 0.5)], [("omics", 0.5), ("cli", 0.7)], [("omics", 0.9), ("cli", 0.2)], []]
    assert one(spark, taxonomy.keyword_hits(F.col("a"), {"b": ["x", "y"], "a": ["z", "x"], "c": ["q"]}), a="x z y") == ["a", "b"]


def test_weights(spark):
    df = spark.createDataFrame([("numerical_computation", ["io_format_and_cli"], None, "compute the mean"), ("io_format_and_cli", [], "unit_test", "read a csv path")], "primary_task_type string, secondary_task_types array<string>, verifier_type_hint string, t string")
    a, b = [r.final_weights for r in planning.axis_weights(df, F.col("t")).collect()]
    assert (a.C, a.V, a.D, a.A) == pytest.approx((7 + 0.3 * 5, 5 + 0.3 * 3, 3 + 0.3 * 7, 2 + 0.3 * 2))
    assert (b.D, b.C, b.V, b.A) == (7, 5, 4, 2)
    fixed = one(spark, planning.repaired_weights(F.create_map(F.lit("D"), F.lit(99), F.lit("C"), F.lit(0)), "DCVA"))
    assert (fixed.D, fixed.C, fixed.A, fixed.V) == (7, 4, 2, 3)


def test_plans_break_no_rule_and_depend_on_their_row_alone(spark):
    rows = [(f"e{i}", lv, t, (float(i % 7), 1.0, 3.0, 0.0)) for i in range(40) for lv in planning.LEVELS for t in planning.PRIORITY]
    df = spark.createDataFrame(rows, "env_id string, level string, primary_task_type string, final_weights struct<D:double,C:double,A:double,V:double>")
    plans = planning.plan_violations(planning.scaling_plans(df))
    assert plans.where(F.size("violations") > 0).count() == 0
    key = lambda p: sorted((r.env_id, r.level, r.primary_task_type, tuple(r.selected_axes), r.total_intensity) for r in p.collect())
    assert key(plans) == key(planning.scaling_plans(df.repartition(7)))
    ops = planning.operator_instances(plans.dropDuplicates(["env_id", "level"]).withColumn("env_id", F.concat("env_id", "level")))
    assert ops.where("operator_intensity not in (1, 2)").count() == 0
    assert planning.intensity_mismatch(ops, plans.dropDuplicates(["env_id", "level"]).withColumn("env_id", F.concat("env_id", "level"))).count() == 0
    bad = planning.plan_violations(plans.where("level = 'M3'").limit(1).withColumn("total_intensity", F.lit(9)))
    assert {"TOTAL_INTENSITY_OUT_OF_RANGE", "INTENSITY_SUM_MISMATCH"} <= set(bad.first().violations)


def test_trim_and_tools(spark):
    ops = spark.createDataFrame([("e", "D", 1, 2), ("e", "D", 2, 2), ("e", "D", 3, 1)], "env_id string, axis string, position int, operator_intensity int")
    assert [r.operator_intensity for r in planning.trimmed_operators(ops, F.lit(3)).orderBy("position").collect()] == [2, 1]
    assert one(spark, planning.tool_priority(F.array(*map(F.lit, "abcd")), ["c"], 3)) == ["c", "a", "b"]


def test_cases_options_manifest(spark):
    c = F.array(F.struct(F.lit(" f() ").alias("call_code"), F.lit("1").alias("expected")), F.struct(F.lit(" ").alias("call_code"), F.lit("1").alias("expected")))
    got = one(spark, tasks.normalize_cases(c, 2))
    assert got.too_few and [x.call_code for x in got.cases] == ["f()"]
    assert one(spark, tasks.public_manifest(F.array(*map(F.lit, ["a.csv", "./a.csv", "/etc/x", "../y", "d\\e", "~/z"])))) == ["a.csv", "d/e"]
    opts = tasks.qa_options(F.col("r"))
    assert one(spark, tasks.qa_answer_key(F.col("r"), opts), r='{"options": ["x", "y"], "answer": "Y"}') == "B"
    assert one(spark, tasks.qa_answer_key(F.col("r"), opts), r='{"options": {"A": "x", "B": "y"}, "answer_idx": "a"}') == "A"
    none = F.lit(None).cast("array<string>")
    assert one(spark, tasks.active_cases(none, F.array(F.lit("s")))).source == "seed" and one(spark, tasks.active_cases(none, none)).source == "none"
    adm = tasks.seed_admission(spark.createDataFrame([("", None, "x")], "gold_solution string, call_code string, expected_output string")).first()
    assert adm.admission_failures == ["SEED_CODE_MISSING", "SEED_CALL_MISSING"]


def plain_text(text):
    import re

    return re.sub(r"[^a-z0-9_ .:/+-]+", "", re.sub(r"\s+", " ", (text or "").lower())).strip(" ")


def test_requirements_match_whole_texts_anywhere(spark, tmp_path):
    import random

    from gradeloom.plans import catalogue

    rng = random.Random(3)
    draw = lambda n: " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "é", "a!b", "x  y"]) for _ in range(n))
    docs = [(i, draw(rng.randint(1, 25))) for i in range(150)] + [(7, "The dog barked at\nthe cat."), (None, "the dog barked"), (200, None), (201, "  "), (202, "!!"), (203, "cat")]
    items = [(i, draw(rng.randint(1, 6))) for i in range(40)] + [(50, "he dog barked a"), (51, "og bar"), (52, "arke"), (53, "b"), (54, None), (55, ""), (56, "dog barked at the cat. And more"), (57, "of none of these")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {(i, d) for i, a in items for d, b in docs if (x := plain_text(a)) and (y := plain_text(b)) and (x in y or y in x)}
    got = [tuple(r) for r in catalogue.requirement_match(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(50, 7), (51, None), (52, 7), (56, 203)} <= want


def test_requirements_match_alike_where_nothing_can_be_broadcast(spark, tmp_path, monkeypatch):
    import random

    from gradeloom.operators import rubrics
    from gradeloom.plans import catalogue

    rng = random.Random(5)
    draw = lambda n: " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "é", "a!b", "x  y"]) for _ in range(n))
    docs = [(i, draw(rng.randint(0, 25))) for i in range(60)] + [(3, "the dog barked"), (None, "cat " * 50), (None, None)]
    items = [(i, draw(rng.randint(0, 6))) for i in range(30)] + [(3, "he dog barked a"), (None, "at ca"), (40, "the cat sat on  mats" * 9)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(i, d) for i, a in items for d, b in docs if (x := plain_text(a)) and (y := plain_text(b)) and (x in y or y in x)}
    for rows in (rubrics.BROADCAST_ROWS, -1):
        monkeypatch.setattr(rubrics, "BROADCAST_ROWS", rows)
        got = [tuple(r) for r in catalogue.requirement_match(spark, str(tmp_path)).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def stages_since(spark, first):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [x for x in (found.apply(i) for i in range(found.size())) if x.stageId() > first]


def test_texts_of_requirements_are_read_a_few_times_by_all_tasks(spark, tmp_path):
    from gradeloom.plans import catalogue

    n = 4000
    spark.range(n).selectExpr("id AS doc_id", "concat('seen word', id, ' before noon of day ', id % 7, ' and after it came ', repeat('more to say ', 9)) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(20).selectExpr("id AS item_id", "concat('n word', id, ' before noon of day') AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = max((x.stageId() for x in stages_since(spark, -1)), default=-1)
    got = {tuple(r) for r in catalogue.requirement_match(spark, str(tmp_path)).collect()}
    assert got == {(k, k) for k in range(20)}
    stages = stages_since(spark, before)
    assert sum(x.inputRecords() for x in stages) < 12 * n  # 5 times whole texts, else their lengths alone
    assert max(x.numTasks() for x in stages if x.outputRecords() >= n) == 4  # one file, whose texts all tasks make plain


def test_names_of_a_brand_overlap_whatever_their_type_and_size(spark, tmp_path):
    import random

    from gradeloom.plans import catalogue

    rng = random.Random(4)
    words = ["red", "hot", "bolt", "ring", "gear", "small"]
    parts = [(k, rng.choice("AB"), rng.choice(["S", "E"]), rng.randint(1, 50), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for k in range(120)]
    parts += [(200, None, "S", 1, "red bolt"), (201, "A", "S", 1, None)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    own = [(k, b, set((n or "").split())) for k, b, _, _, n in parts]
    want = [(k, m) for k, b, x in own for m, c, y in own if k < m and b == c is not None and x and len(x & y) >= min(2, len(x))]
    assert sorted(tuple(r) for r in catalogue.token_overlap(spark, str(tmp_path)).collect()) == sorted(want) and len(want) > 100


def test_pairs_of_one_large_class_are_spread(spark):
    from gradeloom.operators import rubrics

    rows = spark.range(2500).selectExpr("'A' AS g", "id AS k", "array('bolt', 'red') AS w").unionByName(spark.createDataFrame([("A", 3, ["bolt", "red"]), ("A", 9000, ["red"]), ("A", -1, ["red"]), ("A", None, ["red"]), ("B", 1, [])], "g string, k long, w array<string>"))
    made = rubrics.token_pairs(rows, "g", "k", "w").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_if(F.expr("left_key = 3")).alias("twice"), F.count_if(F.expr("left_key = -1 AND right_key < 9000")).alias("single")).collect()
    total = sum(r.n for r in made)
    assert total == 2500 * 2499 // 2 + 2499 + 2501 + 1 and sum(r.twice for r in made) == 2 * 2496 and sum(r.single for r in made) == 2501
    assert max(r.n for r in made) < 0.7 * total


def test_plans_of_a_small_file_are_the_work_of_all_tasks(spark, tmp_path):
    from gradeloom.plans import catalogue

    spark.range(400).selectExpr("id AS p_partkey", "concat('sort rows ', id) AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert catalogue.plan_sampling(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() == 4


def test_words_are_found_in_one_pass(monkeypatch):
    from gradeloom.functions import words

    known = ["bar", "bam", "barcode", "a", "é b"]
    texts = ["a barcode", "", "x", "té b bam", "BAR"]
    want = [[i for i, w in enumerate(known) if w in t] for t in texts]
    assert [words.finder(known)(t) for t in texts] == want
    monkeypatch.setattr(words, "ahocorasick", None)
    assert [words.finder(known)(t) for t in texts] == want


def test_words_are_found_in_arrow_batches(spark):
    from pyspark.util import PythonEvalType

    from gradeloom.functions import words

    out = spark.createDataFrame([(1, "a barcode"), (2, None), (3, "")], "n int, t string").select("n", words.found_words(F.col("t"), ["bar", "a", "code"]).alias("found"))
    assert [r.found for r in out.orderBy("n").collect()] == [[0, 1, 2], [], []]
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in out._jdf.queryExecution().optimizedPlan().toString()


def test_clinical_types_by_priority(spark):
    rows = ["next best step after sudden fever, best treatment", "the best treatment", "nothing", "overdose: which antidote", None]
    got = [(r.primary_task_type, r.secondary_task_types) for r in taxonomy.with_clinical_types(spark.createDataFrame([(t,) for t in rows], "t string"), F.col("t")).collect()]
    assert got == [("triage_urgent_management", []), ("treatment_planning", []), ("diagnosis_reasoning", []), ("triage_urgent_management", ["medication_safety"]), ("diagnosis_reasoning", [])]
