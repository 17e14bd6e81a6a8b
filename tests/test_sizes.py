"""Results on odd rows, and plans whose work does not outgrow the tables."""

from evidentia.operators import bindings, extract, modules, tasks
from evidentia.plans import lens


def test_import_edges_broadcast_no_table_of_files(spark, sf_dir):
    files = lens.module_files(spark, sf_dir).drop("k")
    declared = extract.exports(files).select("path", "name")
    plan = modules.import_edges(files, declared)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_scopes_of_the_same_paths_share_their_answer(spark):
    ends = "project int, snapshot string, from_path int, to_path int, strength string"
    witnesses = spark.createDataFrame([(1, "t", 10, 20, "strong"), (1, "t", 20, 30, "strong"), (1, "t", 10, 40, "weak"), (2, "t", 10, 50, "strong"), (1, "t", 10, 20, "strong")], ends)
    scopes = spark.createDataFrame(
        [(1, 1, "t", [10, 20]), (2, 1, "t", [20, 10, 10]), (3, 1, "t", [30]), (4, 1, "t", [10]), (4, 2, "t", [10]), (5, 1, None, [10]), (None, 1, "t", [10]), (6, 1, "t", None)],
        "task int, project int, snapshot string, paths array<int>"
    )
    got = bindings.reserved(witnesses, scopes)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 30), (2, 30), (3, 20), (4, 20), (4, 50), (None, 20)], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().children().head().toString()
    assert plan.lstrip().startswith("Project") and "Aggregate" not in plan.split("Join")[0]


def test_edges_to_symbols_of_several_names_come_once(spark):
    deps = spark.createDataFrame([("a", "x", "uses"), ("a", "y", "uses"), ("a", "x", "uses"), ("a", "x", "references"), ("b", "x", "uses"), ("c", None, "uses")], "id string, dep_name string, relation string")
    symbols = spark.createDataFrame([("b", "x"), ("b", "y"), ("b", "x"), ("d", "x"), ("e", None)], "id string, name string")
    got = extract.dependency_edges(deps, symbols)
    want = [("a", "b", "references"), ("a", "b", "uses"), ("a", "d", "references"), ("a", "d", "uses"), ("b", "d", "uses")]
    assert sorted(map(tuple, got.collect())) == want
    # edges to symbols of one name are made by the last join: they are not shuffled
    plan = got._jdf.queryExecution().optimizedPlan().children().head().toString()
    assert plan.lstrip().startswith("Project") and "Aggregate" not in plan.split("Join")[0]


def test_labels_with_unknown_values_and_rows_of_the_index_nobody_cites(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 2, 9), (2, 1, 1), (2, 1, 2), (3, 1, None), (None, 1, 1), (4, None, 1), (5, 7, 7)], "question int, subject int, path int")
    index = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, None), (2, 8), (None, 1)], "subject int, path int")
    got = tasks.verified_labels(labels, index)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2, 1, "both"), (2, 0, 0, "verified"), (3, 2, 1, "both"), (None, 2, 1, "both"), (4, 0, 1, "unexpected"), (5, 0, 1, "unexpected")], key=str)
    # no row of the index is written out for each question: cited rows meet the index by one left join
    assert "FullOuter" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_texts_made_of_a_small_file_are_worked_on_by_many_tasks(spark, sf_dir):
    for files in (lens.module_files(spark, sf_dir), lens.dotnet_files(spark, sf_dir)):
        assert files.rdd.getNumPartitions() >= 4


def test_tasks_of_one_scope_take_its_paths_in_runs(spark, monkeypatch, tmp_path):
    """Rows, over several runs and slices, and the space of tasks times paths in files."""
    witnesses = spark.range(9000).selectExpr("1 as project", "'t' as snapshot", "id % 3 as from_path", "id + 100000 as to_path", "'strong' as strength")
    scopes = spark.range(900).selectExpr("id as task", "1 as project", "'t' as snapshot", "array(id % 3, 100000 + id % 3) as paths")
    bindings.reserved(witnesses, scopes).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert rows.count() == rows.distinct().count() == 900 * 2999
    assert rows.where("(path % 3) <> (100000 + task) % 3 and path >= 100003").count() == rows.where("path < 3 and path <> task % 3 or path = 100000 + task % 3").count() == 0
    assert sum(p.stat().st_size for p in (tmp_path / "rows").glob("*.parquet")) < 900 * 2999 / 4
    monkeypatch.setattr(bindings, "RUN", 7)
    monkeypatch.setattr(bindings, "SLICE", 300)
    other = bindings.reserved(witnesses, scopes)
    assert other.count() == rows.count() and not other.exceptAll(rows).take(1)
