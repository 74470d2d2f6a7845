"""The grader: edge cases by hand, and the task tables."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from burnish.operators.grade import Sheets, column_score, grade, grade_sheets
from burnish.plans.tasks import clean_task, grade_file, grade_suite, task_specs
from burnish.sources.catalog import Task, available_tasks, task_catalog
from burnish.sources.tables import ORDER, read_sheets, read_table

HEADERS = ["id", "name", "city", "note"]
ROWS = [("1", "Ann", "Rome", ""), ("2", "Bob", "Oslo", "x"), ("3", "Cy", "Bonn", ""), ("4", "Di", "Kyiv", "y")]


def picked(*names):
    return [tuple(r[HEADERS.index(n)] for n in names) for r in ROWS]


CASES = [
    # given headers, given rows, (row, column, cell, total)
    (HEADERS, ROWS, (0.99, 0.99, 0.99, 0.99)),
    (["id", "nama", "city", "note"], ROWS, (0.99, 0.75, 0.75, 0.798)),
    (["id", "zname", "city", "note"], ROWS, (0.01, 0.75, 0.75, 0.602)),
    (["id", "name", "city"], picked("id", "name", "city"), (0.01, 0.75, 0.875, 0.677)),
    ([*HEADERS, "zz"], [(*r, "q") for r in ROWS], (0.01, 0.99, 0.99, 0.794)),
    (["ID", "Name", "City", "Note"], ROWS, (0.99, 0.99, 0.125, 0.471)),
    (["id", "Name", "city", "note"], ROWS, (0.01, 0.99, 0.75, 0.65)),
    (["name", "id", "city", "note"], picked("name", "id", "city", "note"), (0.99, 0.99, 0.01, 0.402)),
    (["id", "city", "name", "note"], picked("id", "city", "name", "note"), (0.99, 0.99, 0.99, 0.99)),
    (HEADERS, [*ROWS, ROWS[0], ("1", "ZZ", "ZZ", "ZZ")], (0.99, 0.99, 0.875, 0.921)),
    (HEADERS, ROWS[:1], (0.25, 0.99, 0.99, 0.842)),
    (HEADERS, [("9", "a", "b", "c")], (0.01, 0.99, 0.01, 0.206)),
    (HEADERS, [("1 ", "\tANN", "\xa0rome", None), ("2", "bob ", " OSLO", "X")], (0.5, 0.99, 0.99, 0.892)),
]


def table(spark, headers, rows):
    schema = ", ".join(f"c{i} string" for i in range(len(headers)))
    return spark.createDataFrame(rows, schema).toDF(*headers)


def scores(df):
    return tuple(round(x, 6) for x in df.first())


@pytest.mark.parametrize("case", range(len(CASES)))
def test_edge_cases(spark, case):
    headers, rows, want = CASES[case]
    assert scores(grade(table(spark, headers, rows), table(spark, HEADERS, ROWS))) == want


def test_last_expected_row_wins_and_blank_keys_meet(spark):
    truth = [*ROWS, ("2", "Bob2", "Oslo", "x"), ("", "Blank", "", ""), ("3", "Cy", "Bonn", "")]
    numbered = table(spark, [*HEADERS, "n"], [(*r, str(i)) for i, r in enumerate(truth)])
    given = table(spark, HEADERS, [*ROWS, ("", "Blank", "", "q"), ("  ", "z", "", "")])
    got = grade(given, numbered.withColumn("n", F.col("n").cast("int")), order="n")
    assert scores(got) == (0.571429, 0.99, 0.875, 0.837286)


def test_nothing_given_scores_lowest(spark):
    truth = table(spark, HEADERS, ROWS)
    assert scores(grade(None, truth))[-1] == 0.01
    assert scores(grade(truth.limit(0), truth))[-1] == 0.01
    assert scores(grade(truth, truth.limit(0)))[-1] == 0.01
    assert scores(grade(truth.select(), truth))[-1] == 0.01
    assert scores(grade_file(spark, "/no/such/file.csv", "/no/such/either.csv"))[-1] == 0.01
    assert column_score([], []) == 0.99 and column_score(["a"], []) == 0.01


def test_files_without_rows(spark, tmp_path):
    for name, text in (("empty", ""), ("header", "id,x\n"), ("full", "id,x\n1,a\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    for given, truth in (("empty", "full"), ("header", "full"), ("full", "empty"), ("full", "header"), ("empty",) * 2):
        got = grade_file(spark, str(tmp_path / f"{given}.csv"), str(tmp_path / f"{truth}.csv"))
        assert scores(got)[-1] == 0.01, (given, truth)
    assert scores(grade_file(spark, *[str(tmp_path / "full.csv")] * 2))[-1] == 0.99


def test_weights(spark):
    truth = table(spark, HEADERS, ROWS)
    assert scores(grade(truth.limit(1), truth, weights=(1.0, 0.0, 0.0)))[-1] == 0.25


def test_repeated_headers_keep_their_last_values(spark):
    twice = table(spark, ["id", "x", "x"], [("1", "old", "new")])
    once = table(spark, ["id", "x"], [("1", "new")])
    assert scores(grade(twice, once)) == (0.99, 0.99, 0.99, 0.99)


UNMODIFIED = {
    "easy": (0.99, 0.99, 0.99, 0.99),
    "medium": (0.05, 0.99, 0.68, 0.616),
    "hard": (0.1, 0.99, 0.742857, 0.663714),
    "hr": (0.16, 0.99, 0.772487, 0.693492),
    "healthcare": (0.48, 0.99, 0.912698, 0.841619),
    "finance": (0.08, 0.99, 0.784314, 0.684588),
    "logistics": (0.38, 0.99, 0.896359, 0.811815),
    "education": (0.38, 0.99, 0.892857, 0.809714),
}
CLEANED = {
    "easy": 0.99, "medium": 0.99, "hard": 0.984, "hr": 0.931714, "healthcare": 0.954571,
    "finance": 0.946571, "logistics": 0.927714, "education": 0.935143,
}


def test_task_tables_as_they_are(spark, task_folder):
    got = {r.task: tuple(round(x, 6) for x in r[2:]) for r in grade_suite(spark, task_folder).collect()}
    assert got == UNMODIFIED


def test_task_tables_cleaned(spark, task_folder):
    got = {r.task: round(r.reward, 6) for r in grade_suite(spark, task_folder, clean=True).collect()}
    assert got == CLEANED


def test_exact_text_where_it_can_be_reached(spark, task_folder):
    """The score is blind to case, padding and repeats; the text is not."""
    specs = task_specs()
    for task in available_tasks(spark, task_folder):
        if task.name in ("easy", "medium"):
            cleaned = clean_task(spark, task_folder, task, specs[task.name]).drop(ORDER)
            truth = read_table(spark, f"{task_folder}/{task.clean_file}")
            assert sorted(map(repr, cleaned.collect())) == sorted(map(repr, truth.collect()))


def test_catalog(spark, task_folder):
    listed = task_catalog(spark, task_folder).collect()
    assert [(r.task, r.level) for r in listed][:3] == [("easy", "easy"), ("medium", "medium"), ("hard", "hard")]
    assert len(listed) == 8


def random_pair(dice, n):
    """Two small tables with headers and keys that partly agree."""
    headers = dice.sample(["id", "Name", "name", "city", "x.y", "note", "id"], dice.randint(2, 5))
    cell = lambda: dice.choice(["", None, " a", "A ", "b", "\tB", "é", "12"])
    truth = [[dice.choice(["1", "2", "3 ", "", None, str(r)])] + [cell() for _ in headers[1:]] for r in range(n)]
    given = [[c if dice.random() < 0.8 else cell() for c in row] for row in truth if dice.random() < 0.9]
    given += [truth[0]] * dice.randint(0, 2) if truth else []
    names = [h if dice.random() < 0.8 else dice.choice([h.upper(), "zz", h]) for h in headers]
    if dice.random() < 0.3:
        given, names = [row[:-1] for row in given], names[:-1]
    return (names, given), (headers, truth)


def test_many_tasks_by_one_job_as_each_for_itself(spark):
    dice = random.Random(9)
    given, truth, want = {}, {}, {}
    for t in range(12):
        sides = random_pair(dice, 0 if t == 3 else dice.randint(1, 9))
        frames = []
        for headers, rows in sides:
            kinds = "_n int, " + ", ".join(f"c{i} string" for i in range(len(headers)))
            frames.append(spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], kinds).toDF("_n", *headers))
        given[f"t{t}"], truth[f"t{t}"] = frames
        want[f"t{t}"] = tuple(grade(frames[0], frames[1], "_n").first())
    given["lost"] = spark.createDataFrame([], "")
    truth["lost"] = truth["t1"]
    want["lost"] = (0.01,) * 4
    found = grade_sheets(Sheets.of(given, "_n"), Sheets.of(truth, "_n"), list(want)).collect()
    assert {r[0]: pytest.approx(tuple(r)[1:]) for r in found} == want


def test_the_plan_does_not_grow_with_the_tasks(spark, tmp_path):
    sizes = []
    for n in (8, 60):
        tasks = [Task(f"{n}_{i}", "easy", "") for i in range(n)]
        for i, task in enumerate(tasks):
            head = ",".join(["id", "b", f"c{i % 5}", "d"][: 3 + i % 2])
            (tmp_path / task.clean_file).write_text(f"{head}\n1,x,y\n2,x,{i}\n")
            (tmp_path / task.messy_file).write_text(f"{head}\n1,X ,y\n" + ("2,x,z\n" if i % 3 else ""))
        plans = []
        found = grade_suite(spark, str(tmp_path), tasks)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        rows = {r.task: r for r in found.collect()}
        assert len(rows) == n
        for i in (0, 1, 5):
            one = grade_file(spark, f"{tmp_path}/{tasks[i].messy_file}", f"{tmp_path}/{tasks[i].clean_file}").first()
            assert tuple(rows[f"{n}_{i}"])[2:] == pytest.approx(tuple(one))
        sizes.append(len(plans[0].splitlines()))
    assert sizes[0] == sizes[1]


def test_a_broken_file_costs_its_own_task_only(spark, tmp_path):
    tasks = [Task(name, "easy", "") for name in ("good", "bad", "mixed")]
    for task in tasks:
        (tmp_path / task.clean_file).write_text("id,b\n1,x\n")
        (tmp_path / task.messy_file).write_text("id,b\n1,x\n")
    (tmp_path / "bad_messy.csv").unlink()
    (tmp_path / "bad_messy.csv").mkdir()
    (tmp_path / "bad_messy.csv" / "a.gz").write_bytes(gzip.compress(random.Random(1).randbytes(90_000))[:50_000])
    (tmp_path / "mixed_messy.csv").unlink()
    (tmp_path / "mixed_messy.csv").mkdir()
    for name, head in (("a.csv", "id,b"), ("b.csv", "id,c")):
        (tmp_path / "mixed_messy.csv" / name).write_text(f"{head}\n1,x\n")
    rows = {r.task: r.reward for r in grade_suite(spark, str(tmp_path), tasks).collect()}
    assert rows == {"good": 0.99, "bad": 0.01, "mixed": 0.01}


@pytest.fixture
def no_free_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_rows_of_a_task_are_not_brought_together_for_its_plan(spark, no_free_broadcasts):
    tables = {t: spark.range(20).selectExpr("cast(id as string) as id", f"'{t}' as x") for t in ("a", "b")}
    graded = grade_sheets(Sheets.of(tables), Sheets.of(tables), list(tables))
    assert not re.search(r"SortMergeJoin \[task#\d+\], \[of#\d+\], Inner", _planned(graded))
    assert {r.task: r.reward for r in graded.collect()} == {"a": 0.99, "b": 0.99}


def test_rows_of_a_file_are_not_brought_together_for_its_task(spark, no_free_broadcasts, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("k,v\n1,2\n3,4\n")
    sheets = read_sheets(spark, {name: str(tmp_path / f"{name}.csv") for name in "ab"})
    assert "SortMergeJoin" not in _planned(sheets.rows)
    assert sorted((r.task, *r.cells) for r in sheets.rows.collect()) == [(t, *c) for t in "ab" for c in ("12", "34")]
