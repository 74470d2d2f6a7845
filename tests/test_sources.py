"""Tables, logs, synthetic pairs and whole jobs."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from burnish.functions.chance import choose, draw, pick
from burnish.operators.grade import grade
from burnish.operators.profile import profile
from burnish.plans.spec import CleaningSpec, amount, apply_rules, clean_table, dates
from burnish.plans.synth import COPY, DOMAINS, ROW, clean_rows, messy_rows, numbered, write_pairs
from burnish.plans.tasks import grade_file, task_specs
from burnish.session import settle
from burnish.functions.text import title_case
from burnish.sources.episodes import episodes, parse_lines, read_log
from burnish.sources.tables import ORDER, cells_of, heads, read_table, read_table_or_empty, unreadable, write_table


def test_read_keeps_text_as_it_is(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,"a b",C\n1,  x  ,"say ""hi"", ok"\n\n2,,Monitor 27"\n3,only\n4,a,b,too many\n', encoding="utf-8")
    rows = [tuple(r) for r in read_table(spark, str(path)).collect()]
    assert rows == [("1", "  x  ", 'say "hi", ok'), ("2", None, 'Monitor 27"'), ("3", "only", None), ("4", "a", "b")]
    flagged = read_table(spark, str(path), broken="_broken").where("_broken is not null")
    assert [r.id for r in flagged.collect()] == ["3", "4"]
    assert read_table_or_empty(spark, str(tmp_path / "none.csv")).columns == []
    assert read_table_or_empty(spark, None).columns == []


def test_write_then_read(spark, tmp_path):
    rows = [(i, f"  v{i} ", 'a,"b"' if i % 2 else "", "\tt\xa0") for i in range(50)]
    df = spark.createDataFrame(rows, "_n int, v string, q string, t string").repartition(5)
    path = str(tmp_path / "out")
    write_table(df, path, order="_n")
    got = read_table(spark, path, ordered=True).orderBy(ORDER).collect()
    assert [(r.v, r.q or "", r.t) for r in got] == [r[1:] for r in rows]


def test_log(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "noise\n[START] task=clean_easy_ab12 env=e model=m x\n"
        '[STEP] step=1 action=run({"a": "x reward=9"}) reward=0.01 done=false error=null\n'
        "[STEP] step=2 action=submit() reward=0.95 done=true error=no tool call\n"
        "[END] success=true steps=2 score=0.95 rewards=0.01,0.95\n"
        "[START] task=clean_hard_cd34 env=e model=m x\n[END] success=false steps=0 score=0.01 rewards=0.01\n"
    )
    lines = read_log(spark, str(tmp_path))
    steps = parse_lines(lines).where("kind = 'STEP'").orderBy("step").collect()
    assert [(s.action, s.reward, s.done, s.error) for s in steps] == [
        ('run({"a": "x reward=9"})', 0.01, False, "null"),
        ("submit()", 0.95, True, "no tool call"),
    ]
    got = episodes(lines).orderBy("episode").collect()
    assert [(r.episode, r.task_id, r.level, r.reward, r.steps, r.success, r.rewards) for r in got] == [
        (1, "ab12", "easy", 0.95, 2, True, [0.01, 0.95]),
        (2, "cd34", "hard", 0.01, 0, False, [0.01]),
    ]


def test_draws_are_even_and_unrelated(spark):
    keys = spark.range(100_000)
    for start in (0, 10**12):
        k = F.col("id") + start
        a, b = pick(4, k, 42, "x").alias("a"), pick(5, k, 42, "y").alias("b")
        pairs = keys.select(a, b).groupBy("a", "b").count().collect()
        assert len(pairs) == 20 and all(4600 < r["count"] < 5400 for r in pairs)
    assert keys.select(draw("id", 0, "x").alias("d")).distinct().count() == 100_000
    same = keys.where(draw("id", 0, "x") == draw("id", 1, "x")).count()
    assert same < 10
    assert keys.select(choose("abc", "id", 1, "w").alias("w")).distinct().count() == 3


def test_rows_do_not_depend_on_partitions(spark):
    one = messy_rows(clean_rows(numbered(spark, 500).coalesce(1), "hr", 42), "hr", 42)
    many = messy_rows(clean_rows(numbered(spark, 500).repartition(9), "hr", 42), "hr", 42)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))


def test_spoil_clean_grade(spark):
    """Cleaning never lowers the score, and finds every row again."""
    specs = task_specs()
    for place, domain in enumerate(DOMAINS):
        clean = clean_rows(numbered(spark, 300), domain, place)
        messy = messy_rows(clean, domain, place)
        assert 300 < messy.count() < 345
        cleaned = clean_table(messy, specs[domain], [ROW, COPY])
        truth = clean.drop(ROW)
        before = grade(messy.drop(ROW, COPY), truth).first().reward
        after = grade(cleaned.drop(ROW, COPY), truth).first().reward
        assert cleaned.count() == 300 and after > before + 0.05, domain


def test_pairs_are_written(spark, tmp_path):
    assert write_pairs(numbered(spark, 20), str(tmp_path), 2) == ["hr", "healthcare"]
    assert sorted(os.listdir(tmp_path)) == [
        "healthcare_clean.csv", "healthcare_messy.csv", "hr_clean.csv", "hr_messy.csv",
    ]
    ids = [r.employee_id for r in read_table(spark, f"{tmp_path}/hr_clean.csv", ordered=True).orderBy(ORDER).collect()]
    assert ids == [f"EMP{i:04d}" for i in range(1, 21)]


def test_steps_of_a_job(spark):
    rows = [(1, "k", " a b", "1/2/24", "$5"), (2, "k", "c", "x", "7"), (3, "m", None, "", "-1")]
    df = spark.createDataFrame(rows, "n int, k string, name string, day string, paid string")
    spec = CleaningSpec(
        {"name": [title_case], "day": [dates()], "paid": [amount(1)]}, key="k", required=["name"]
    )
    assert [tuple(r) for r in clean_table(df, spec, "n").collect()] == [(1, "k", "A B", "2024-01-02", "5.0")]


def test_rules_run_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("name,day\n  ann lee ,1/18/24\n")
    stream = spark.readStream.schema("name string, day string").option("header", True).csv(str(tmp_path / "in"))
    cleaned = apply_rules(stream, {"name": [title_case], "day": [dates()]})
    query = cleaned.writeStream.format("memory").queryName("cleaned").start()
    try:
        query.processAllAvailable()
        assert [tuple(r) for r in spark.table("cleaned").collect()] == [("Ann Lee", "2024-01-18")]
    finally:
        query.stop()


def test_line_breaks_survive(spark, tmp_path):
    rows = [(str(i), f'line one\nline "two", {i}\r\nthree') for i in range(20)]
    write_table(spark.createDataFrame(rows, "k string, v string").repartition(3), str(tmp_path / "t"))
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "t")).collect())) == sorted(rows)
    with pytest.raises(Exception, match="MALFORMED"):
        read_table(spark, str(tmp_path / "t"), multiline=False).collect()


def test_headers_stay_as_written(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,Name,name,x,x,addr.city,\n1, a ,b,c,d,OSLO,e\n2,,,,,,\n")
    read = read_table(spark, str(tmp_path / "a.csv"))
    assert read.columns == ["id", "Name", "name", "x", "x", "addr.city", ""]
    assert [tuple(r) for r in read.collect()] == [("1", " a ", "b", "c", "d", "OSLO", "e"), ("2", *[None] * 6)]
    cleaned = apply_rules(read, {"Name": [title_case], "addr.city": [title_case]})
    assert cleaned.columns == read.columns and cleaned.first()[1] == "A" and cleaned.first()[5] == "Oslo"
    found = {(r["column"], r["check"]): r.n_bad for r in profile(read, "id").collect()}
    assert found["Name", "padded"] == 1 and found["name", "padded"] == 0 and found["addr.city", "missing"] == 1
    scores = grade(read, read).first()  # headers that are alike count once
    assert (scores.row_score, scores.cell_score) == (0.99, 0.99) and scores.column_score == pytest.approx(5 / 7)
    ordered = read_table(spark, str(tmp_path / "a.csv"), ordered=True)
    assert ordered.columns == [*read.columns, ORDER]


@pytest.mark.parametrize("headers", [("id,x,y", "id,y,x"), ("id,x,X", "id,X,x")])
def test_files_with_different_headers_raise(spark, tmp_path, headers):
    for name, header in zip("ab", headers, strict=True):
        (tmp_path / f"{name}.csv").write_text(f"{header}\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_table(spark, str(tmp_path)).collect()


def test_an_end_without_start_takes_no_other_task(spark, tmp_path):
    (tmp_path / "a.log").write_text("[START] task=t_easy_a1 env=e model=m\n[END] success=true steps=1 score=0.5 rewards=0.5\n")
    (tmp_path / "b.log").write_text("[END] success=true steps=3000000000 score=0.6 rewards=0.1,0.6\n[STEP] step=3000000000 action=a reward=0.1 done=false error=null\n")
    got = episodes(read_log(spark, str(tmp_path))).orderBy("episode").collect()
    assert [(r.task_id, r.env, r.reward, r.rewards) for r in got] == [("a1", "e", 0.5, [0.5]), (None, None, 0.6, [0.1, 0.6])]
    steps = parse_lines(read_log(spark, str(tmp_path))).where("kind = 'STEP'").collect()
    assert [s.step for s in steps] == [3_000_000_000]


def odd_table(seed, sep, n=250):
    """A text table with quotes of all kinds, line breaks in cells, rows too short and too long, and blank lines."""
    dice = random.Random(seed)

    def cell():
        text, kind = "".join(dice.choices(["a", "b", " ", '"', ",", "\n", "\r\n", "é", "x y"], k=dice.randrange(12))), dice.random()
        if kind < 0.6:
            return '"' + text.replace('"', '""') + '"'
        return 'Monitor 27"' if kind < 0.7 else 'say "hi" there' if kind < 0.75 else '"abc"def' if kind < 0.8 else text.strip('",\r\n ').replace(",", "").replace("\n", "").replace("\r", "").replace('"', "")

    lines = ['id,"te\nxt",num']
    for i in range(n):
        lines.append(",".join([str(i), cell(), cell(), *(["extra"] if dice.random() < 0.05 else [])]))
        if dice.random() < 0.1:
            lines.append("")
    return (sep.join(lines) + sep * (seed % 2)).encode()


@pytest.fixture
def small_splits(spark):
    """Files are cut every few bytes."""
    sizes = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in sizes}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("sep", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [120, 3000])
def test_one_file_read_by_many_tasks(spark, tmp_path, small_splits, sep, size):
    path = tmp_path / "t.csv"
    path.write_bytes(odd_table(size, sep))
    whole = [tuple(r) for r in read_table(spark, str(path), ordered=True, split=False).orderBy(ORDER).drop(ORDER).collect()]
    small_splits(size)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 1
    split = read_table(spark, str(path), ordered=True)  # larger than a partition: split unasked
    assert split.columns[1] == ("te\nxt") and [tuple(r) for r in split.orderBy(ORDER).drop(ORDER).collect()] == whole
    assert "FileScan csv" not in split._jdf.queryExecution().executedPlan().toString()
    if sep == "\n":
        flagged = [sorted(map(str, read_table(spark, str(path), broken="b.b", split=s).collect())) for s in (False, True)]
        assert flagged[0] == flagged[1]


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'line {i}, ""quoted""' for i in range(200))
    path = tmp_path / "t.csv"
    path.write_text(f'a,b\n1,"{long}"\n2,x\n3,"{long}"', encoding="utf-8")
    (tmp_path / "e.csv").write_text("", encoding="utf-8")
    want = [("1", long.replace('""', '"')), ("2", "x"), ("3", long.replace('""', '"'))]
    small_splits(200)
    assert [tuple(r) for r in read_table(spark, str(path), ordered=True).orderBy(ORDER).select("a", "b").collect()] == want
    # A folder on demand, with an empty file in it; headers in other casing, by place.
    assert sorted(tuple(r) for r in read_table(spark, str(tmp_path), split=True).collect()) == want
    (tmp_path / "t.csv").write_text("a,A\n1,2\n" * 1 + "3,4\n" * 200)
    both = read_table(spark, str(path))
    assert both.columns == ["a", "A"] and both.count() == 201


def test_heads_are_read_by_files(spark, tmp_path, monkeypatch):
    rows = "1,2\n" * 300_000
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text(f'\n"a\nb",c{i // 2}\n{rows}')
    got = heads(spark, str(tmp_path))
    assert sorted(cells_of(h) for h in got.values()) == [["a\nb", "c0"], ["a\nb", "c0"], ["a\nb", "c1"]]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") not in (None, str(1 << 40))


def test_a_file_that_breaks_off_counts_as_empty(spark, tmp_path):
    whole = "a,b\n" + "".join(f"{i},{random.Random(i).random()}\n" for i in range(40_000))
    packed = gzip.compress(whole.encode())
    for name, data in (("bad.csv.gz", packed[: len(packed) * 9 // 10]), ("good.csv.gz", packed)):
        (tmp_path / name).write_bytes(data)
    bad, good = (str(tmp_path / n) for n in ("bad.csv.gz", "good.csv.gz"))
    assert read_table_or_empty(spark, bad, stored=True).columns == []
    assert read_table_or_empty(spark, good, stored=True).count() == 40_000
    scores = [tuple(grade_file(spark, given, good).first()) for given in (bad, good, None, str(tmp_path / "none.csv"))]
    assert scores == [(0.01,) * 4, (0.99,) * 4, (0.01,) * 4, (0.01,) * 4]
    with pytest.raises(Exception, match="(?i)divi") as other:  # what has other causes is no unreadable file
        settle(read_table(spark, good).selectExpr("1 / (int(a) - int(a)) as x"), "t")
    assert not unreadable(other.value)


def test_one_file_is_written(spark, tmp_path):
    rows = [(i, f' v{i}, "q"\n', "" if i % 2 else "x") for i in range(200)]
    df = spark.createDataFrame(rows, "_n int, v string, w string").repartition(6).toDF("_n", 'Head, "er"', "head, \"er\"")
    path = tmp_path / "out" / "one.csv"
    write_table(df, str(path), order="_n", one_file=True)
    assert path.is_file() and sorted(p.name for p in path.parent.iterdir() if not p.name.endswith(".crc")) == ["one.csv"]
    read = read_table(spark, str(path), ordered=True).orderBy(ORDER).drop(ORDER)
    assert read.columns == df.columns[1:] and [(r[0], r[1] or "") for r in read.collect()] == [r[1:] for r in rows]
    with pytest.raises(FileExistsError):
        write_table(df, str(path), one_file=True)
    write_table(df.limit(0), str(path), mode="overwrite", one_file=True)
    assert read_table(spark, str(path)).columns == df.columns and path.read_text().count("\n") == 1
    write_table(df, str(path), mode="ignore", one_file=True)
    assert path.read_text().count("\n") == 1


def test_a_look_at_the_header_takes_few_lines_of_a_large_file(spark, tmp_path, monkeypatch):
    (tmp_path / "t.csv").write_text('"a\nb",c\n' + "1,2\n" * 30_000)
    frame = type(spark.range(1))
    mapped = frame.mapInArrow

    def watched(self, f, schema):
        def few(batches):
            for batch in batches:
                assert batch.num_rows < 100
                yield batch

        return mapped(self, lambda batches: f(few(batches)), schema)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert list(heads(spark, str(tmp_path / "t.csv")).values()) == ['"a\nb",c']
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
