"""Table jobs against brute force, with groups that hold a third of the rows."""

import random
import statistics
import uuid
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from burnish.functions.text import title_case
from burnish.operators import fills, ordering
from burnish.operators.dateorder import DAY, MONTH, date_order_votes, normalize_dates_voted
from burnish.operators.dedup import drop_exact_duplicates, drop_key_duplicates
from burnish.operators.fills import drop_missing, fill_median, fill_medians, fill_undated, median, medians
from burnish.operators.ids import continue_ids, positional_ids
from burnish.operators.ordering import carry_forward, with_position
from burnish.operators.profile import duplicate_checks, profile
from burnish.operators.report import outcome, summary, summary_by_level
from burnish.operators.usercode import apply_code, apply_grouped, apply_pandas, apply_table_code
from burnish.operators.vocabulary import canonicalize, canonicalize_typos, most_common_domain, repair_domains
from burnish.plans.spec import CleaningSpec, amount, clean_table
from burnish.session import settle


@pytest.fixture(scope="module")
def skewed():
    """(order, group, value): group 0 holds a third, order is shuffled and sparse."""
    dice = random.Random(5)
    rows = []
    for n in dice.sample(range(100_000), 3000):
        group = 0 if dice.random() < 0.34 else dice.randrange(1, 200)
        rows.append((n, group, dice.randrange(50) if dice.random() < 0.2 else None))
    return rows


def frame(spark, rows, schema, parts=7):
    return spark.createDataFrame(rows, schema).repartition(parts)


def test_position(spark, skewed):
    got = with_position(frame(spark, skewed, "n int, g int, v int").select("n"), "n", "p").collect()
    places = {n: i + 1 for i, n in enumerate(sorted(r[0] for r in skewed))}
    assert {r.n: r.p for r in got} == places


@pytest.mark.parametrize("group", [None, "g"])
def test_carry_forward(spark, skewed, group):
    got = carry_forward(frame(spark, skewed, "n int, g int, v int"), "v", "n", "c", group).collect()
    last, want = {}, {}
    for n, g, v in sorted(skewed):
        key = g if group else None
        last[key] = v if v is not None else last.get(key)
        want[n] = last[key]
    assert {r.n: r.c for r in got} == want


def test_carry_forward_across_whole_ranges_and_null_groups(spark):
    """One value at the start of a group must reach rows many ranges later."""
    rows = [(n, None if n < 500 else "b", 1 if n in (0, 700) else None) for n in range(2000)]
    got = carry_forward(frame(spark, rows, "n int, g string, v int"), "v", "n", "c", "g").collect()
    assert {r.n: r.c for r in got} == {n: (1 if n < 500 or n >= 700 else None) for n in range(2000)}


def test_ids(spark):
    rows = [(n, "" if n % 7 == 3 else (None if n % 11 == 5 else f"P{n:03d}")) for n in range(1, 401)]
    df = frame(spark, rows, "n int, id string")
    missing = [n for n, i in rows if not i]
    want = {n: (i or f"P{400 + 1 + missing.index(n):03d}") for n, i in rows}
    assert {r.n: r.id for r in continue_ids(df, "id", "n").collect()} == want
    assert {r.n: r.id for r in positional_ids(df, "id", "n").collect()} == {n: f"P{n:03d}" for n, _ in rows}
    none = frame(spark, [(n, "") for n in range(5)], "n int, id string")
    assert sorted(r.id for r in continue_ids(none, "id", "n").collect()) == [f"P{i:03d}" for i in range(1, 6)]


def test_undated(spark):
    rows = [(1, "x"), (2, "2024-01-17"), (3, "invalid"), (4, ""), (5, "2024-03-02"), (6, None)]
    got = fill_undated(frame(spark, rows, "n int, d string"), "d", "n").orderBy("n").collect()
    assert [r.d for r in got] == ["x", "2024-01-17", "2024-01-01", "2024-01-01", "2024-03-02", "2024-03-01"]


def test_dedup(spark):
    rows = [(0, "k1", "a"), (1, "k1", "b"), (2, "", "c"), (3, "", "c"), (4, None, "c"), (5, "k2", "a"), (6, "k1", "a")]
    df = frame(spark, rows, "n int, k string, v string")
    assert sorted(r.n for r in drop_key_duplicates(df, "k", "n").collect()) == [0, 2, 3, 4, 5]
    kept = drop_exact_duplicates(df, order="n")
    assert kept.columns == df.columns
    assert sorted(r.n for r in kept.collect()) == [0, 1, 2, 4, 5]
    assert drop_exact_duplicates(df.drop("n")).count() == 5
    assert sorted(r.n for r in drop_exact_duplicates(df, order="n", on="v").collect()) == [0, 1, 2]


def test_key_dedup_keeps_one_row_per_task_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = drop_key_duplicates(df, "k", "id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("n", [1, 2, 999, 1000])
@pytest.mark.parametrize("kind", ["spread", "two values", "hot"])
def test_median_is_exact(spark, n, kind):
    dice = random.Random(n)
    pick = {
        "spread": lambda: round(dice.uniform(-1e6, 1e6), 2),
        "two values": lambda: dice.choice([1.0, 2.0]),
        "hot": lambda: 5.0 if dice.random() < 0.34 else float(dice.randrange(100)),
    }[kind]
    values = [pick() for _ in range(n)]
    df = frame(spark, [(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    assert median(df, "v") == pytest.approx(statistics.median(values))


def test_fill_median(spark):
    df = frame(spark, [(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "v double")
    assert sorted(r.v for r in fill_median(df, "v").collect()) == [1.0, 2.0, 3.0, 4.0, 10.0]
    empty = frame(spark, [(None,)], "v double")
    assert median(empty, "v") is None and fill_median(empty, "v").first().v is None


def test_median_of_text(spark):
    df = frame(spark, [("1.5",), (" 2 ",), ("x",), ("",), (None,), ("4",)], "v string")
    assert sorted(str(r.v) for r in fill_median(df, "v").collect()) == sorted(["1.5", " 2 ", "x", "2.0", "2.0", "4"])
    spec = CleaningSpec({"v": [amount(2)]}, medians=["v"])
    messy = frame(spark, [("$1.00",), ("3",), ("",), (None,), ("USD 5",)], "v string")
    assert sorted(r.v for r in clean_table(messy, spec).collect()) == ["1.00", "3.00", "3.00", "3.00", "5.00"]


def test_drop_missing(spark):
    df = frame(spark, [("a", 1), (" ", 2), (None, 3), ("b", None)], "s string, n int")
    assert drop_missing(df, ["s", "n"]).collect() == [("a", 1)]


def test_a_hot_key_is_split(spark):
    """A third of the rows share a word: Spark reads its partition in pieces."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        word = F.when(F.col("id") % 3 == 0, "7").otherwise((F.col("id") % 3000).cast("string"))
        rows = spark.range(200_000, numPartitions=16).select(word.alias("k"), F.lit("x").alias("v"))
        found = canonicalize(rows, "k", spark.range(3000).select(F.col("id").cast("string").alias("w")), "w")
        assert len(found.collect()) == 200_000
        assert "SortMergeJoin(skew=true)" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_canonicalize_never_multiplies_rows(spark):
    df = frame(spark, [(" fedex ",), ("DHL",), ("odd ",), (None,), ("",)], "c string")
    words = frame(spark, [("FedEx",), ("FEDEX",), ("dhl",), (None,), ("",)], "w string")
    got = [r.c for r in canonicalize(df, "c", words, "w").collect()]
    assert sorted(got, key=str) == ["", "FEDEX", None, "dhl", "odd"]


def test_ties_and_nulls_in_the_order_keep_every_row_once(spark):
    rows = [(1, "", "a"), (1, "P1", "b"), (1, None, "c"), (2, "", "d"), (None, "", "e"), (None, "P9", "f")]
    df = frame(spark, rows, "n int, id string, v string")
    for fill in (continue_ids, positional_ids):
        got = fill(df, "id", "n").collect()
        assert sorted(r.v for r in got) == list("abcdef") and all(r.id for r in got)
        assert len({r.id for r in got if r.v in "acde"}) == 4
    dated = frame(spark, [(1, "2024-05-06"), (1, "x"), (1, "y"), (None, "z")], "n int, d string")
    assert fill_undated(dated, "d", "n").count() == 4


def test_names_of_helper_columns_keep_clear(spark):
    names = ["_place", "_slot", "_range", "_group", "_key", "_word", "_row", "_own", "_new0", "_of0", "a.b", "id"]
    df = frame(spark, [tuple([i] * 10 + [f"k{i % 2}", "" if i else "P1"]) for i in range(6)], ", ".join(f"`{n}` {'string' if n in ('a.b', 'id') else 'int'}" for n in names))
    assert drop_key_duplicates(df, "a.b", "_place").count() == 2
    assert drop_exact_duplicates(df, order="_slot").columns == names
    assert positional_ids(df, "id", "_row").columns == names
    assert canonicalize(df, "a.b", frame(spark, [("K0",)], "w string"), "w").columns == names
    assert {r["column"] for r in profile(df, "a.b").collect()} >= {"a.b", "_place"}


HEADERS = ["n", "id", "ID", "Name", "name", "addr.city", "Addr.City", "name"]


def headed(spark, rows):
    return frame(spark, rows, ", ".join(f"c{i} {'int' if i == 0 else 'string'}" for i in range(len(HEADERS)))).toDF(*HEADERS)


def test_headers_that_differ_in_case_only(spark):
    rows = [
        (1, "a", "2024-03-05", "x", "1", "Oslo", "ann@b.org", "p"),
        (2, "", "nothing", "x", "3", None, "bob@b", "p"),
        (3, "a", "2024-05-06", "y", "", "Rome", "eveb.org", "q"),
        (4, "P9", "none", "x", "8", "rome", "ann@b.org", "q"),
    ]
    df = headed(spark, [*rows, (5, *rows[0][1:])])

    def column(found, place):
        assert found.columns == HEADERS
        return [r[place] for r in sorted(found.collect(), key=lambda r: r[0])]

    assert column(drop_exact_duplicates(df, "n"), 0) == [1, 2, 3, 4]
    assert sorted(column(drop_exact_duplicates(df, "n", on=["Name"]), 0)) == [1, 3]
    assert column(drop_key_duplicates(df, "id", "n"), 0) == [1, 2, 4]
    assert column(drop_missing(df, ["addr.city", "id"]), 0) == [1, 3, 4, 5]
    assert column(fill_median(df, "name"), 4) == ["1", "3", "2", "8", "1"]
    assert median(df, "name") == 2.0
    assert column(repair_domains(df, "Addr.City"), 6) == ["ann@b.org", "bob@b.org", "eve@b.org", "ann@b.org", "ann@b.org"]
    assert most_common_domain(df, "Addr.City").first().domain == "b.org"
    assert column(continue_ids(df, "id", "n"), 1) == ["a", "P010", "a", "P9", "a"]
    assert column(positional_ids(df, "id", "n"), 1) == ["a", "P002", "a", "P9", "a"]
    assert column(fill_undated(df, "ID", "n"), 2) == ["2024-03-05", "2024-03-01", "2024-05-06", "2024-05-01", "2024-03-05"]
    words = spark.createDataFrame([("OSLO",), ("ROME",)], "w string").toDF("a.b")
    assert column(canonicalize(df, "addr.city", words, "a.b"), 5) == ["OSLO", None, "ROME", "ROME", "OSLO"]
    assert with_position(df, "n", "place").columns == [*HEADERS, "place"]
    assert carry_forward(df, "addr.city", "n", "seen", "Name").columns == [*HEADERS, "seen"]
    # A name in other casing is found where only one column can be meant.
    assert column(drop_missing(df, "ADDR.CITY".lower()), 0) == [1, 3, 4, 5]
    assert drop_missing(frame(spark, [("a",), (None,)], "K string"), "k").count() == 1
    for unknown in ("other", "NAME"):
        with pytest.raises(ValueError):
            drop_missing(df, unknown)


def test_a_repeated_header_keeps_its_rule_in_every_place(spark):
    df = headed(spark, [(1, "a", "b", "c", " d ", "e", "f", " g ")])
    cleaned = clean_table(df, CleaningSpec({"name": [title_case], "n": []}), "n")
    assert cleaned.columns == HEADERS and tuple(cleaned.first()) == (1, "a", "b", "c", "D", "e", "f", "G")


def jobs_of(spark, run):
    """Number of jobs that a call starts."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_medians_of_many_columns_take_as_many_jobs_as_of_one(spark):
    dice = random.Random(3)
    rows = [[None if dice.random() < 0.1 else round(dice.uniform(-9, 9) * 10**c, 2) for c in range(5)] for _ in range(3001)]
    df = frame(spark, rows, ", ".join(f"v{c} double" for c in range(5))).select(*(F.col(f"v{c}") for c in range(5)))
    names = [f"v{c}" for c in range(5)]
    want = [statistics.median([r[c] for r in rows if r[c] is not None]) for c in range(5)]
    assert medians(df, names) == pytest.approx(want)
    assert medians(df, []) == [] and medians(df.where("false"), names) == [None] * 5
    one, all_of = (jobs_of(spark, lambda some=some: medians(df, some)) for some in (names[:1], names))
    assert one == all_of
    assert sorted(map(repr, fill_medians(df, names[:2]).collect())) == sorted(map(repr, fill_median(fill_median(df, "v0"), "v1").collect()))


@pytest.mark.parametrize("few", [1, 50])
def test_medians_by_several_looks(spark, few, monkeypatch):
    """Brackets are narrowed until a task may sort what is in them; a sketch that is off is found out."""
    monkeypatch.setattr(fills, "_FEW", few)
    monkeypatch.setattr(fills, "_QUANTILES", 4)
    dice = random.Random(few)
    values = [dice.choice([dice.gauss(0, 1), 0.25, float(dice.randrange(4))]) for _ in range(4001)]
    df = frame(spark, [(v, -v, 7.0) for v in values], "a double, b double, c double")
    assert medians(df, ["a", "b", "c"]) == pytest.approx([statistics.median(values), -statistics.median(values), 7.0])
    narrowed = fills._Search.narrowed

    def off(self, below, inside, grid):
        return replace(narrowed(self, below, inside, grid), low=grid[-1], high=grid[-1], inside=0)

    monkeypatch.setattr(fills._Search, "narrowed", off)
    assert medians(df, ["a", "c"]) == pytest.approx([statistics.median(values), 7.0])


def test_dates_are_carried_with_one_shuffle_of_the_rows(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ordering, "settle", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df, name))
    df = spark.range(1000).selectExpr("id as n", "id % 7 as g", "if(id % 5 = 0, id, null) as v")
    found = carry_forward(df, "v", "n", "c", "g")
    assert plans[0].count("Exchange") == 1 and "rangepartitioning" in plans[0]
    # What is left is a table with one row per range; the rows themselves are not shuffled again.
    plan = found._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.splitlines() if "Window" in line]
    assert "Sort" not in plan.split("BroadcastExchange")[0] and rows
    want, last = {}, {}
    for n in range(1000):
        last[n % 7] = n if n % 5 == 0 else last.get(n % 7)
        want[n] = last[n % 7]
    assert {r.n: r.c for r in found.collect()} == want


@pytest.mark.parametrize("kind", ["double", "string", "date", "struct<a:int,b:string>", "decimal(9,2)"])
def test_carried_values_and_groups_of_any_type(spark, kind):
    cell = {"double": "if(id = 9, double('nan'), id / 4)", "string": "string(id)", "date": "date_add(date'2024-01-01', int(id))"}
    value = cell.get(kind, "named_struct('a', int(id), 'b', 'x')" if kind.startswith("struct") else "cast(id as decimal(9,2))")
    df = spark.range(40).selectExpr("id as n", f"cast(if(id % 4 = 1, {value}, null) as {kind}) as v", "if(id < 7, double('nan'), if(id < 20, null, 1.5)) as g")
    found = carry_forward(df.repartition(3), "v", "n", "c", "g").orderBy("n").collect()
    group, last = None, None
    for r in found:
        own = "nan" if r.n < 7 else None if r.n < 20 else 1.5
        last = r.v if r.v is not None else (last if own == group and r.n else None)
        group = own
        assert repr(r.c) == repr(last), r


def test_typos(spark):
    words = frame(spark, [(w,) for w in ("Marketing", "Finance", "Financed", "IT", "Sales", "SALES ", "Straße", None, "")], "w string")
    given = {
        "marketing": "Marketing", "Markting": "Marketing", "MARKETTING": "Marketing", " marketimg ": "Marketing", "finance": "Finance",
        "financd": "financd", "Financee": "Financee", "inance": "Finance", "salse": "salse", "sale": "SALES", "it": "IT", "i": "i",
        "ITT": "ITT", "strase": "Straße", "Markeeeting": "Markeeeting", "": "", None: None,
    }
    df = frame(spark, [(c, n) for n, c in enumerate(given)], "c string, n int")
    found = {r.n: r.c for r in canonicalize_typos(df, "c", words, "w").collect()}
    assert found == dict(enumerate(given.values()))
    two = {r.c for r in canonicalize_typos(frame(spark, [("markeeeting",), ("salse",), ("fnanc",)], "c string"), "c", words, "w", distance=2).collect()}
    assert two == {"Marketing", "SALES", "Finance"}
    with pytest.raises(ValueError):
        canonicalize_typos(df, "c", words, "w", distance=0)


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_typos_against_all_pairs(spark, distance):
    dice = random.Random(distance)
    words = sorted({"".join(dice.choices("abc", k=dice.randrange(3, 8))) for _ in range(60)})
    values = sorted({"".join(dice.choices("abcd", k=dice.randrange(2, 9))) for _ in range(200)})
    df = frame(spark, [(v, v) for v in values], "v string, c string")
    found = {r.v: r.c for r in canonicalize_typos(df, "c", frame(spark, [(w,) for w in words], "w string"), "w", distance).collect()}
    for v in values:
        near = sorted((edits_between(v, w), w) for w in words if min(len(v), len(w)) >= 4 and edits_between(v, w) <= distance)
        best = [w for e, w in near if e == near[0][0]]
        assert found[v] == (v if v in words or len(best) != 1 else best[0]), v


def test_date_order_by_votes(spark):
    rows = [("a", "25-03-2024"), ("a", "03-04-2024"), ("a", " 13-1-2024 "), ("a", "1-13-2024"), ("b", "03-25-2024"), ("b", "03-04-2024")]
    rows += [("c", "03-04-2024"), ("c", "5-5-2024"), (None, "12-31-2024"), (None, "01-02-2024"), ("d", None), ("d", "x"), ("d", "45-01-2024")]
    df = frame(spark, rows, "g string, d string").toDF("G.g", "d")
    got = {r["G.g"]: tuple(r)[1:] for r in date_order_votes(df, "d", "G.g").collect()}
    assert got == {"a": (2, 1, 1, DAY), "b": (0, 1, 1, MONTH), "c": (0, 0, 1, DAY), None: (0, 1, 1, MONTH), "d": (0, 0, 0, DAY)}
    assert date_order_votes(df.where("`G.g` = 'c'"), "d", "G.g", MONTH).first().date_order == MONTH
    read = normalize_dates_voted(df, "d", "G.g")
    assert read.columns == df.columns
    found = sorted(map(tuple, read.collect()), key=str)
    want = [("a", "2024-03-25"), ("a", "2024-04-03"), ("a", "2024-01-13"), ("a", "2024-01-13"), ("b", "2024-03-25"), ("b", "2024-03-04")]
    want += [("c", "2024-04-03"), ("c", "2024-05-05"), (None, "2024-12-31"), (None, "2024-01-02"), ("d", None), ("d", "x"), ("d", "45-01-2024")]
    assert found == sorted(want, key=str)
    whole = normalize_dates_voted(df.where("`G.g` in ('b', 'c')"), "d")
    assert sorted(r.d for r in whole.collect()) == ["2024-03-04", "2024-03-04", "2024-03-25", "2024-05-05"]
    with pytest.raises(ValueError):
        date_order_votes(df, "d", default="year first")


SNIPPETS = {
    "duplicates": lambda t: t.drop_duplicates(),
    "median": lambda t: t.assign(v=t["v"].fillna(t["v"].median())),
    "by group": lambda t: t.groupby("g", as_index=False)["v"].max(),
    "column": lambda t: t["g"].drop_duplicates(),
}


@pytest.mark.parametrize("name", sorted(SNIPPETS))
def test_code_for_whole_tables_does_not_depend_on_batches(spark, name):
    rows = [(i % 13, float(i % 7) if i % 3 else None) for i in range(401)]
    df, code = frame(spark, rows, "g int, v double"), SNIPPETS[name]
    results = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            results.append(sorted(map(repr, apply_table_code(df, code).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = code(pd.DataFrame(rows, columns=["g", "v"]))
    assert results[0] == results[1] and len(results[0]) == len(want)


def test_code_for_groups(spark):
    rows = [(i % 5 if i % 11 else None, float(i) if i % 4 else None, i) for i in range(200)]
    df = frame(spark, rows, "a int, b double, c int").toDF("Key", "key", "n")
    code = lambda t: t.assign(key=t["key"].fillna(t["key"].median())).sort_values("n").drop_duplicates("Key")
    results = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            results.append(sorted(map(repr, apply_grouped(df, code, "Key").collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert results[0] == results[1] and len(results[0]) == 6
    with pytest.raises(ValueError):
        apply_grouped(df, code, "Key", most_rows=20)


def test_domains(spark):
    rows = [("a@x.com",), ("b@x.com",), ("c@y.com",), ("d@z",), ("ex.com",), (None,)]
    df = frame(spark, rows, "e string")
    assert most_common_domain(df, "e").first().domain == "x.com"
    got = {r.e for r in repair_domains(df, "e").collect()}
    assert got == {"a@x.com", "b@x.com", "c@y.com", "d@x.com", "e@x.com", None}
    nothing = frame(spark, [("d@z",), (None,)], "e string")
    assert {r.e for r in repair_domains(nothing, "e").collect()} == {"d@z", None}


def test_profile(spark):
    rows = [("1", "a@b.c", "1/2/2024"), ("1", " A@B.C ", "x"), ("", "bad", ""), ("", "bad", "")]
    df = frame(spark, rows, "id string, mail string, day string")
    found = {(r["column"], r["check"]): r.n_bad for r in profile(df, "id", dates=["day"], emails=["mail"]).collect()}
    assert found["*", "duplicate row"] == 1 and found["id", "duplicate key"] == 1
    assert found["id", "missing"] == 2 and found["mail", "padded"] == 1 and found["mail", "invalid email"] == 2
    assert found["day", "date m/d/yyyy"] == 1 and found["day", "date other"] == 1 and found["day", "date blank"] == 2
    nothing = duplicate_checks(df.limit(0), "id").collect()
    assert [(r.n_bad, r.n_rows, r.ratio) for r in nothing] == [(0, 0, 0.0)] * 2


def test_duplicate_rows_tell_null_from_empty_and_shifted_cells(spark):
    df = frame(spark, [("a", None), ("a", ""), ("a,", "b"), ("a", ",b"), ("1,a", "b")], "x string, y string")
    assert duplicate_checks(df).first().n_bad == 0


def test_user_code(spark):
    df = frame(spark, [(" a",), ("b ",)], "s string")
    assert sorted(r.s for r in apply_code(df, lambda d: d.select(F.trim("s").alias("s"))).collect()) == ["a", "b"]

    def code(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(s=rows["s"].str.strip())

    assert sorted(r.s for r in apply_pandas(df, code).collect()) == ["a", "b"]


@pytest.mark.parametrize("rows", ["3", "10000"])
def test_row_wise_code_does_not_depend_on_the_batch(spark, rows):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        df = spark.range(100, numPartitions=1).selectExpr("concat(' ', id) as s")
        got = apply_pandas(df, lambda batch: batch.assign(s=batch["s"].str.strip())).collect()
        assert sorted(int(r.s) for r in got) == list(range(100))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_reports(spark):
    rows = [(1, "easy", 0.5, 2), (2, "hard", 0.3, 4), (3, "easy", 0.31, 3)]
    df = spark.createDataFrame(rows, "episode int, level string, reward double, steps int")
    assert tuple(summary(df).first()) == (3, pytest.approx(0.37), 3.0)
    assert [tuple(r) for r in summary_by_level(df).collect()] == [("easy", pytest.approx(0.405), 2), ("hard", 0.3, 1)]
    assert [r[0] for r in df.orderBy("episode").select(outcome("reward")).collect()] == ["SUCCESS", "FAILED", "PARTIAL"]


def test_code_for_groups_is_handed_many_groups_at_once_and_sees_each_as_it_is(spark):
    big = 2**60 + 1
    rows = [(n % 50 if n % 50 else None, big + n if n % 7 else None, n % 2 == 0 if n % 50 != 3 else None, None if n % 50 == 5 else f"x{n % 3}") for n in range(400)]
    df = frame(spark, rows, "k int, n long, b boolean, s string")

    def code(rows):
        kinds = ",".join(map(str, rows.dtypes))
        return pd.DataFrame({"k": rows["k"], "n": rows["n"], "kinds": kinds, "s": rows["s"], "m": len(rows), "i": rows.index})

    schema = "k int, n long, kinds string, s string, m long, i long"
    plain = df.groupBy("k").applyInPandas(code, schema)
    got = apply_grouped(df, code, "k", schema)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, got.select("k", "n", "kinds", "s", "m").collect())) == sorted(map(key, plain.select("k", "n", "kinds", "s", "m").collect()))
    calls = got.groupBy("k", "i").count().where("count > 1").count()
    assert calls == 0
    tasks_of = got._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapGroupsInPandas" in tasks_of and "_bucket" in tasks_of
    assert apply_grouped(df.where("false"), code, "k", schema).count() == 0
    assert apply_grouped(df, lambda rows: rows[:0], "s").count() == 0
