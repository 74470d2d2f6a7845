"""Source and sink queries: tables and logs written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions import dirt as D
from burnish.functions.text import lower_strip, strip
from burnish.operators.grade import bounded
from burnish.operators.ordering import with_position
from burnish.operators.report import succeeded, summary_by_level
from burnish.plans.spec import apply_rules
from burnish.plans.synth import COPY, ROW, clean_rows, domain_seed, messy_rows
from burnish.queries import messy as M
from burnish.queries.dirt import KEYS
from burnish.queries.registry import query, table
from burnish.session import scratch_path
from burnish.sources.catalog import TASKS, task_catalog
from burnish.sources.episodes import episode_lines, episodes, parse_lines, read_log, write_log
from burnish.sources.tables import ORDER, read_table, write_table


@query(
    f"""select part_id, name, nullif(kind, '') as kind, nullif(size, '') as size, price,
        row_number() over (order by k) as place from ({M.PARTS_MESSY})"""
)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding, tabs, quotes and commas survive; blanks come back as null; file order is row order."""
    path = scratch_path(spark, "parts")
    columns = ["part_id", "name", "kind", "size", "price"]
    rows = M.parts_messy(spark, sf_dir).select(F.col("k").alias("_k"), *columns)
    write_table(rows, path, order="_k")
    return with_position(read_table(spark, path, ordered=True), "_order", "place").drop("_order")


_DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


@query(f"select {', '.join(f'nullif({c}::varchar, \'\') as {c}' for c in _DOCUMENT)} from documents")
def csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with their line breaks survive a write and a read."""
    path = scratch_path(spark, "documents")
    write_table(table(spark, sf_dir, "documents").select(*[F.col(c).cast("string").alias(c) for c in _DOCUMENT]), path)
    return read_table(spark, path)


@query(
    f"select {', '.join(f'nullif({c}::varchar, \'\') as {c}' for c in _DOCUMENT)}, row_number() over (order by doc_id, text) as place from documents"
)
def csv_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in one file: written by many tasks, and read by many, line breaks and order kept."""
    path = f"{scratch_path(spark, 'documents')}/all.csv"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), *[F.col(c).cast("string").alias(c) for c in _DOCUMENT])
    write_table(docs.withColumn("_text", F.col("text")), path, order=["_id", "_text"], one_file=True)
    return with_position(read_table(spark, path, ordered=True, split=True), ORDER, "place").drop(ORDER)


@query(
    f"""select nullif(customer_id, '') as id, {M.strip_sql("nullif(name, '')")} as name,
        lower({M.strip_sql("nullif(email, '')")}) as email, lower({M.strip_sql("nullif(segment, '')")}) as city
    from ({M.CUSTOMERS_MESSY})"""
)
def csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that differ in case only or hold a dot are written, read and cleaned as they are."""
    path = scratch_path(spark, "headers")
    rows = M.customers_messy(spark, sf_dir).select("customer_id", "name", "email", "segment")
    write_table(rows.toDF("id", "Name", "name", "addr.city"), path)
    read = read_table(spark, path)
    cleaned = apply_rules(read, {"Name": [strip], "name": [lower_strip], "addr.city": [lower_strip]})
    return cleaned.toDF("id", "name", "email", "city")


def _catalog_sql() -> str:
    parts = []
    for domain in ("healthcare", "logistics"):
        level = next(t.level for t in TASKS if t.name == domain)
        copied = M.happens_sql(D.COPY_RATE, "c_custkey", domain_seed(list(KEYS).index(domain)), "copy")
        parts.append(
            f"select '{domain}' as task, '{level}' as level, "
            f"(count(*) + coalesce(sum(({copied})::int), 0))::bigint as n_messy, count(*) as n_clean from customer"
        )
    return " union all ".join(parts)


@query(_catalog_sql(), name="task_catalog")
def catalog_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only tasks whose two tables exist are listed; a lone table does not count."""
    folder = scratch_path(spark, "catalog")
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(ROW))
    for domain in ("healthcare", "logistics", "hr"):
        seed = domain_seed(list(KEYS).index(domain))
        clean = clean_rows(keys, domain, seed)
        write_table(clean, f"{folder}/{domain}_clean.csv", order=ROW)
        if domain != "hr":
            write_table(messy_rows(clean, domain, seed), f"{folder}/{domain}_messy.csv", order=[ROW, COPY])
    # A decoy further down, under a folder of the same name.
    decoy = clean_rows(keys.limit(1), "hr", 0)
    write_table(decoy, f"{folder}/old/{folder.rsplit('/', 1)[-1]}/hr_messy.csv", order=ROW)
    listed = task_catalog(spark, folder, [t for t in TASKS if not t.always])
    counted = None
    for task in listed.collect():
        sides = [("n_messy", task.messy_file), ("n_clean", task.clean_file)]
        n = None
        for name, path in sides:
            one = read_table(spark, path).agg(F.count(F.lit(1)).alias(name))
            n = one if n is None else n.unionByName(one, allowMissingColumns=True)
        row = n.agg(*[F.max(c).alias(c) for c, _ in sides])
        row = row.select(F.lit(task.task).alias("task"), F.lit(task.level).alias("level"), "n_messy", "n_clean")
        counted = row if counted is None else counted.unionByName(row)
    return counted


# One run per user, one step per event of the user.
_STEPS = """select user_id as episode, event_id as step, event_type as action,
    (round(value * 100)::bigint % 99 + 1) / 100 as reward, event_type = 'purchase' as done,
    case when event_type = 'error' then 'timed out' end as error from events"""
_RUNS = f"""select episode, count(*)::int as steps, max(reward) as score, min(reward) as worst from ({_STEPS}) group by 1"""


def _logged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reward = bounded((F.round(F.col("value") * 100).cast("bigint") % 99 + 1) / 100)
    steps = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode"),
        F.col("event_id").cast("bigint").alias("step"),
        F.col("event_type").alias("action"),
        reward.alias("reward"),
        (F.col("event_type") == "purchase").alias("done"),
        F.when(F.col("event_type") == "error", "timed out").alias("error"),
    )
    level = F.get(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("episode") % 3).cast("int"))
    runs = (
        steps.groupBy("episode")
        .agg(F.count(F.lit(1)).cast("int").alias("steps"), F.max("reward").alias("score"), F.min("reward").alias("worst"))
        .select(
            "episode",
            F.format_string("clean_%s_%08d", level, F.col("episode")).alias("task"),
            F.lit("tables").alias("env"),
            F.lit("some model").alias("model"),
            succeeded("score").alias("success"),
            "steps",
            "score",
            F.array("worst", "score").alias("rewards"),
        )
    )
    return runs, steps


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "log")
    write_log(episode_lines(*_logged(spark, sf_dir)), path)
    return read_log(spark, path)


@query(
    f"""select step::bigint as step, action, reward, done, coalesce(error, 'null') as error
    from ({_STEPS})"""
)
def log_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_lines(_written(spark, sf_dir)).where("kind = 'STEP'")
    return parsed.select("step", "action", "reward", "done", "error")


_EPISODES = f"""select row_number() over (order by episode) as episode, printf('%08d', episode) as task_id,
    ['easy', 'medium', 'hard'][1 + episode % 3] as level, score as reward, steps, score >= 0.5 as success
    from ({_RUNS})"""


@query(_EPISODES)
def log_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(_written(spark, sf_dir)).select("episode", "task_id", "level", "reward", "steps", "success")


@query(
    f"""select level, round(avg(reward), 6) as average_reward, count(*) as episodes from ({_EPISODES}) group by level"""
)
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = summary_by_level(episodes(_written(spark, sf_dir)))
    return levels.select("level", F.round("average_reward", 6).alias("average_reward"), "episodes")


@query(
    f"""select printf('%08d', episode) as task_id, 'tables' as env, 'some model' as model, score >= 0.5 as success,
        2 as n_rewards, worst as first_reward, score as last_reward from ({_RUNS})"""
)
def log_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the lines around a run, several rewards among them."""
    rewards = F.col("rewards")
    return episodes(_written(spark, sf_dir)).select(
        "task_id",
        "env",
        "model",
        "success",
        F.size(rewards).alias("n_rewards"),
        F.get(rewards, F.lit(0)).alias("first_reward"),
        F.get(rewards, F.lit(1)).alias("last_reward"),
    )


@query(
    f"""select row_number() over (order by episode) as episode, case when episode % 3 <> 1 then printf('%08d', episode) end as task_id,
        steps from ({_RUNS})"""
)
def log_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the runs has lost its START line: its END takes no other run's."""
    path = scratch_path(spark, "starts")
    lines = episode_lines(*_logged(spark, sf_dir))
    write_log(lines.where((F.col("line") > 0) | (F.col("episode") % 3 != 1)), path)
    return episodes(read_log(spark, path)).select("episode", "task_id", "steps")
