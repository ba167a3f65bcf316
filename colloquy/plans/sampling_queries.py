"""Queries over the dataset: shards, samples, schedules, batches, routing."""

from pyspark.sql import functions as F

from colloquy.functions.text import round_robin
from colloquy.operators import batching, sampling
from colloquy.plans import sqltext as Q
from colloquy.plans.registry import query
from colloquy.plans.views import table, v_rows, with_views

c = F.col

# the coerced dataset: question from the problem unless blank, index from 0
_TASKS = f"""SELECT idx AS source_idx, CASE WHEN {Q.strip('problem')} <> '' THEN problem END AS question,
  coalesce(nullif(ground_truth, ''), nullif(answer, ''), nullif(solution, ''), nullif(label, '')) AS ground_truth FROM v_rows"""
_EXTRA = {"tasks": _TASKS}


def dataset(spark, d):
    from colloquy.functions.coerce import with_question_and_truth

    return with_question_and_truth(v_rows(spark, d), "rows").select(
        c("idx").alias("source_idx"), "question", "ground_truth"
    )


def _tasks(df, split="train"):
    return df.withColumn("uid", sampling.task_uid(split, c("source_idx"))).select("uid", "question", "ground_truth")


def _sql(body: str) -> str:
    return with_views("v_rows", body, _EXTRA)


@query("shard_filter", "SELECT doc_id AS source_idx, source FROM documents WHERE doc_id % 4 = 1")
def shard_filter(spark, d):
    rows = table(spark, d, "documents").select(c("doc_id").alias("source_idx"), "source")
    return sampling.shard_filter(rows, 1, 4)


@query("sample_random", _sql("""
SELECT 'train_' || source_idx AS uid, question, ground_truth FROM (
  SELECT * FROM tasks WHERE source_idx % 2 = 1 ORDER BY md5('7:' || source_idx), source_idx LIMIT 256) s
WHERE question <> ''"""))
def sample_random(spark, d):
    return _tasks(sampling.sample_random(dataset(spark, d), 256, seed=7, shard=1, shards=2))


@query("sample_random_all", _sql("""
SELECT 'part_' || (row_number() OVER (ORDER BY md5('3:' || source_idx), source_idx) - 1) AS uid, source_idx, question
FROM tasks QUALIFY row_number() OVER (ORDER BY md5('3:' || source_idx), source_idx) <= 128
UNION ALL SELECT 'whole_' || source_idx, source_idx, question FROM tasks"""))
def sample_random_all(spark, d):
    data = dataset(spark, d)
    part = sampling.sample_random_all(data, 128, seed=3)
    whole = sampling.sample_random_all(data, 1 << 40, seed=3)
    named = lambda df, s: df.withColumn("uid", sampling.task_uid(s, c("sample_pos"))).select("uid", "source_idx", "question")
    return named(part, "part").unionByName(named(whole, "whole"))


_FRESH_ROUNDS, _FRESH_SEED, _FRESH_BATCH = 2, 11, 40


@query("fresh_rounds", _sql(" UNION ALL ".join(f"""
SELECT {r}::BIGINT AS round, '{"gen" if r % 2 else "ver"}' AS role, 'train_' || (row_number() OVER (ORDER BY md5('{_FRESH_SEED + r}:' || source_idx), source_idx) - 1) AS uid, source_idx
FROM tasks QUALIFY row_number() OVER (ORDER BY md5('{_FRESH_SEED + r}:' || source_idx), source_idx) <= {_FRESH_BATCH}"""
for r in range(1, 2 * _FRESH_ROUNDS + 1))))
def fresh_rounds(spark, d):
    """The tasks of every round of the tagged protocol, each a sample of its own."""
    from colloquy.plans.jobs import RoundOptions, sample_tagged_tasks

    data, options = dataset(spark, d), RoundOptions(batch_tasks=_FRESH_BATCH)
    rounds = sampling.fresh_schedule(spark, _FRESH_ROUNDS, _FRESH_SEED).collect()
    found = [
        sample_tagged_tasks(data, options, r["seed"]).select(F.lit(r["round"]).cast("bigint").alias("round"), F.lit(r["role"]).alias("role"), "uid", "source_idx")
        for r in rounds
    ]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


_WALK = """SELECT *, ((pos - {start}) % size + size) % size AS rot FROM (
  SELECT *, source_idx // {n} AS pos, count(*) OVER () AS size FROM tasks WHERE source_idx % {n} = {k}) p"""


@query("sample_sequential", _sql(f"""
SELECT 'train_' || source_idx AS uid, question, ground_truth, row_number() OVER (ORDER BY rot) - 1 AS batch_pos
FROM ({_WALK.format(start=200, n=3, k=1)}) w WHERE question <> '' QUALIFY row_number() OVER (ORDER BY rot) <= 200"""))
def sample_sequential(spark, d):
    taken = sampling.sample_sequential(dataset(spark, d), 200, start=200, shard=1, shards=3)
    return taken.withColumn("uid", sampling.task_uid("train", c("source_idx"))).select(
        "uid", "question", "ground_truth", "batch_pos"
    )


@query("dataset_head", _sql(f"""
SELECT 'train_' || source_idx AS uid, question, ground_truth
FROM ({_WALK.format(start=10, n=1, k=0)}) w WHERE question <> '' QUALIFY row_number() OVER (ORDER BY rot) <= 100"""))
def dataset_head(spark, d):
    from colloquy.plans.jobs import RoundOptions, dump_dataset_head
    from colloquy.schema import TASK
    from colloquy.session import new_folder

    out = new_folder(spark, "dataset-head")
    options = RoundOptions(dataset_head=100, sample_mode="sequential", sample_start=10)
    dump_dataset_head(dataset(spark, d), options, out)
    return spark.read.schema(TASK).json(f"{out}/dataset_head_sample.jsonl")


_PAIRS, _BATCH, _START = 6, 150, 40
_ROUND_CTES = {
    **_EXTRA,
    "shard": "SELECT source_idx, question, source_idx // 2 AS pos FROM tasks WHERE source_idx % 2 = 0",
    "ne": "SELECT *, row_number() OVER (ORDER BY pos) - 1 AS rk FROM shard WHERE question <> ''",
    "m": "SELECT (SELECT count(*) FROM shard) AS size, (SELECT count(*) FROM ne) AS total",
    "p": f"SELECT pair_idx, total, ({_START} + pair_idx * {_BATCH}) % size AS off FROM (SELECT unnest(range(0, {_PAIRS})) AS pair_idx) r, m",
    "first": "SELECT pair_idx, total, (SELECT count(*) FROM ne WHERE ne.pos < p.off) AS r0 FROM p",
    "slots": f"SELECT pair_idx, k, (r0 + k) % total AS rk FROM (SELECT *, unnest(range(0, least({_BATCH}, total))) AS k FROM first) e",
    "placed": "SELECT pair_idx, k, source_idx, question FROM slots JOIN ne USING (rk)",
}


def _batches(spark, d):
    return sampling.round_batches(
        dataset(spark, d).select("source_idx", "question"), _PAIRS, _BATCH, start=_START, shard=0, shards=2
    )


@query("round_batches", with_views("v_rows", "SELECT pair_idx, k, source_idx, question FROM placed", _ROUND_CTES))
def round_batches(spark, d):
    return _batches(spark, d).select("pair_idx", "k", "source_idx", "question")


@query("pair_tasks", with_views("v_rows", f"""
SELECT r.round, CASE WHEN r.round % 2 = 1 THEN 'gen' ELSE 'ver' END AS role, p.pair_idx, k, source_idx
FROM (SELECT unnest(range(1, {2 * _PAIRS} + 1)) AS round) r JOIN placed p ON p.pair_idx = (r.round - 1) // 2""", _ROUND_CTES))
def pair_tasks(spark, d):
    rounds = sampling.round_schedule(spark, _PAIRS, _BATCH, start=_START)
    return sampling.pair_tasks(rounds, _batches(spark, d)).select("round", "role", "pair_idx", "k", "source_idx")


@query("eval_sample", _sql("""
SELECT round, 'test_' || source_idx AS uid, question, ground_truth FROM (
  SELECT *, row_number() OVER (PARTITION BY round ORDER BY md5((11 + round) || ':' || source_idx), source_idx) AS rn
  FROM tasks, (SELECT unnest([2, 4, 6]::BIGINT[]) AS round) r) s
WHERE rn <= 64 AND question <> ''"""))
def eval_sample(spark, d):
    data = dataset(spark, d)
    parts = [
        _tasks(sampling.sample_random(data, 64, seed=seed), "test").withColumn("round", F.lit(r).cast("bigint"))
        for r, seed in sampling.eval_rounds(spark, rounds=3, every=2, seed=11)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("round", "uid", "question", "ground_truth")


@query("request_batches", """
SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 64 AS batch FROM documents""")
def request_batches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return batching.request_batches(docs, ["lang"], ["doc_id"], 64)


@query("param_batches", """
SELECT doc_id, temperature, max_tokens,
       (row_number() OVER (PARTITION BY temperature, max_tokens ORDER BY doc_id) - 1) // 32 AS batch
FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 0.6 ELSE 0.3 END::DOUBLE AS temperature,
             CASE WHEN n_chars > 2000 THEN 8192 ELSE 2048 END::BIGINT AS max_tokens FROM documents) p""")
def param_batches(spark, d):
    params = F.struct(
        F.when(c("lang") == "en", F.lit(0.6)).otherwise(F.lit(0.3)).alias("temperature"),
        F.lit(0.95).alias("top_p"), F.lit(20).alias("top_k"), F.lit(0.0).alias("min_p"),
        F.when(c("n_chars") > 2000, F.lit(8192)).otherwise(F.lit(2048)).cast("bigint").alias("max_tokens"),
        F.array().cast("array<string>").alias("stop"),
        # left open, spelled out or zero: all the same penalty
        F.when(c("doc_id") % 3 == 0, F.lit(1.0)).when(c("doc_id") % 3 == 1, F.lit(0.0)).alias("repetition_penalty"),
    )
    docs = table(spark, d, "documents").select("doc_id", params.alias("params"))
    return batching.param_batches(docs, "params", ["doc_id"], 32).select(
        "doc_id", "params.temperature", "params.max_tokens", "batch"
    )


@query("round_robin_slot", "SELECT doc_id, doc_id % 8 AS slot FROM documents")
def round_robin_slot(spark, d):
    return table(spark, d, "documents").select("doc_id", round_robin(c("doc_id"), 8).alias("slot"))
