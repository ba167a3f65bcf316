"""Queries over sources and stores: written to the shared work folder and read back."""

from pyspark.sql import functions as F

from colloquy.functions.hashing import text_hash
from colloquy.functions.text import to_record_json
from colloquy.operators import dedupe
from colloquy.plans import sqltext as Q
from colloquy.plans.registry import query
from colloquy.plans.views import as_json, table, v_rows, v_sft, with_views
from colloquy.session import new_folder
from colloquy.sources import datasets, json_list, store

c = F.col
CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


@query("scan_parquet", "SELECT doc_id, source, n_chars FROM documents")
def scan_parquet(spark, d):
    return datasets.scan(spark, f"{d}/documents.parquet").select("doc_id", "source", "n_chars")


@query("scan_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def scan_jsonl(spark, d):
    path = f"{new_folder(spark, 'scan')}.jsonl"
    store.dump_json(table(spark, d, "conversations"), path)
    return datasets.scan(spark, path, CONVERSATION).select("conv_id", "turn", "role", "text")


@query("scan_jsonl_tolerant", "SELECT conv_id, turn, role, text FROM conversations")
def scan_jsonl_tolerant(spark, d):
    """Every line is followed by a blank one and by a copy that breaks off."""
    path = new_folder(spark, "tolerant")
    line = to_record_json(F.struct("conv_id", "turn", "role", "text"))
    lines = table(spark, d, "conversations").select(line.alias("line"))
    broken = F.left(c("line"), F.length("line") - 2)
    lines.select(F.explode(F.array(c("line"), F.lit("  "), broken)).alias("value")).write.text(path)
    return datasets.scan_jsonl_tolerant(spark, path, CONVERSATION)


@query("scan_json_list", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_json_list(spark, d):
    """Documents written as JSON lists, one a task, and read by blocks."""
    path = f"{new_folder(spark, 'lists')}.json"
    json_list.dump_lists(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return datasets.scan(spark, path, schema)


@query("count_json_list", "SELECT count(*) AS n FROM documents")
def count_json_list(spark, d):
    path = f"{new_folder(spark, 'lists')}.json"
    json_list.dump_lists(table(spark, d, "documents").select("doc_id", "source"), path)
    return spark.createDataFrame([(store.count_rows(spark, path),)], "n bigint")


@query("scan_shards", "SELECT conv_id, turn, role, text FROM conversations")
def scan_shards(spark, d):
    path = new_folder(spark, "shards")
    rows = table(spark, d, "conversations").withColumn("part", c("role"))
    rows.write.partitionBy("part").parquet(f"{path}/deep")
    return datasets.scan_shards(spark, path).select("conv_id", "turn", "role", "text")


@query("register_dataset", with_views("v_rows", f"""
SELECT idx, problem, answer, CASE WHEN {Q.strip('problem')} <> '' THEN problem END AS question,
  coalesce(nullif(ground_truth, ''), nullif(answer, ''), nullif(solution, ''), nullif(label, '')) AS ground_truth,
  'rows' AS data_source FROM v_rows"""))
def register_dataset(spark, d):
    root = new_folder(spark, "registry")
    raw = f"{root}/raw.parquet"
    v_rows(spark, d).write.parquet(raw)
    first = datasets.register(spark, root, "rows", "train[a:b]", raw)
    again = datasets.register(spark, root, "rows", "train[a:b]")  # already there: no path needed
    return again.select(*[x for x in first.columns if x not in ("solution", "label", "source_idx", "has_question")])


_UNEVEN = "idx % 10 = 0 OR idx > 300"


@query("register_in_file_order", with_views("v_rows", f"""
SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS source_idx, 'parquet' AS kind FROM v_rows WHERE {_UNEVEN}
UNION ALL SELECT idx, row_number() OVER (ORDER BY idx) - 1, 'lines' FROM v_rows WHERE {_UNEVEN}
UNION ALL SELECT idx, row_number() OVER (ORDER BY idx) - 1, 'list' FROM v_rows WHERE {_UNEVEN}"""))
def register_in_file_order(spark, d):
    """Files in the order of ``idx``, the first ones much smaller; their rows are numbered as they lie there."""
    root = new_folder(spark, "registry")
    rows = v_rows(spark, d).select("idx", "problem", "answer").repartitionByRange(5, "idx").sortWithinPartitions("idx").filter(_UNEVEN)
    rows.write.parquet(f"{root}/raw")
    store.dump_json(rows, f"{root}/raw.jsonl")
    json_list.dump_lists(rows, f"{root}/raw.json")
    schema = "idx bigint, problem string, answer string"
    found = [
        datasets.register(spark, root, kind, "train", f"{root}/{raw}", schema=schema).select("idx", "source_idx", F.lit(kind).alias("kind"))
        for kind, raw in (("parquet", "raw"), ("lines", "raw.jsonl"), ("list", "raw.json"))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


_SHAPES = {
    "messages": "array(struct('user' AS role, text AS content), struct('assistant' AS role, 'hi' AS content))",
    "strings": "array('first', text, ' ')",
    "object": "struct('system' AS from, text AS prompt)",
    "parts": "array(map('speaker', 'client', 'value', text), map('speaker', 'system', 'value', 'last'))",
}


@query("register_question_shapes", " UNION ALL ".join(
    f"SELECT conv_id, turn, text AS question, '{kind}' AS kind FROM conversations" for kind in _SHAPES))
def register_question_shapes(spark, d):
    """Datasets whose question is a list of messages, a list of strings, an object, or a list of maps."""
    root = new_folder(spark, "registry")
    found = []
    for kind, shape in _SHAPES.items():
        rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{shape} AS question")
        rows.write.parquet(f"{root}/{kind}")
        registered = datasets.register(spark, root, kind, "train", f"{root}/{kind}")
        found.append(registered.select("conv_id", "turn", "question", F.lit(kind).alias("kind")))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def _two_rounds(spark, d):
    """The training rows as two successive appends: the first turns, then all later ones."""
    rows = v_sft(spark, d).withColumnRenamed("msg", "messages")
    return rows.filter("round = 0"), rows.filter("round > 0")


@query("sft_append_parquet", with_views("v_sft", """
SELECT msg AS messages, max(seq) AS seq, max_by(round, seq) AS round, sha1(msg) AS msg_hash FROM v_sft GROUP BY msg"""))
def sft_append_parquet(spark, d):
    home = new_folder(spark, "append-parquet")
    for rows in _two_rounds(spark, d):
        store.append_distinct(rows, home, "seq")
    return store.read_store(spark, home).select("messages", "seq", "round", "msg_hash")


@query("sft_append_jsonl", with_views("v_sft", """
SELECT msg AS messages, min(seq) AS seq, max(seq) AS last_seq FROM v_sft GROUP BY msg"""))
def sft_append_jsonl(spark, d):
    home = new_folder(spark, "append-json")
    for rows in _two_rounds(spark, d):
        store.append_distinct(rows.withColumn("last_seq", c("seq")), home, "seq", file_format="json", position="first")
    schema = "messages string, seq bigint, last_seq bigint"
    return store.read_store(spark, home, "json", schema).select("messages", "seq", "last_seq")


@query("sft_new_only", with_views("v_sft", """
SELECT msg AS messages, max(seq) AS seq, 'batch=1' AS part FROM v_sft
WHERE round > 0 AND msg NOT IN (SELECT msg FROM v_sft WHERE round = 0) GROUP BY msg
UNION ALL SELECT msg, max(seq), 'batch=0' FROM v_sft WHERE round = 0 GROUP BY msg"""))
def sft_new_only(spark, d):
    home = new_folder(spark, "new-only")
    parts = []
    for i, rows in enumerate(_two_rounds(spark, d)):
        path = store.append_new_only(rows, home, "seq", f"batch={i}")
        parts.append(spark.read.parquet(path).withColumn("part", F.lit(f"batch={i}")))
    return dedupe.union_rows(parts[0], parts[1]).select("messages", "seq", "part")


_SHARDS = """SELECT '[{"role":"user","content":' || CAST(to_json(msg) AS VARCHAR) || '}]' AS messages, seq,
  CASE WHEN round = 0 THEN 1 ELSE 2 END AS round FROM v_sft"""


@query("sft_shards", with_views("v_sft", f"""
SELECT messages, seq, 'gen_sft' AS label, CAST(round AS BIGINT) AS round FROM ({_SHARDS}) s"""))
def sft_shards(spark, d):
    folder = new_folder(spark, "sft-shards")
    for i, rows in enumerate(_two_rounds(spark, d), start=1):
        store.write_shard(rows.drop("round"), folder, "gen_sft", i)
    shards = spark.read.parquet(folder)
    return shards.select(as_json(c("messages")).alias("messages"), "seq", "label", c("round").cast("bigint").alias("round"))


@query("sft_latest", with_views("v_sft", f"""
SELECT messages, seq, CAST(round AS BIGINT) AS round FROM ({_SHARDS}) s WHERE round = 2"""))
def sft_latest(spark, d):
    folder = new_folder(spark, "sft-latest")
    for i, rows in enumerate(_two_rounds(spark, d), start=1):
        store.write_latest(rows.drop("round"), folder, "gen_sft_latest", i)
    store.write_latest(rows.drop("round").limit(0), folder, "gen_sft_latest", 3)  # no rows: stays
    return store.read_store(spark, folder).select(
        as_json(c("messages")).alias("messages"), "seq", c("round").cast("bigint").alias("round")
    )


@query("jsonl_mirror", with_views("v_sft", "SELECT msg AS messages, seq FROM v_sft"))
def jsonl_mirror(spark, d):
    path = new_folder(spark, "mirror")
    for rows in _two_rounds(spark, d):
        store.append_json(rows.drop("round"), path)
    return spark.read.schema("messages string, seq bigint").json(path)


@query("distinct_messages", with_views("v_sft", """
SELECT sha1(msg) AS msg_hash, msg, max(seq) AS seq, count(*) AS copies FROM v_sft GROUP BY msg"""))
def distinct_messages(spark, d):
    hashed = v_sft(spark, d).select("msg", "seq", text_hash(c("msg")).alias("msg_hash"))
    return dedupe.distinct_by(hashed, "msg_hash", "seq")


@query("union_sft", with_views("v_sft", """
SELECT msg, seq, round, CAST(NULL AS VARCHAR) AS note FROM v_sft WHERE round = 0
UNION ALL SELECT msg, seq, NULL, 'new' FROM v_sft WHERE round > 0"""))
def union_sft(spark, d):
    rows = v_sft(spark, d)
    old = rows.filter("round = 0")
    new = rows.filter("round > 0").drop("round").withColumn("note", F.lit("new"))
    return dedupe.union_rows(old, new).select("msg", "seq", "round", "note")


@query("count_sft_rows", with_views("v_sft", """
SELECT kind, n FROM (SELECT count(*) AS n FROM v_sft) c, (SELECT unnest(['jsonl', 'messages', 'missing', 'parquet', 'shards']) AS kind) k
WHERE kind <> 'missing' UNION ALL SELECT 'missing', 0"""))
def count_sft_rows(spark, d):
    base = new_folder(spark, "counts")
    rows = v_sft(spark, d).withColumnRenamed("msg", "messages")
    rows.write.parquet(f"{base}/rows.parquet")
    written = spark.read.parquet(f"{base}/rows.parquet")
    written.withColumn("half", F.when(c("round") == 0, "a").otherwise("b")).write.partitionBy("half").parquet(
        f"{base}/shards"
    )
    lines = written.select(F.explode(F.array(to_record_json(F.struct("messages", "seq")), F.lit(" "))).alias("value"))
    lines.write.text(f"{base}/rows.jsonl")
    counts = [
        ("parquet", store.count_rows(spark, f"{base}/rows.parquet")),
        ("shards", store.count_rows(spark, f"{base}/shards")),
        ("jsonl", store.count_rows(spark, f"{base}/rows.jsonl")),
        ("messages", store.count_messages(spark, f"{base}/rows.parquet")),
        ("missing", store.count_rows(spark, f"{base}/none.parquet")),
    ]
    return spark.createDataFrame(counts, "kind string, n bigint")
