"""Streaming queries: run to the end of what is there, result read as a table."""

from pyspark.sql import functions as F

from colloquy.plans.episode_queries import _ACCURACY, _accuracy_records
from colloquy.plans.registry import query
from colloquy.plans.views import v_sft, v_steps, with_views
from colloquy.session import new_folder
from colloquy.sources import store
from colloquy.streaming.ingest import ingest_shards, read_accuracy, read_ingested, running_accuracy

c = F.col


@query("stream_sft_ingest", with_views("v_sft", "SELECT DISTINCT msg AS messages, sha1(msg) AS msg_hash FROM v_sft"))
def stream_sft_ingest(spark, d):
    """Two deliveries of shards, taken in by two runs of the same stream."""
    base = new_folder(spark, "ingest")
    schema = "messages string, seq bigint"
    rows = v_sft(spark, d).select(c("msg").alias("messages"), "seq", "round")
    for late, delivery in ((False, "r001"), (True, "r002")):
        rows.filter(c("round") > 0 if late else c("round") == 0).drop("round").write.parquet(
            f"{base}/shards/{delivery}"
        )
        ingest_shards(spark, f"{base}/shards", schema, f"{base}/store", "seq", f"{base}/progress")
    return read_ingested(spark, f"{base}/store").select("messages", "msg_hash")


_LAST = "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn_index DESC) = 1"
_PARTS = {
    "train": {**_ACCURACY, "final": f"SELECT * FROM v_steps WHERE turn_index = 0 {_LAST}"},
    "later": {**_ACCURACY, "final": f"SELECT * FROM v_steps WHERE turn_index > 0 {_LAST}"},
    "eval": _ACCURACY,
}
_STREAMED = {
    f"{part}_{name}": sql.replace("FROM final", f"FROM {part}_final").replace("FROM said", f"FROM {part}_said")
    for part, ctes in _PARTS.items()
    for name, sql in ctes.items()
}


def _counted(part: str, tag: str, round_idx: int) -> str:
    return (
        f"SELECT '{tag}' AS tag, {round_idx}::BIGINT AS round, count(*) FILTER (WHERE is_correct) AS correct, count(*) AS total, "
        f"count(*) FILTER (WHERE is_correct) / count(*) AS accuracy FROM {part}_records HAVING count(*) > 0"
    )


@query("stream_accuracy", with_views(["v_steps", "v_tasks"], " UNION ALL ".join(
    [_counted("train", "train", 1), _counted("later", "train", 2), _counted("eval", "eval", 2)]), _STREAMED))
def stream_accuracy(spark, d):
    base = new_folder(spark, "running")
    steps = v_steps(spark, d)
    deliveries = [
        ("train", 1, steps.filter("turn_index = 0")),
        ("train", 2, steps.filter("turn_index > 0")),
        ("eval", 2, steps),
    ]
    for tag, round_idx, part in deliveries:
        store.write_accuracy_records(_accuracy_records(spark, d, part), f"{base}/records", tag, round_idx)
    running_accuracy(spark, f"{base}/records", f"{base}/table", f"{base}/progress")
    # a round that is written again, in other files, counts once
    store.write_accuracy_records(_accuracy_records(spark, d, steps).repartition(3), f"{base}/records", "eval", 2)
    running_accuracy(spark, f"{base}/records", f"{base}/table", f"{base}/progress")
    return read_accuracy(spark, f"{base}/table")
