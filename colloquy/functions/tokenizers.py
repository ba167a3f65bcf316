"""Prompt budgets counted by a real tokenizer, whose counts of messages don't add up.

A prompt is rendered as the model will see it and its tokens are counted. What is over the budget loses its
oldest messages after the system head; if not even the last message fits, it keeps its longest tail of tokens that
does. Counts shrink as messages go, so both are binary searches, and each step of them tokenizes the trials of all
rows of a batch at once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from colloquy.schema import MESSAGES_DDL

#: texts -> ids, and ids -> text
Coder = tuple[Callable[[list[str]], list[list[int]]], Callable[[list[int]], str]]


def sentencepiece_coder(spark: SparkSession, path: str) -> Callable[[], Coder]:
    """What tasks call to get the tokenizer of a model file; it travels to them as a broadcast (files of a few MB)."""
    uri = path if "://" in path else f"file://{path}"
    shared = spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(uri).select("content").first()["content"]))

    held: list[Coder] = []  # one a task

    def load() -> Coder:
        if not held:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
            held.append(((lambda texts: model.encode(texts, num_threads=1)), model.decode))
        return held[0]

    return load


def plain_template(messages: list[dict]) -> str:
    """A chat template: each message under its role, and the start of the answer."""
    return "".join(f"<|{m['role']}|>\n{m['content'] or ''}\n" for m in messages) + "<|assistant|>\n"


def token_counter(load: Callable[[], Coder]) -> Callable[[Column], Column]:
    """The number of tokens of a text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, _ = load()
        for texts in batches:
            yield pa.array(list(map(len, encode([t or "" for t in texts.to_pylist()]))), pa.int64())

    return F.arrow_udf(run, "long")


def prompt_fitter(load: Callable[[], Coder], budget: int, render: Callable[[list[dict]], str] = plain_template) -> Callable[[Column], Column]:
    """A function of a column of messages that cuts them to ``budget`` tokens; no budget leaves them alone."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for prompts in batches:
            yield pa.array(fitted(prompts.to_pylist(), budget, load(), render), prompts.type)

    cut = F.arrow_udf(run, MESSAGES_DDL)
    return lambda prompt: cut(prompt) if budget > 0 else prompt


def fitted(prompts: list[list[dict] | None], budget: int, coder: Coder, render: Callable[[list[dict]], str]) -> list[list[dict] | None]:
    """Every prompt cut to the budget."""
    encode, decode = coder

    def fits(trials: list[list[dict]]) -> list[bool]:
        return [len(ids) <= budget for ids in encode([render(t) for t in trials])]

    out = list(prompts)
    full = [i for i, p in enumerate(prompts) if p]
    over = [i for i, ok in zip(full, fits([prompts[i] for i in full])) if not ok]
    heads = {i: prompts[i][:1] if prompts[i][0]["role"] == "system" else [] for i in over}
    bodies = {i: prompts[i][len(heads[i]) :] for i in over}
    for i in over:
        out[i] = heads[i] + bodies[i][-1:]
    over = [i for i in over if bodies[i]]
    last = dict(zip(over, fits([out[i] for i in over])))

    whole = {i: len(bodies[i]) for i in over if last[i]}
    found = _most(whole, lambda i, n: heads[i] + bodies[i][len(bodies[i]) - n :], fits)

    # not even the last message fits: its most tokens from the end
    long = [i for i in over if not last[i] and bodies[i][-1]["content"]]
    ids = dict(zip(long, encode([bodies[i][-1]["content"] for i in long])))

    def shortened(i: int, n: int) -> list[dict]:
        return heads[i] + [bodies[i][-1] | {"content": decode(ids[i][len(ids[i]) - n :]) if n else ""}]

    found |= _most({i: len(ids[i]) for i in long}, shortened, fits)
    for i, prompt in found.items():
        out[i] = prompt
    return out


def _most(largest: dict[int, int], made: Callable[[int, int], list[dict]], fits: Callable[[list[list[dict]]], list[bool]]) -> dict[int, list[dict]]:
    """For each row, what is made of the largest n that fits, from 0 to its ``largest``; all rows search at once."""
    low, high = dict.fromkeys(largest, 0), dict(largest)
    while open_ := [i for i in largest if low[i] < high[i]]:
        middle = {i: (low[i] + high[i] + 1) // 2 for i in open_}
        for i, ok in zip(open_, fits([made(i, middle[i]) for i in open_])):
            if ok:
                low[i] = middle[i]
            else:
                high[i] = middle[i] - 1
    return {i: made(i, n) for i, n in low.items()}


# Task code travels with its job, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
