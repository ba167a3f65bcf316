"""Prompts fitted by a tokenizer, against a loop that tries one cut after the other."""

import random

from conftest import DATA
from pyspark.sql import functions as F

from colloquy.functions import tokenizers as tk
from colloquy.operators import rollout
from colloquy.plans import recorded_queries as R
from colloquy.plans.catalog import QUERIES


def coder():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=R.TOKENIZER)
    return (lambda texts: model.encode(texts)), model.decode


def by_loop(messages, budget):
    encode, decode = coder()
    fits = lambda m: len(encode([tk.plain_template(m)])[0]) <= budget
    if not messages or fits(messages):
        return messages
    head = messages[:1] if messages[0]["role"] == "system" else []
    body = messages[len(head) :]
    for start in range(len(body)):
        if fits(head + body[start:]):
            return head + body[start:]
    if not body:
        return head
    last = body[-1]
    if not last["content"]:
        return head + [last]
    ids = encode([last["content"]])[0]
    for n in range(len(ids), 0, -1):
        trial = head + [last | {"content": decode(ids[-n:])}]
        if fits(trial):
            return trial
    return head + [last | {"content": ""}]


def test_fitted_equals_the_loop():
    draw = random.Random(3)
    prompts = [None, [], [{"role": "system", "content": "s " * 300}], [{"role": "user", "content": None}], [{"role": "user", "content": ""}]]
    for _ in range(60):
        size = draw.randrange(1, 9)
        prompts.append([{"role": "system" if i == 0 and size % 2 else draw.choice(["user", "assistant"]), "content": "wörd, and 1\n" * draw.randrange(30)} for i in range(size)])
    for budget in (1, 40, 150):
        assert tk.fitted(prompts, budget, coder(), tk.plain_template) == [by_loop(p, budget) if p else p for p in prompts]


def test_query(spark):
    import hashlib

    got = {(r["uid"], r["role"], r["turn_index"]): r for r in QUERIES["fit_prompt_tokenizer"](spark, f"{DATA}/sf0.001").collect()}
    steps = R.recorded_steps(spark, f"{DATA}/sf0.001").select("uid", "role", "turn_index", "teacher_prompt").collect()
    assert len(got) == len(steps) > 0
    cut = 0
    for r in steps:
        prompt = [m.asDict() for m in r["teacher_prompt"]]
        want = by_loop(prompt, 300)
        cut += want != prompt
        shown = "\n".join(f"{m['role']}|{m['content']}" for m in want)
        mine = got[r["uid"], r["role"], r["turn_index"]]
        assert (mine["n_messages"], mine["prompt_sha1"]) == (len(want), hashlib.sha1(shown.encode()).hexdigest())
    assert cut > 0


def test_rollout_shows_fitted_prompts_only(spark):
    load = tk.sentencepiece_coder(spark, R.TOKENIZER)
    tasks = spark.createDataFrame([(f"t{i}", "why " * (40 * i), "1") for i in range(6)], "uid string, question string, ground_truth string")

    render = tk.plain_template

    def answer(prompts, uids):
        encode, _ = load()
        return [f"{n} tokens \\boxed{{1}}" for n in map(len, encode([render(p) for p in prompts]))]

    state = rollout.run_rollout(tasks, rollout.model_responder(answer, 4), max_turns=2, fit=tk.prompt_fitter(load, 120))
    said = [int(r["student_response_raw"].split()[0]) for r in rollout.steps_of(state).collect()]
    assert len(said) == 24 and max(said) <= 120
    counted = tasks.select(tk.token_counter(load)(F.col("question")).alias("n")).collect()
    assert [r["n"] for r in counted][1] >= 40
