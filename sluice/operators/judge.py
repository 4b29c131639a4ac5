"""Batch scoring with a user-supplied judge or embedder.

The judged table is the checkpoint: a run scores only ids that are not in it yet, so a
lost executor or a failed call repeats a batch, never the whole job.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.hashing import audit_flag
from sluice.functions.text import truncate

JUDGE_CHARS = 2400
EMBED_CHARS = 4000
REASON_CHARS = 500

Judge = Callable[[str], dict[str, Any]]
Embedder = Callable[[list[str]], list[Sequence[float]]]

JUDGED = (
    "sample_id string, llm_prediction int, reason string, "
    "usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>, "
    "error string"
)


def backoff(attempt: int, first: float = 0.5, most: float = 30.0) -> float:
    """Seconds to wait after a failed attempt (from 0): doubling up to a limit, with jitter."""
    return min(most, first * 2**attempt) * random.uniform(0.5, 1.0)


def _one(
    judge: Judge, text: str, retries: int, wait: Callable[[int], float] = backoff, sleep: Callable[[float], None] = time.sleep
) -> dict[str, Any]:
    error = None
    for attempt in range(retries + 1):
        if attempt:
            sleep(wait(attempt - 1))
        try:
            answer = judge(text)
            verdict = int(answer["judgement"])
            if verdict not in (0, 1):
                raise ValueError(f"invalid judgement: {verdict}")
            used = answer.get("usage") or {}
            usage = {k: int(used.get(k, 0)) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}
            reason = str(answer.get("reason", ""))[:REASON_CHARS]
            return {"llm_prediction": verdict, "reason": reason, "usage": usage, "error": None}
        except Exception as exc:  # a failed row is data for the retry job, not the end of the run
            error = f"{type(exc).__name__}: {exc}"
    return {"llm_prediction": None, "reason": None, "usage": None, "error": error}


def judge_rows(
    df: DataFrame,
    judge: Judge,
    retries: int = 3,
    max_chars: int = JUDGE_CHARS,
    calls: int | None = None,
    wait: Callable[[int], float] = backoff,
) -> DataFrame:
    """Judge every row; ``calls`` partitions bound how many calls run at a time.

    ``wait`` gives the seconds before a further try.  Each action on the result pays the calls
    again; ``ledger.judged_records`` keeps what is paid.  Returns id, answer, reason, usage, and an error text for rows that kept failing.
    """
    texts = df.select(F.col("sample_id").cast("string").alias("sample_id"), truncate("prompt", max_chars).alias("prompt"))
    if calls:
        texts = texts.repartition(calls)

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([_one(judge, t, retries, wait) for t in pdf["prompt"]], index=pdf.index)
            out = out.reindex(columns=["llm_prediction", "reason", "usage", "error"])
            out["llm_prediction"] = out["llm_prediction"].astype("Int32")
            out.insert(0, "sample_id", pdf["sample_id"])
            yield out

    return texts.mapInPandas(run, JUDGED)


def run_cascade(
    df: DataFrame,
    judge: Judge,
    tau: float,
    audit_rate: float = 0.0,
    audit_seed: int = 0,
    retries: int = 3,
    max_chars: int = JUDGE_CHARS,
    calls: int | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """The deployed form: only rows above tau, and audited ones, reach the judge.

    With ``ledger``, a folder, answers are kept there and no action pays twice.  Returns id, score, route and prediction; bypassed rows predict 0.  (``judge_rows`` on all
    rows is the evaluation form, which can be scored at any tau afterwards.)
    """
    bypass = F.col("router_score") <= tau
    drawn = audit_flag(F.col("sample_id"), audit_rate, audit_seed)
    route = F.when(~bypass, "judge").when(drawn, "audit").otherwise("bypass")
    routed = df.withColumn("route", route)
    called = routed.filter("route <> 'bypass'")
    if ledger:
        from sluice.operators.ledger import judged_records

        answers = judged_records(called.select("sample_id", "prompt"), judge, ledger, retries=retries, max_chars=max_chars)
    else:
        answers = judge_rows(called, judge, retries, max_chars, calls)
    kept = routed.select("sample_id", "router_score", "route")
    joined = kept.join(answers.select("sample_id", "llm_prediction", "error"), "sample_id", "left")
    return joined.withColumn("prediction", F.when(F.col("route") == "bypass", 0).otherwise(F.col("llm_prediction")))


def embed_rows(
    df: DataFrame, embedder: Embedder, batch: int = 128, max_chars: int = EMBED_CHARS, calls: int | None = None
) -> DataFrame:
    """(id, embedding) for every row, ``batch`` texts per call."""
    texts = df.select(F.col("sample_id").cast("string").alias("sample_id"), truncate("prompt", max_chars).alias("prompt"))
    if calls:
        texts = texts.repartition(calls)

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                vectors = embedder(part["prompt"].tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                yield pd.DataFrame(
                    {"sample_id": part["sample_id"].to_numpy(), "embedding": [list(map(float, v)) for v in vectors]}
                )

    return texts.mapInPandas(run, "sample_id string, embedding array<float>")


def rule_judge(text: str) -> dict[str, Any]:
    """A deterministic stand-in judge for tests: positive when a question is asked."""
    words = len(text.split())
    return {
        "judgement": int("?" in text),
        "reason": "asks a question" if "?" in text else "no question",
        "usage": {"prompt_tokens": words, "completion_tokens": 1, "total_tokens": words + 1},
    }


def length_embedder(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in embedder for tests: character-class counts."""
    return [
        [float(len(t)), float(t.count(" ")), float(sum(c.isupper() for c in t)), float(sum(not c.isascii() for c in t))]
        for t in texts
    ]
