"""Batch inference behind a function boundary: the engine is injected, its errors become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import judge_score
from voxloom.session import cut_lineage

TRACE_SCHEMA = "index bigint, task string, output_text string, output_audio string, error string"


def run_engine(requests: DataFrame, load: Callable[[], Callable[[dict], dict]], seconds: float = 3600.0, at_once: int = 1) -> DataFrame:
    """Answers of an engine to ``(index, task, text, audio_path)`` rows.

    ``load`` builds the engine once in each Python worker; a request that fails, or takes longer than ``seconds``, gives a
    row with its error.  At most ``at_once`` requests of a worker are in flight.  The input order is kept by index.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = timed(load(), seconds, at_once)
        for batch in batches:
            asked = batch.to_dict("records")
            rows = [(r["index"], r["task"], made.get("text"), made.get("audio_path"), made.get("error")) for r, made in zip(asked, engine(asked))]
            yield pd.DataFrame(rows, columns=["index", "task", "output_text", "output_audio", "error"])

    return requests.select("index", "task", "text", "audio_path").mapInPandas(run, TRACE_SCHEMA)


def judge_with_retries(pending: DataFrame, judge: Callable[[DataFrame], DataFrame], attempts: int = 3) -> DataFrame:
    """Rows of ``pending (index, ...)`` judged up to ``attempts`` times; each round asks only for what still lacks a score.

    All rows come back with the columns that ``judge`` gives them and score; rows that never got one keep the answer of
    their last round under a null score, and rows the judge did not answer have nulls.
    """
    last, left, rounds = None, cut_lineage(pending), []
    for _ in range(attempts):
        last = cut_lineage(judge(left).withColumn("score", judge_score(F.col("judge_result"))))
        rounds.append(last.where("score is not null"))
        left = cut_lineage(left.join(rounds[-1].select("index"), "index", "left_anti"))
        if left.isEmpty():
            break
    silent = left.join(last.drop(*[c for c in left.columns if c != "index"]), "index", "left")
    out = silent
    for made in rounds:
        out = out.unionByName(made, allowMissingColumns=True)
    return out


def timed(engine: Callable[[dict], dict], seconds: float, at_once: int = 1) -> Callable[[list[dict]], list[dict]]:
    """Runs an engine over requests with at most ``at_once`` of them in flight; one that takes longer than ``seconds`` gives an
    error in its place.  Results keep the order of the requests."""

    def run(requests: list[dict]) -> list[dict]:
        pool = ThreadPoolExecutor(max_workers=at_once)
        futures = [pool.submit(engine, request) for request in requests]
        out = []
        for future in futures:
            try:
                out.append(future.result(timeout=seconds))
            except TimeoutError:
                future.cancel()
                out.append({"error": f"TimeoutError: no answer within {seconds} s"})
            except Exception as failed:  # noqa: BLE001 - every failure of a foreign engine is data
                out.append({"error": f"{type(failed).__name__}: {failed}"[:4096]})
        pool.shutdown(wait=False, cancel_futures=True)
        return out

    return run
