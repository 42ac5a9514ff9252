"""Hooks for what lies outside the engine: lookups in batches, and models that answer prompts.

Both run inside mapInPandas with the caller's function, so a partition opens its own session or model.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def bisected(ids: list[str], fetch: Callable[[list[str]], dict[str, str]], retries: int = 2, wait: float = 0.0) -> dict[str, tuple[str | None, str | None]]:
    """(answer, error) of each id. A batch that fails, after retries, is cut in two, down to the ids that fail by themselves."""
    problem = None
    for attempt in range(retries + 1):
        try:
            found = fetch(ids)
            return {i: (found.get(i), None) for i in ids}
        except Exception as e:  # noqa: BLE001 - whatever the caller's function raises
            problem = e
            if attempt < retries:
                time.sleep(wait * 2**attempt)
    if len(ids) == 1:
        return {ids[0]: (None, str(problem))}
    half = len(ids) // 2
    return bisected(ids[:half], fetch, 0, wait) | bisected(ids[half:], fetch, 0, wait)


def fetched(ids: DataFrame, column: str, open_session: Callable[[], Callable[[list[str]], dict[str, str]]], batch: int = 50, retries: int = 2, wait: float = 0.0) -> DataFrame:
    """id, answer, error of each distinct id. open_session is called once in a partition and gives fetch(ids) -> {id: answer}."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = open_session()
        for part in parts:
            names = part["id"].tolist()
            for a in range(0, len(names), batch):
                found = bisected(names[a : a + batch], fetch, retries, wait)
                yield pd.DataFrame([(i, *x) for i, x in found.items()], columns=["id", "answer", "error"])

    distinct = ids.select(ids[column].cast("string").alias("id")).filter("id is not null").distinct()
    return distinct.mapInPandas(run, "id string, answer string, error string")


def generated(prompts: DataFrame, open_model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """id and output of each prompt (id, prompt). open_model is called once in a partition and gives generate(prompt) -> text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = open_model()
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "output": [generate(p) for p in part["prompt"]]})

    return prompts.selectExpr("cast(id as string) as id", "prompt").mapInPandas(run, "id string, output string")
