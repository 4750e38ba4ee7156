"""Model-backed steps behind an interface: a provider is a function from a prompt to JSON text, injected by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = (
    "story_cards array<struct<title:string,period:string,year:int,year_end:int,approximate:boolean,setup:string,conflict:string,choice:string,consequence:string,reflection:string,"
    "people:array<string>,places:array<string>,quotes:array<struct<text:string,source_utterance_id:string>>,source_utterance_ids:array<string>,strength:int,sensitivity:string,followup_question:string>>, "
    "people array<struct<name:string,relationship:string,source_utterance_ids:array<string>>>, places array<struct<name:string,region:string,source_utterance_ids:array<string>>>, "
    "claims array<struct<text:string,kind:string,importance:int,source_utterance_ids:array<string>>>, notes string"
)


def passage(utterances: DataFrame, by: tuple = ("case_id", "window")) -> DataFrame:
    """(by, prompt): `[id] speaker: text` lines of each window, in order."""
    line = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("speaker"), F.lit(": "), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("session_id", "seq", line.alias("line"))))
    return utterances.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("prompt"))


def complete(prompts: DataFrame, provider: Callable[[str], str], by: tuple = ("case_id", "window"), tries: int = 2) -> DataFrame:
    """(by, result, error): the provider's JSON for each prompt; an answer that isn't JSON is asked for once more."""
    import json

    types = ", ".join(f"{c} {prompts.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = x[list(by)].copy()
            results, errors = [], []
            for prompt in x["prompt"]:
                result = error = None
                for _ in range(tries):
                    try:
                        result = provider(prompt)
                        json.loads(result)
                        error = None
                        break
                    except ValueError as e:
                        result, error = None, str(e)[:200]
                results.append(result)
                errors.append(error)
            out["result"], out["error"] = results, errors
            yield out

    return prompts.select(*by, "prompt").mapInPandas(run, f"{types}, result string, error string")


def parsed(results: DataFrame) -> DataFrame:
    """Results as typed records; text that doesn't fit the schema is an error."""
    return results.where("result is not null").withColumn("r", F.from_json("result", RESULT, {"mode": "FAILFAST"}))


def recorded(responses: dict[str, str]) -> Callable[[str], str]:
    """A provider that answers from recorded responses, by the first key that a prompt contains."""

    def answer(prompt: str) -> str:
        for key, text in responses.items():
            if key in prompt:
                return text
        raise ValueError("no recorded response")

    return answer
