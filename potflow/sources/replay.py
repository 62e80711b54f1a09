"""Responses to prompts: recorded ones by the prompt's hash, or from a client called in the tasks."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt_hash(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt, 256), 1, 16)


def replayed(prompts: DataFrame, recorded: DataFrame) -> DataFrame:
    """prompts(recipe_id, prompt_hash), recorded(prompt_hash, raw, and if known received_at and attempt) ->
    (recipe_id, prompt_hash, raw).

    raw is null where nothing is recorded. Of several recordings of a prompt the latest counts, by received_at, then
    attempt, then text, so that a prompt gives one row. Equal prompts share a recording.
    """
    latest = F.max_by("raw", F.struct(*(c for c in ("received_at", "attempt") if c in recorded.columns), "raw"))
    one = recorded.where("raw IS NOT NULL").groupBy("prompt_hash").agg(latest.alias("raw"))
    return prompts.join(one, "prompt_hash", "left").select("recipe_id", "prompt_hash", "raw")


def with_retries(call: Callable[[str], str], prompt: str, retries: int = 3, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """What the client answers, None if it fails ``retries`` times; the k-th pause lasts k times the delay."""
    for attempt in range(1, retries + 1):
        try:
            return call(prompt)
        except Exception:  # noqa: BLE001 - whatever a client raises counts as a failed call
            if attempt < retries:
                sleep(delay * attempt)
    return None


def chat_client(endpoint: str, model: str, key_variable: str, timeout: float = 120.0) -> Callable[[str], Callable[[str], str]]:
    """A client for ``asked``: chat completions over HTTP at temperature 0 with a system and a user message. The key is read
    from an environment variable here, on the driver; it is an error if that is empty."""
    key = os.environ.get(key_variable)
    if not key:
        raise ValueError(f"set the environment variable {key_variable}")

    def client(system: str) -> Callable[[str], str]:
        def call(prompt: str) -> str:
            messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
            body = json.dumps({"model": model, "temperature": 0.0, "messages": messages}).encode()
            request = urllib.request.Request(endpoint, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return json.load(response)["choices"][0]["message"]["content"]

        return call

    return client


def asked(prompts: DataFrame, client: Callable[..., Callable[[str], str]], retries: int = 3, delay: float = 2.0, pause: float = 0.5, at_once: int = 8, system: str | None = None) -> DataFrame:
    """prompts(recipe_id, prompt) -> (recipe_id, prompt, raw). client() or, with a system prompt, client(system) makes one
    client per task. ``at_once`` tasks at most call at one time, each after ``at_once`` pauses, the k-th task k pauses later
    than the first: over all tasks there are ``pause`` seconds between two calls on average, and at least that many after
    each call of a task. A prompt that is null isn't asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, wait = client() if system is None else client(system), TaskContext.get().partitionId() % at_once * pause
        for batch in batches:
            raw = []
            for prompt in batch["prompt"]:
                if prompt is None:
                    raw.append(None)
                    continue
                time.sleep(wait)
                wait = at_once * pause
                raw.append(with_retries(call, prompt, retries, delay))
            yield batch.assign(raw=raw)[["recipe_id", "prompt", "raw"]]

    return prompts.select("recipe_id", "prompt").coalesce(at_once).mapInPandas(run, "recipe_id string, prompt string, raw string")
