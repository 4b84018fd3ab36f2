"""Row-wise Python callables (clients of language models, embedders, whole systems) as column and DataFrame functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragscore.sources.settings import Settings

_REPLY = pa.struct([("reply", pa.string()), ("error", pa.string())])
OUTPUT_SCHEMA = "sample_id string, response string, retrieved array<struct<doc_id:string,text:string>>, timings map<string,double>, error string"


def asked(make: Callable[[], Callable[[str], str]], workers: int = 5, attempts: int = 3, wait: float = 1.0) -> Callable[[Column], Column]:
    """prompt -> struct of reply and error, by a client that each task makes once.

    So many calls of a batch run side by side; replies keep the order of their prompts. A call that fails is tried again
    after ``wait`` seconds, then twice that, and so on; after the last attempt reply is null and error says why. How long
    one call may take is the client's matter. A null prompt is not asked: both are null.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = make()

        def one(prompt: str | None) -> dict[str, str | None]:
            error = None
            for i in range(attempts if prompt is not None else 0):
                try:
                    return {"reply": ask(prompt), "error": None}
                except Exception as e:  # a lost reply must not lose the job
                    error = f"{type(e).__name__}: {e}"
                    if i + 1 < attempts:
                        time.sleep(wait * 2**i)
            return {"reply": None, "error": error}

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                yield pa.array(list(pool.map(one, batch.to_pylist())), _REPLY)

    return F.arrow_udf(run, "struct<reply:string,error:string>")


def language_model(make: Callable[[], Callable[[str], str]], workers: int = 5, attempts: int = 3, wait: float = 1.0) -> Callable[[Column], Column]:
    """prompt -> reply, null where no attempt gave one; scores that need it are left out and counted."""
    ask = asked(make, workers, attempts, wait)
    return lambda prompt: ask(prompt)["reply"]


def chat_client(settings: Settings, system: str = "You write questions for an evaluation set.", url: str = "https://api.openai.com/v1/chat/completions", temperature: float | None = None, timeout: float = 120) -> Callable[[], Callable[[str], str]]:
    """Makes a client of a chat-completions service: prompt -> reply, over plain HTTP."""

    def make() -> Callable[[str], str]:
        import json
        from urllib.request import Request, urlopen

        def ask(prompt: str) -> str:
            body = {
                "model": settings.model,
                "temperature": settings.temperature if temperature is None else temperature,
                "max_tokens": settings.max_output_tokens,
                "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}],
            }
            headers = {"Content-Type": "application/json", "Authorization": f"Bearer {settings.api_key}"}
            with urlopen(Request(url, json.dumps(body).encode(), headers), timeout=timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"] or ""

        return ask

    return make


def has_service(settings: Settings) -> bool:
    return settings.backend == "openai" and bool(settings.api_key)


def model_for(settings: Settings, mock: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The language model that the settings name, or the mock where they name no service or no key."""
    return language_model(chat_client(settings)) if has_service(settings) else mock


def critic_for(settings: Settings, mock: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Likewise a critic: temperature 0, replies with a number that judging.critic_score reads."""
    system = "You grade with care. Reply with a number between 0 and 1 and nothing else."
    return language_model(chat_client(settings, system, temperature=0.0)) if has_service(settings) else mock


def embedder(make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 1000) -> Callable[[Column], Column]:
    """text -> vector by a function of at most ``batch`` texts; nulls stay null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = make()
        for texts in batches:
            known = [t for t in texts.to_pylist() if t is not None]
            vectors = iter([v for s in range(0, len(known), batch) for v in embed(known[s : s + batch])])
            yield pa.array([None if t is None else next(vectors) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")


def row_system(make: Callable[[], Any]) -> Callable[[DataFrame, int], DataFrame]:
    """A system whose run(sample, top_k=...) answers one sample (a dict) with a dict of response and retrieved.

    Results are sample_id, response, retrieved, timings (end_to_end in seconds) and error, null where none came up.
    """

    def system(samples: DataFrame, top_k: int) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            target = make()
            for frame in frames:
                rows = []
                for sample in frame.to_dict("records"):
                    start, out, error = time.perf_counter(), {}, None
                    try:
                        out = target.run(sample, top_k=top_k)
                    except Exception as e:  # told in the row
                        error = f"{type(e).__name__}: {e}"
                    rows.append((sample["sample_id"], out.get("response"), list(out.get("retrieved") or []), {"end_to_end": time.perf_counter() - start}, error))
                yield pd.DataFrame(rows, columns=["sample_id", "response", "retrieved", "timings", "error"])

        return samples.select("sample_id", "query").mapInPandas(run, OUTPUT_SCHEMA)

    return system
