"""Model services behind one interface; recorded replies are the default.

A live service implements ``generate`` for a batch of prompts. It is called from
``mapInPandas``, a batch of rows at a time, so calls can be pipelined inside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLIES = "content string, model string, provider string, input_tokens int, output_tokens int, total_tokens int"


class ModelClient(Protocol):
    """``generate`` answers each prompt with a dict of the fields of ``REPLIES``, or None if it failed."""

    name: str

    def generate(self, system_prompts: list[str], user_prompts: list[str], max_tokens: int) -> list[dict | None]: ...


def ask(prompts: DataFrame, client: ModelClient, keys: list[str], max_tokens: int = 4096) -> DataFrame:
    """``keys`` and the reply's fields for each row of ``system_prompt`` and ``user_prompt``; null fields where the call failed."""
    names = [c.split()[0] for c in REPLIES.split(", ")]
    own = prompts.select(*keys, "system_prompt", "user_prompt")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in keys) + ", " + REPLIES

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = client.generate(frame["system_prompt"].tolist(), frame["user_prompt"].tolist(), max_tokens)
            reply = pd.DataFrame([{k: (r or {}).get(k) for k in names} for r in got], columns=names, index=frame.index)
            yield pd.concat([frame[keys], reply], axis=1)

    return own.mapInPandas(run, schema)


def recorded(prompts: DataFrame, replies: DataFrame, on: list[str]) -> DataFrame:
    """Recorded replies joined to the prompts they answer; null fields without one."""
    names = [c.split()[0] for c in REPLIES.split(", ")]
    have = [F.col(n) if n in replies.columns else F.lit(None).alias(n) for n in names]
    return prompts.join(replies.select(*on, *have), on, "left")
