"""Settings from the environment, read when asked for."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Defaults of the models that an evaluation may call."""

    embeddings_model: str = "sentence-transformers/all-mpnet-base-v2"
    backend: str = "openai"
    model: str = "gpt-4o-mini"
    max_output_tokens: int = 512
    temperature: float = 0.2
    api_key: str | None = None

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        return cls(
            env.get("EMBEDDINGS_MODEL_NAME", cls.embeddings_model),
            env.get("TAGGING_BACKEND", cls.backend),
            env.get("TAGGING_MODEL_NAME", cls.model),
            int(env.get("TAGGING_MAX_OUTPUT_TOKENS", cls.max_output_tokens)),
            float(env.get("TAGGING_TEMPERATURE", cls.temperature)),
            env.get("OPENAI_API_KEY"),
        )
