"""Language models as adapters: one call per text in the executors, in batches; no answer where a call fails."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.config import Config


class Model(Protocol):
    name: str

    def open(self) -> object: ...

    def answer(self, client: object, texts: list[str]) -> list[str | None]: ...


@dataclass(frozen=True)
class CallableModel:
    """A model from a function of a text; for tests, and for clients that need no state."""

    function: object
    name: str = "model"

    def open(self) -> object:
        return None

    def answer(self, client: object, texts: list[str]) -> list[str | None]:
        return [self.function(t) for t in texts]


def summary_prompt(text: str, bullets: int = 5) -> str:
    return f"Summarise the article in {bullets} factual bullet points in its own language. Keep names, dates and amounts. Answer with the points only.\n\n{text}"


def translation_prompt(text: str, polite: bool = True) -> str:
    return f"Translate the text into Japanese in the {'polite' if polite else 'plain'} style. Keep list marks, names, dates and amounts. Answer with the translation only.\n\n{text}"


@dataclass(frozen=True)
class ChatModel:
    """A model behind an HTTP endpoint of the common chat form: {model, messages} in, choices[0].message.content out. `prompt` makes the
    message of a text; texts that are whole messages need none."""

    url: str
    name: str = "model"
    key: str = ""
    prompt: Callable[[str], str] | None = None
    timeout: float = 60

    def open(self) -> object:
        return None

    def answer(self, client: object, texts: list[str]) -> list[str | None]:
        return [self._one(self.prompt(t) if self.prompt else t) for t in texts]

    def _one(self, message: str) -> str | None:
        body = json.dumps({"model": self.name, "messages": [{"role": "user", "content": message}]}).encode()
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]


def from_config(config: Config, prompt: Callable[[str], str] | None = None) -> ChatModel | None:
    """The configured model, None where no endpoint is set."""
    return ChatModel(config.model_url, config.model_name or "model", config.model_key, prompt) if config.model_url else None


def answered(df: DataFrame, id_col: str, text_col: str, model: Model, batch: int) -> DataFrame:
    """(id, answer); the answer is null where the call failed. Blank texts aren't asked."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model.open()
        for frame in frames:
            texts, out = frame[text_col].tolist(), []
            for k in range(0, len(texts), max(1, batch)):
                part = texts[k : k + max(1, batch)]
                try:
                    out += model.answer(client, part)
                except Exception:  # noqa: BLE001 - one text at a time, so that one failure costs one text
                    for t in part:
                        try:
                            out += model.answer(client, [t])
                        except Exception:  # noqa: BLE001
                            out.append(None)
            yield pd.DataFrame({id_col: frame[id_col], "answer": pd.Series(out, index=frame.index, dtype=object)})

    return df.filter(f"length({text_col}) > 0").select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, answer string")
