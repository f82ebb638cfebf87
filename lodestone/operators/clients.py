"""Models behind the plugs of the engine: a chat service, a transformer's vectors, similarity of answers.

All are optional: nothing here is imported or called unless asked for."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import clamp, cosine


#: Answers of a service after which asking again may help.
PASSING = frozenset({408, 409, 425, 429, 500, 502, 503, 504})


class ChatClient:
    """A generator that asks a chat service of the usual HTTP form (POST <base_url>/chat/completions).

    Up to `at_once` requests of a batch are on their way together (a cluster sends that many for each running task).  One that fails
    in a way that may pass is sent again, up to `tries` times, each time after twice the pause."""

    def __init__(self, base_url: str, model: str, api_key: str = "", timeout: float = 120.0, send: Callable[[urllib.request.Request, float], bytes] | None = None, at_once: int = 4, tries: int = 4, pause: float = 1.0):
        if at_once < 1 or tries < 1:
            raise ValueError("at_once and tries must be positive")
        self.base_url, self.model, self.api_key, self.timeout = base_url.rstrip("/"), model, api_key, timeout
        self.send, self.at_once, self.tries, self.pause = send, at_once, tries, pause

    def request(self, system: str, message: str, temperature: float) -> urllib.request.Request:
        told = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": message}]
        body = json.dumps({"model": self.model, "temperature": temperature, "messages": told}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        return urllib.request.Request(f"{self.base_url}/chat/completions", body, headers)

    def answered(self, asked: urllib.request.Request) -> str:
        for n in range(self.tries):
            try:
                if self.send is not None:
                    raw = self.send(asked, self.timeout)
                else:
                    with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                        raw = answer.read()
                return json.loads(raw)["choices"][0]["message"].get("content") or ""
            except OSError as error:  # HTTPError and URLError are such
                if n + 1 == self.tries or getattr(error, "code", 503) not in PASSING:
                    raise
                time.sleep(self.pause * 2**n)
        raise AssertionError("unreachable")

    def __call__(self, messages: list[str], questions: list[str], temperature: float = 0.0, system: str = "") -> list[str]:
        asked = [self.request(system, message, temperature) for message in messages]
        if len(asked) < 2 or self.at_once == 1:
            return list(map(self.answered, asked))
        with ThreadPoolExecutor(min(self.at_once, len(asked))) as pool:
            return list(pool.map(self.answered, asked))


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors of texts: the means of their tokens' states (texts, tokens, size) where the mask is set."""
    weight = mask[..., None].astype(np.float64)
    pooled = (states * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)


class TransformerEmbedder:
    """Vectors by a transformer, loaded once for each worker: `load` gives its tokenizer (texts to a dict with
    an attention_mask) and its model (that dict to states)."""

    def __init__(self, name: str, max_length: int = 512, load: Callable[[str], tuple[Callable, Callable]] | None = None):
        self.name, self.max_length, self.load = name, max_length, load

    def __call__(self, texts: list[str]) -> list[list[float]]:
        tokenizer, model = _loaded(self.name, self.max_length, self.load or _transformer)
        fed = tokenizer(texts)
        return mean_pooled(np.asarray(model(fed)), np.asarray(fed["attention_mask"])).tolist()


@lru_cache(maxsize=2)
def _loaded(name: str, max_length: int, load: Callable) -> tuple[Callable, Callable]:
    return load(name, max_length) if load is _transformer else load(name)


def _transformer(name: str, max_length: int) -> tuple[Callable, Callable]:
    try:
        import torch
        from transformers import AutoModel, AutoTokenizer
    except ImportError as missing:
        raise RuntimeError("transformer vectors need the packages torch and transformers") from missing
    tokenizer, model = AutoTokenizer.from_pretrained(name), AutoModel.from_pretrained(name).eval()

    def run(fed: dict) -> np.ndarray:
        with torch.no_grad():
            return model(**fed).last_hidden_state.numpy()

    return lambda texts: tokenizer(texts, padding=True, truncation=True, max_length=max_length, return_tensors="pt"), run


def semantic_by(embedder: Callable[[list[str]], list[list[float]]]) -> Callable[[Column, Column], Column]:
    """Similarity of two answers within [0, 1]: the cosine of their vectors by an embedder, batch by batch."""
    call = getattr(embedder, "embed_texts", embedder)

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in call(texts.fillna("").tolist())], dtype=object)

    return lambda a, b: clamp(cosine(vector(a), vector(b)))
