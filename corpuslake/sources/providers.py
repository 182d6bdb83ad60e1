"""Embedding and language models behind HTTP, called from the tasks, batch by batch.

A provider is a small object that is sent to the tasks. ``post(url, body, headers, timeout)`` is its
transport and can be replaced (in tests, or for another HTTP library).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

_SESSION = None


class RequestError(RuntimeError):
    """A request that failed."""


def post(url: str, body: dict, headers: dict, timeout: float) -> dict:
    """Sends JSON through one pooled session per worker (10 pools of 20 connections, 3 retries)."""
    global _SESSION
    import requests

    if _SESSION is None:
        _SESSION = requests.Session()
        for scheme in ("http://", "https://"):
            _SESSION.mount(scheme, requests.adapters.HTTPAdapter(pool_connections=10, pool_maxsize=20, max_retries=3))
    try:
        answer = _SESSION.post(url, json=body, headers=headers, timeout=timeout)
        answer.raise_for_status()
    except requests.RequestException as error:
        raise RequestError(str(error)) from error
    return answer.json()


class Provider:
    base_url, key_name, wants_key = "", "", False

    def __init__(self, model: str, base_url: str | None = None, api_key: str | None = None, post: Callable = post, **settings):
        self.model, self.settings, self.post = model, settings, post
        self.url = (base_url or self.base_url).rstrip("/")  # an empty setting counts as unset
        self._key = api_key or os.environ.get(self.key_name, "")
        if self.wants_key and not self._key:
            raise ValueError(f"{type(self).__name__} needs api_key or {self.key_name}")

    def call(self, path: str, body: dict, timeout: float = 120) -> dict:
        return self.post(self.url + path, body, {"Authorization": f"Bearer {self._key}"} if self._key else {}, timeout)


class OpenAIEmbedder(Provider):
    base_url, key_name, batch = "https://api.openai.com/v1", "OPENAI_API_KEY", 500
    #: Lengths of the vectors of known models.
    DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}

    @property
    def dimension(self) -> int:
        return self.settings.get("dimensions") or self.DIMENSIONS.get(self.model, 1536)

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        extra = {k: v for k, v in self.settings.items() if k in ("dimensions", "truncate") and v}
        found = self.call("/embeddings", {"model": self.model, "input": texts} | extra)["data"] if texts else []
        return [d["embedding"] for d in found]

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


class NIMEmbedder(OpenAIEmbedder):
    base_url, key_name, wants_key = "https://integrate.api.nvidia.com/v1", "NVIDIA_API_KEY", True

    def __init__(self, model: str, **settings):
        super().__init__(model, **({"truncate": "NONE"} | settings))
        self._dimension = None

    @property
    def dimension(self) -> int:
        if self._dimension is None:
            self._dimension = len(self.embed("test"))
        return self._dimension


class OllamaEmbedder(Provider):
    base_url, batch, threads = "http://localhost:11434", 500, 8

    @property
    def dimension(self) -> int:
        return self.settings.get("dimension", 768)

    def embed(self, text: str) -> list[float]:
        return self.call("/api/embeddings", {"model": self.model, "prompt": text}, 30)["embedding"]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for at in range(0, len(texts), self.batch):
            part = texts[at : at + self.batch]
            try:
                out += self.call("/api/embed", {"model": self.model, "input": part}).get("embeddings", [])
            except RequestError:
                out += self._one_by_one(part)
        return out

    def _one_by_one(self, texts: list[str]) -> list[list[float]]:
        def tried(text: str):
            try:
                return self.embed(text)
            except RequestError:
                return None

        with ThreadPoolExecutor(self.threads) as pool:
            found = list(pool.map(tried, texts))
        if failed := [i for i, v in enumerate(found) if v is None]:
            raise RuntimeError(f"Embedding failed for {len(failed)}/{len(texts)} texts at indices {failed}")
        return found


class OpenAIChat(Provider):
    base_url, key_name, supports_streaming = "https://api.openai.com/v1", "OPENAI_API_KEY", True

    def chat(self, messages: list[dict], temperature: float = 0.7, max_tokens: int | None = None) -> str:
        body = {"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}
        return self.call("/chat/completions", body)["choices"][0]["message"]["content"] or ""

    def generate(self, prompt: str, **settings) -> str:
        return self.chat([{"role": "user", "content": prompt}], **settings)


class NIMChat(OpenAIChat):
    base_url, key_name, wants_key, supports_streaming = "https://integrate.api.nvidia.com/v1", "NVIDIA_API_KEY", True, False


class OllamaChat(Provider):
    base_url, supports_streaming = "http://localhost:11434", False

    def _body(self, temperature: float, max_tokens: int | None) -> dict:
        options = {"temperature": temperature} | ({"num_predict": max_tokens} if max_tokens else {})
        return {"model": self.model, "stream": False, "options": options}

    def generate(self, prompt: str, temperature: float = 0.7, max_tokens: int | None = None) -> str:
        return self.call("/api/generate", self._body(temperature, max_tokens) | {"prompt": prompt})["response"]

    def chat(self, messages: list[dict], temperature: float = 0.7, max_tokens: int | None = None) -> str:
        return self.call("/api/chat", self._body(temperature, max_tokens) | {"messages": messages})["message"]["content"]


class Echo:
    """Needs no network: answers with the end of the prompt."""

    supports_streaming = False

    def __init__(self, model: str = "echo", letters: int = 200):
        self.model, self.letters = model, letters

    def generate(self, prompt: str, **settings) -> str:
        return prompt[-self.letters :]

    def chat(self, messages: list[dict], **settings) -> str:
        return self.generate(messages[-1]["content"] if messages else "")


EMBEDDERS: dict[str, Callable] = {"openai": OpenAIEmbedder, "ollama": OllamaEmbedder, "nim": NIMEmbedder}
CHATS: dict[str, Callable] = {"openai": OpenAIChat, "ollama": OllamaChat, "nim": NIMChat, "echo": Echo}


def register_embedder(name: str, make: Callable) -> None:
    EMBEDDERS[name] = make


def register_llm(name: str, make: Callable) -> None:
    CHATS[name] = make


def list_embedder_providers() -> list[str]:
    return list(EMBEDDERS)


def list_llm_providers() -> list[str]:
    return list(CHATS)


def _made(known: dict[str, Callable], name: str, settings: dict):
    if name not in known:
        raise ValueError(f"Unknown provider {name!r}; available: {', '.join(sorted(known))}")
    return known[name](**settings)


def create_embedder(provider: str = "openai", model: str = "text-embedding-3-small", **settings):
    return _made(EMBEDDERS, provider, {"model": model} | settings)


def create_llm(provider: str = "openai", model: str = "gpt-4o-mini", **settings):
    return _made(CHATS, provider, {"model": model} | settings)


def embedder_from(config: dict):
    """The embedder of the section ``embedding``; keys beside provider and model go to it as they are."""
    return create_embedder(**config.get("embedding", {}))


def llm_from(config: dict):
    """The chat model of the section ``llm``, likewise."""
    return create_llm(**config.get("llm", {}))


def embedded(rows: DataFrame, embedder, text: str = "text") -> DataFrame:
    """``rows`` with ``embedding`` (array<float>); each request holds at most ``embedder.batch`` texts."""
    size = getattr(embedder, "batch", 500)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                found = embedder.embed_batch(part[text].tolist())
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} vectors came back for {len(part)} texts")
                yield part.assign(embedding=found)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(each, f"{kinds}, embedding array<float>")


def answered(rows: DataFrame, llm, prompt: str = "prompt", **settings) -> DataFrame:
    """``rows`` with ``response``, the model's answer to each prompt."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(response=[llm.generate(p, **settings) for p in batch[prompt]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(each, f"{kinds}, response string")
