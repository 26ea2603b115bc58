"""Language and embedding providers: the protocol, the registry, the local embedder, HTTP retries."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ProviderError, ProviderNotConfiguredError
from .operators import vectors

# Environment keys, orders of preference, and when a request is tried again.
KEYS = {"anthropic": "ANTHROPIC_API_KEY", "openai": "OPENAI_API_KEY", "azure-openai": "AZURE_OPENAI_API_KEY", "google": "GOOGLE_API_KEY", "openrouter": "OPENROUTER_API_KEY"}
GENERATE_ORDER = ("anthropic", "openai", "azure-openai", "google", "openrouter")
EMBED_ORDER = ("openai", "azure-openai", "google")
RETRIED = (408, 409, 425, 429, 500, 502, 503, 504)
RETRIES, FIRST_WAIT, LONGEST_WAIT = 2, 0.3, 4.0


class Provider(Protocol):
    name: str
    capabilities: tuple[str, ...]

    def generate(self, prompt: str, **options) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LocalEmbedder:
    """Hashed embeddings computed by Spark itself."""

    name, model, dim = "local", f"hashed-{vectors.DIMENSIONS}", vectors.DIMENSIONS
    capabilities = ("embed",)

    def embed_frame(self, corpus: DataFrame) -> DataFrame:
        return vectors.hashed_embedding(corpus)


class RemoteEmbedder:
    """A provider whose embed() runs over Arrow batches of the corpus."""

    def __init__(self, provider: Provider, model: str = "", batch: int = 64):
        self.provider, self.model, self.batch, self.name = provider, model, batch, provider.name

    def embed_frame(self, corpus: DataFrame) -> DataFrame:
        import pyarrow as pa

        provider, size = self.provider, self.batch

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, size):
                    part = b.slice(at, size)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(provider.embed(part.column(1).to_pylist()), pa.list_(pa.float32()))], ["id", "v"])

        d = corpus.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, v array<float>")
        return d.select("id", vectors.normalized(F.col("v")).cast("array<float>").alias("v"))


class Registry:
    def __init__(self, env: dict[str, str] | None = None):
        self.env = dict(os.environ) if env is None else env
        self.own: dict[str, Provider] = {}

    def add(self, provider: Provider) -> None:
        self.own[provider.name] = provider

    def available(self) -> dict[str, bool]:
        """Providers and whether they are configured; a blank key is none."""
        return {**{n: bool(self.env.get(k, "").strip()) for n, k in KEYS.items()}, "local": True, **dict.fromkeys(self.own, True)}

    def _first(self, order, capability: str) -> Provider:
        for p in self.own.values():
            if capability in p.capabilities:
                return p
        there = [n for n in order if self.available().get(n)]
        raise ProviderNotConfiguredError(f"no provider can {capability} here" + (f"; install one for {there[0]}" if there else ""))

    def generator(self, name: str = "auto") -> Provider:
        if name != "auto":
            if name in self.own:
                return self.own[name]
            raise ProviderNotConfiguredError(f"provider {name!r} is not installed")
        return self._first(GENERATE_ORDER, "generate")

    def embedder(self, name: str = "auto"):
        """The named one, else a registered one that embeds, else the local one."""
        if name in ("auto", "local"):
            own = next((p for p in self.own.values() if "embed" in p.capabilities), None)
            return RemoteEmbedder(own) if own and name == "auto" else LocalEmbedder()
        if name in self.own:
            return RemoteEmbedder(self.own[name])
        raise ProviderNotConfiguredError(f"provider {name!r} is not installed")


def post_json(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float = 60, wait=time.sleep, opener=urllib.request.urlopen) -> dict:
    """POST with up to RETRIES more tries on passing failures, waiting twice as long each time."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    for n in range(RETRIES + 1):
        try:
            with opener(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or n == RETRIES:
                raise ProviderError(f"{url}: status {e.code}") from e
        except (urllib.error.URLError, TimeoutError) as e:
            if n == RETRIES:
                raise ProviderError(f"{url}: {e}") from e
        wait(min(FIRST_WAIT * 2**n, LONGEST_WAIT))
    raise AssertionError("unreachable")
