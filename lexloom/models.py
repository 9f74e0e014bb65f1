"""Plug-in models: text generators and embedders behind small protocols, loaded in the worker on first use."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass

from lexloom.config import DEFAULTS

TEMPERATURE = 0.3
TIMEOUT = 120


def _post(url: str, body: dict, headers: dict | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=TIMEOUT) as reply:
        return json.load(reply)


@dataclass
class OllamaModel:
    model: str = "llama3"
    url: str = "http://localhost:11434"

    def complete(self, prompt: str) -> str:
        return _post(f"{self.url}/api/generate", {"model": self.model, "prompt": prompt, "stream": False})["response"]


@dataclass
class OpenAIModel:
    key: str
    model: str = "gpt-4o-mini"
    url: str = "https://api.openai.com/v1"

    def complete(self, prompt: str) -> str:
        body = {"model": self.model, "temperature": TEMPERATURE, "messages": [{"role": "user", "content": prompt}]}
        return _post(f"{self.url}/chat/completions", body, {"Authorization": f"Bearer {self.key}"})["choices"][0]["message"]["content"]


@dataclass
class GeminiModel:
    key: str
    model: str = "gemini-1.5-flash"
    url: str = "https://generativelanguage.googleapis.com/v1beta"

    def complete(self, prompt: str) -> str:
        reply = _post(f"{self.url}/models/{self.model}:generateContent", {"contents": [{"parts": [{"text": prompt}]}]}, {"x-goog-api-key": self.key})
        return reply["candidates"][0]["content"]["parts"][0]["text"]


PROVIDERS = {"ollama": OllamaModel, "openai": OpenAIModel, "gemini": GeminiModel}


def text_model(provider: str, **options):
    """The named provider's model; an unknown name is a ValueError."""
    try:
        return PROVIDERS[provider.lower()](**options)
    except KeyError:
        raise ValueError(f"unknown provider {provider!r}; choose from {', '.join(sorted(PROVIDERS))}") from None


class SentenceTransformerEmbedder:
    """A sentence-transformers model, if that package is installed; its own dimension replaces a wrong one."""

    def __init__(self, name: str = "all-MiniLM-L6-v2", dimension: int = DEFAULTS.embedding_dimension):
        self.name, self.dimension, self._model = name, dimension, None

    def __getstate__(self):
        return {**self.__dict__, "_model": None}

    def _load(self):
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.name)
            self.dimension = self._model.get_sentence_embedding_dimension()
        return self._model

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        return [v.tolist() for v in self._load().encode(texts, batch_size=64)] if texts else []

    def info(self) -> dict:
        return {"model": self.name, "dimension": self.dimension, "loaded": self._model is not None}
