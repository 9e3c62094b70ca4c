"""Models behind replaceable clients: embed, score, complete.

A client is made once per Python worker and sees Arrow batches, so one connection serves a partition and
calls can be batched.  Tests use the fakes, which are pure functions of their input.
"""

from __future__ import annotations

import hashlib
import json
import logging
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger("askmill")


class Client(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...

    def complete(self, prompts: list[str], model: str, temperature: float) -> list[str]: ...

    def entail(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float]]:
        """(entailment, contradiction) of each (text, claim)."""

    def spans(self, pairs: list[tuple[str, str]]) -> list[tuple[float, str]]:
        """(score, answer span) of each (question, text)."""


Factory = Callable[[], Client]


class FakeClient:
    """Deterministic stand-in: hashed vectors, word overlap, an answer made from the first fact."""

    dim = 16

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1 if h >> 40 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [len(set(a.lower().split()) & set(b.lower().split())) / max(1, len(set(a.lower().split()))) for a, b in pairs]

    def entail(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float]]:
        return [(s, 0.0) for s in self.score([(claim, text) for text, claim in pairs])]

    def spans(self, pairs: list[tuple[str, str]]) -> list[tuple[float, str]]:
        return [(s, " ".join(w for w in text.split() if w.lower() in question.lower().split())) for s, (question, text) in zip(self.score(pairs), pairs)]

    def complete(self, prompts: list[str], model: str, temperature: float) -> list[str]:
        out = []
        for p in prompts:
            fact = re.search(r"Fact (\d+): \[([^\]]*?),", p)
            out.append(json.dumps({"supporting_fact_numbers": [int(fact[1])] if fact else [], "answer": fact[2] if fact else ""}))
        return out


class HttpClient:
    """A chat server: /api/chat, or /api/generate where the first isn't known; /api/embed for vectors."""

    def __init__(self, url: str, embed_model: str = "", timeout: float = 300) -> None:
        self.url, self.embed_model, self.timeout = url.rstrip("/"), embed_model, timeout

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(self.url + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return json.load(r)

    def embed(self, texts: list[str]) -> list[list[float]]:
        v = np.array(self._post("/api/embed", {"model": self.embed_model, "input": texts})["embeddings"], np.float32)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(norm == 0, 1, norm)).tolist()

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        raise NotImplementedError("this server has no reranker; inject a client that has")

    def complete(self, prompts: list[str], model: str, temperature: float) -> list[str]:
        out = []
        for p in prompts:
            options = {"model": model, "stream": False, "options": {"temperature": temperature}}
            try:
                text = self._post("/api/chat", options | {"messages": [{"role": "user", "content": p}]}).get("message", {}).get("content", "")
            except urllib.error.HTTPError as e:
                if e.code != 404:
                    raise
                text = self._post("/api/generate", options | {"prompt": p}).get("response", "")
            out.append(re.sub(r"<think>.*?</think>", "", text, flags=re.DOTALL).strip())
        return out


def best_span(starts: np.ndarray, ends: np.ndarray, most: int = 16) -> tuple[float, int, int]:
    """(score, first, last token) of an extractive reader's logits: both maxima, at most ``most`` tokens apart."""
    first, last = int(np.argmax(starts)), int(np.argmax(ends))
    last = min(max(first, last), first + most)
    share = lambda x, i: float(np.exp(x[i] - x.max()) / np.exp(x - x.max()).sum())
    return (share(starts, first) * share(ends, last)) ** 0.5, first, last


def embedder(make: Factory) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for s in batches:
            yield pd.Series(client.embed(s.fillna("").tolist()))

    return embed


def model_scorer(make: Factory) -> Callable[[Column, Column], Column]:
    """A scorer for ``rerank`` and ``select_sentences``."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        client = make()
        for a, b in batches:
            yield pd.Series(client.score(list(zip(a.fillna(""), b.fillna("")))), dtype="float64")

    return score


def completer(make: Factory, model: str, temperature: float) -> Callable[[Column], Column]:
    """Replies of a model; a prompt whose call fails has a NULL reply and doesn't stop the others."""

    @F.pandas_udf("string")
    def complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()

        def one(prompt: str) -> str | None:
            try:
                return client.complete([prompt], model, temperature)[0]
            except Exception as e:
                log.warning("a prompt failed: %s", e)
                return None

        for s in batches:
            asked = s.fillna("").tolist()
            try:
                said = client.complete(asked, model, temperature)
            except Exception:
                said = [one(p) for p in asked]
            yield pd.Series(said, dtype="object")

    return complete


def _checker(make: Factory, kind: str, name: str, convert: Callable):
    """A pandas function over (a, b) of the client's method ``name``; NULL where the client has none or it fails."""

    @F.pandas_udf(kind)
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        client = make()
        for a, b in batches:
            try:
                found = getattr(client, name)(list(zip(a.fillna(""), b.fillna(""))))
            except Exception as e:
                log.warning("%s failed, the overlap stands: %s", name, e)
                found = [None] * len(a)
            yield convert(found)

    return check


def entailment(make: Factory) -> Callable[[Column, Column], Column]:
    """Entailment less half the contradiction, not below 0, of (text, claim)."""
    return _checker(make, "double", "entail", lambda xs: pd.Series([None if x is None else max(0.0, x[0] - 0.5 * x[1]) for x in xs], dtype="float64"))


def span_reader(make: Factory) -> Callable[[Column, Column], Column]:
    """STRUCT(score, span) of (question, text)."""
    return _checker(make, "struct<score:double,span:string>", "spans", lambda xs: pd.DataFrame([(None, None) if x is None else x for x in xs], columns=["score", "span"]))


def probe(make: Factory) -> int:
    """Dimension of the embedder; raises where it can't be reached."""
    return len(make().embed(["probe"])[0])
