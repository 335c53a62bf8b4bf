"""Model connectors: retries and typed errors around any embedder or language model, and an offline embedder."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Sequence
from typing import Protocol

DIMENSIONS = 64
#: Texts in one call, tries after the first, and seconds before the first of them.
BATCH, RETRIES, BASE_DELAY = 100, 4, 2.0
Embedder = Callable[[Sequence[str]], list[list[float]]]


class ModelError(RuntimeError):
    """A model that failed all its tries or gave something else than asked for."""


class Unavailable(RuntimeError):
    """What a connector raises for a failure that may pass: a timeout, too many requests, a server error."""


def tried(call: Callable[[], object], retries: int = RETRIES, delay: float = BASE_DELAY, sleep: Callable[[float], None] = time.sleep):
    """The call's result; failures that may pass are tried again after doubling delays, all others are final."""
    for n in range(retries + 1):
        try:
            return call()
        except Unavailable as error:
            if n == retries:
                raise ModelError(f"failed {retries + 1} times: {error}") from error
            sleep(delay * 2**n)
        except ModelError:
            raise
        except Exception as error:
            raise ModelError(str(error)) from error


def embedded(embedder: Embedder, texts: Sequence[str], **how) -> list[list[float]]:
    """One vector per text, in their order, BATCH texts a call."""
    out: list[list[float]] = []
    for i in range(0, len(texts), BATCH):
        part = list(texts[i : i + BATCH])
        vectors = tried(lambda part=part: embedder(part), **how)
        if len(vectors) != len(part):
            raise ModelError(f"{len(part)} texts gave {len(vectors)} vectors")
        out += vectors
    return out


def in_order(answers: Sequence[tuple[int, list[float]]]) -> list[list[float]]:
    """Vectors that an answer numbers, put in the order of their numbers 0, 1, ...; a gap or a repeat is an error."""
    ordered = sorted(answers, key=lambda a: a[0])
    if [n for n, _ in ordered] != list(range(len(ordered))):
        raise ModelError("the answer's numbers are not those of the texts")
    return [v for _, v in ordered]


def hash_embedder(dimensions: int = DIMENSIONS) -> Callable[[Sequence[str]], list[list[float]]]:
    """Signed feature hashing of words and word pairs, scaled to length 1: the same text, the same vector."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = re.findall(r"\w+", text.lower())
            vector = [0.0] * dimensions
            for feature in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                digest = hashlib.blake2b(feature.encode(), digest_size=8).digest()
                vector[int.from_bytes(digest[:4], "big") % dimensions] += 1.0 if digest[4] & 1 else -1.0
            length = math.sqrt(sum(x * x for x in vector)) or 1.0
            out.append([x / length for x in vector])
        return out

    return embed


class LanguageModel(Protocol):
    """Answers a prompt with JSON that follows a schema."""

    def complete_json(self, system: str, user: str, schema_name: str, schema: dict) -> dict: ...


#: What the cards of an answer look like, and what a model is told.
CARDS = {
    "type": "object",
    "properties": {
        "cards": {
            "type": "array",
            "items": {"type": "object", "properties": {"specs": {"type": "array", "items": {"type": "string"}}, "explanation": {"type": "string"}}, "required": ["specs", "explanation"], "additionalProperties": False},
        }
    },
    "required": ["cards"],
    "additionalProperties": False,
}
SYSTEM = "You explain shoe recommendations. Use only the specifications and evidence given. Answer with JSON: one card per candidate, in order."


def answered(model: LanguageModel, prompt: str, **how) -> str | None:
    """The model's answer to a prompt as JSON text, or None if it fails."""
    try:
        return json.dumps(tried(lambda: model.complete_json(SYSTEM, prompt, "cards", CARDS), **how))
    except (ModelError, TypeError):
        return None
