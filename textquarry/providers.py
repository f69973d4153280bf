"""Embedding and language models behind small interfaces.

Nothing here reaches a network. The offline stand-ins are deterministic and rule-based; they
have the shape of a model's answers, not their quality. A real provider is any object with the
same methods.
"""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol, TypeVar

R = TypeVar("R")

EMBEDDING_BATCH, BATCH_PAUSE = 50, 0.5
RETRIES, FIRST_WAIT, EXTRA_WAIT, MOST_WAIT = 5, 1.0, 0.5, 60.0
# Characters of a document that a summary, a project and an entity prompt take.
SUMMARY_CHARS, PROJECT_CHARS, ENTITY_CHARS, ENTITY_PAGES = 30_000, 25_000, 2_000, 3
TRUNCATED = "\n\n[Document truncated...]"


class RateLimited(Exception):
    """A provider asks to be called later."""

    def __init__(self, wait: float | None = None):
        super().__init__("rate limited")
        self.wait = wait


def with_retry(call: Callable[[], R], sleep: Callable[[float], None] = time.sleep) -> R:
    """The call's result; while it is rate limited it is tried again, ever later, RETRIES times at most."""
    for attempt in range(RETRIES):
        try:
            return call()
        except RateLimited as limit:
            if attempt == RETRIES - 1:
                raise
            wait = limit.wait if limit.wait is not None else FIRST_WAIT * 2**attempt
            sleep(min(wait + EXTRA_WAIT, MOST_WAIT))
    raise AssertionError("unreachable")


class EmbeddingProvider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LanguageProvider(Protocol):
    def summarize(self, content: str, url: str) -> dict[str, Any]: ...

    def projects(self, content: str, url: str) -> list[dict[str, Any]]: ...

    def entity(self, pages: list[dict[str, str]], website: str) -> dict[str, Any] | None: ...

    def rank(self, links: list[dict[str, Any]]) -> list[dict[str, Any]]: ...

    def answer(self, query: str, context: str) -> str: ...

    def stream(self, query: str, context: str) -> Iterator[str]: ...


def embed_all(provider: EmbeddingProvider, texts: Iterable[str], sleep: Callable[[float], None] = time.sleep) -> Iterator[list[float]]:
    """Embeddings in order, EMBEDDING_BATCH texts to a call, with a pause between calls."""
    held: list[str] = []
    called = False
    for text in texts:
        held.append(text)
        if len(held) == EMBEDDING_BATCH:
            if called:
                sleep(BATCH_PAUSE)
            yield from with_retry(lambda some=tuple(held): provider.embed(list(some)), sleep)
            held, called = [], True
    if held:
        if called:
            sleep(BATCH_PAUSE)
        yield from with_retry(lambda: provider.embed(held), sleep)


class HashedEmbedding:
    """Stand-in: words hashed into a fixed number of signed dimensions, unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.dimension
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                vector[h % self.dimension] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in vector)) or 1.0
            out.append([x / norm for x in vector])
        return out


_SENTENCES = re.compile(r"(?<=[.!?])\s+")
_YEAR = re.compile(r"(?i)\b(?:FY|fiscal year)\s*(20\d\d)\b")
_MONEY = re.compile(r"\$\s?([\d,.]+)\s*(million|M|billion|B|K|thousand)?\b")
_UNITS = {"million": 1e6, "m": 1e6, "billion": 1e9, "b": 1e9, "k": 1e3, "thousand": 1e3}
# Words that tell a phase, from the latest to the earliest; and a document's type.
_PHASE_WORDS = [("in_progress", "underway|in progress|construction began"), ("awarded", "awarded|selected vendor"), ("rfp_open", r"\brf[pqi]\b|request for proposal|bids due"), ("contacts", "project manager|director|contact:"), ("budget", r"budget|allocated|approved|\$"), ("strategy", "plan|goal|strateg|initiative")]
_TYPE_WORDS = [("budget", "budget|appropriation|financial report"), ("meeting", "minutes|agenda|board meeting|council"), ("rfp", r"\brf[pqi]\b|procurement|bid"), ("policy", "policy|handbook|procedure"), ("contact", "directory|contact list")]


def _first(table: list[tuple[str, str]], text: str, other: str) -> str:
    return next((name for name, words in table if re.search(words, text, re.I)), other)


class RuleModel:
    """Stand-in: sentences, years, amounts and key words found by rules."""

    def summarize(self, content: str, url: str) -> dict[str, Any]:
        text = content[:SUMMARY_CHARS]
        title = next((line.lstrip("# ").strip() for line in text.splitlines() if line.strip()), "")
        prose = " ".join(line for line in text.splitlines() if not line.startswith("#"))
        year = _YEAR.search(text)
        words = sorted({w.lower() for w in re.findall(r"\b[A-Za-z]{7,}\b", prose)})[:10]
        return {"title": title[:200], "summary": " ".join(_SENTENCES.split(prose.strip())[:2]), "keywords": words, "document_type": _first(_TYPE_WORDS, text, "other"), "fiscal_year": int(year[1]) if year else None}

    def projects(self, content: str, url: str) -> list[dict[str, Any]]:
        text, out = content[:PROJECT_CHARS], []
        for head, body in re.findall(r"^#{2,4}\s+(.+)\n((?:(?!#).*\n?)*)", text, re.M):
            if not re.search(r"project|initiative|upgrade|modernization|rfp|improvement|program", head + body, re.I):
                continue
            money, year = _MONEY.search(head + body), _YEAR.search(head + body)
            value = float(money[1].replace(",", "").rstrip(".") or 0) * _UNITS.get((money[2] or "").lower(), 1) if money else None
            quotes = [s for s in _SENTENCES.split(" ".join(body.split())) if s][:2]
            out.append(
                {
                    "title": head.strip(), "description": quotes[0] if quotes else "", "phase": _first(_PHASE_WORDS, head + body, "strategy"), "phase_reasoning": "key words", "phase_confidence": 0.6, "category": "other",
                    "estimated_value": value, "fiscal_year": int(year[1]) if year else None, "timeline_notes": None, "contacts": [], "evidence_excerpts": quotes, "keywords": [],
                }
            )
        return out

    def entity(self, pages: list[dict[str, str]], website: str) -> dict[str, Any] | None:
        sample = entity_sample(pages)
        if len(sample) < 100:
            return None
        found = re.search(r"\b((?:City|County|University|Town) of [A-Z]\w+(?: [A-Z]\w+)?|[A-Z]\w+ (?:School District|County))", sample)
        if not found:
            return None
        name = found[1]
        kind = next((k for k, w in (("city", "City"), ("county", "County"), ("school_district", "School"), ("university", "University")) if w in name), "other")
        return {"name": name, "type": kind, "state": None, "confidence": 0.6}

    def rank(self, links: list[dict[str, Any]]) -> list[dict[str, Any]]:
        return [{"index": i, "relevance_score": float(link.get("score") or 0.5), "category": "other", "rationale": "score of its words"} for i, link in enumerate(links)]

    def answer(self, query: str, context: str) -> str:
        return "".join(self.stream(query, context))

    def stream(self, query: str, context: str) -> Iterator[str]:
        asked = set(re.findall(r"\w+", query.lower()))
        best = sorted(_SENTENCES.split(context), key=lambda s: -len(asked & set(re.findall(r"\w+", s.lower()))))[:3]
        for sentence in best:
            yield sentence.strip() + "\n"


def entity_sample(pages: list[dict[str, str]]) -> str:
    """What an entity prompt is given of the first pages."""
    some = [f"URL: {p['url']}\nTitle: {p['title']}\nContent:\n{p['content'][:ENTITY_CHARS]}" for p in pages[:ENTITY_PAGES]]
    return "\n\n---\n\n".join(some)


def ranking_prompt(links: list[dict[str, Any]]) -> str:
    """What a ranking prompt is given of a batch of links."""
    return "\n\n".join(f"[{i}] URL: {x['url']}\nAnchor: {x['anchor_text']}\nContext: {x['context'][:200]}" for i, x in enumerate(links))


def answer_prompt(query: str, context: str) -> str:
    return f"Context from retrieved documents and projects:\n\n{context}\n\n---\n\nUser question: {query}"
