"""Interfaces of what lies outside the engine (A21, A22, A24-A26, A28, A30): networks, brokers and taggers.

Each class states what the engine needs; deployments supply the transport.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol


@dataclass(frozen=True)
class Hop:
    status: int
    url: str
    mime: str
    content: bytes = b""
    refresh: str | None = None


class Fetcher(Protocol):
    """One HTTP request without redirects of its own kind beyond HTTP's."""

    def get(self, url: str, user_agent: str | None = None) -> list[Hop]: ...


def follow(fetcher: Fetcher, url: str, target: Callable[[Hop], tuple[float, str] | None], max_delay: float = 20) -> list[Hop]:
    """Hops of a page including refreshes (A21): stops at an error, a loop, or a refresh that waits too long."""
    hops: list[Hop] = []
    while True:
        hops += fetcher.get(url)
        if hops[-1].status >= 400:
            return hops
        refresh = target(hops[-1])
        if refresh is None or refresh[0] > max_delay or any(h.url == refresh[1] for h in hops):
            return hops
        url = refresh[1]


class CountSource(Protocol):
    """Share counts of urls or object ids (A22), at most ``batch`` per call."""

    batch: int

    def fetch(self, keys: list[str]) -> dict[str, dict]: ...


def fetch_all(source: CountSource, keys: Iterable[str], retries: int = 10, wait: Callable[[int], None] = lambda n: None) -> Iterator[tuple[str, dict]]:
    """All keys in batches; a failing batch is retried with growing waits, then halved, then given up."""

    def part(batch: list[str]) -> Iterator[tuple[str, dict]]:
        for n in range(retries):
            try:
                yield from source.fetch(batch).items()
                return
            except OSError:
                wait(n)
        if len(batch) > 1:
            yield from part(batch[: len(batch) // 2])
            yield from part(batch[len(batch) // 2 :])

    held: list[str] = []
    for k in keys:
        held.append(k)
        if len(held) == source.batch:
            yield from part(held)
            held = []
    if held:
        yield from part(held)


@dataclass
class TopicQuery:
    """Boolean topic search terms (A24, C12), rendered for a search service or used as a filter."""

    terms: list[str] = field(default_factory=list)

    def term(self, kind: str, value: str) -> TopicQuery:
        return TopicQuery([*self.terms, f'{kind}:("{value}")'])

    def all(self) -> TopicQuery:
        return TopicQuery([f"({' AND '.join(self.terms)})"])

    def any(self) -> TopicQuery:
        return TopicQuery([f"({' OR '.join(self.terms)})"])
