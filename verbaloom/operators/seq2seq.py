"""Sequence-to-sequence translation around any decoder: sentences once each, batches of like length, greedy decoding.

A Decoder turns ids into a memory and a prefix into next-token scores; weights and runtimes are its own affair. A text that
is too long raises, is cut, or is split at clauses; a sentence that runs away is tried again in halves, once.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np

from verbaloom.functions import segment
from verbaloom.operators.translate import Outcome, Translator


class InputTooLong(ValueError):
    """A sentence has more tokens than the model takes, and neither truncate nor split_long is set."""


class Decoder(ABC):
    """start: the first token; end: the last one."""

    start: int
    end: int
    limit: int

    @abstractmethod
    def tokenize(self, text: str) -> tuple[list[int], list[tuple[int, int]]]: ...

    @abstractmethod
    def text(self, ids: list[int]) -> str: ...

    def frame(self, ids: list[int], source: str | None, target: str) -> list[int]:
        return [*ids, self.end]

    def forced(self, target: str) -> int | None:
        return None

    def banned(self) -> tuple[int, ...]:
        return ()

    @abstractmethod
    def encode(self, ids: np.ndarray, mask: np.ndarray): ...

    @abstractmethod
    def scores(self, memory, rows: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Next-token scores of the live rows of a batch, whose memory is the whole batch's."""


def greedy(decoder: Decoder, batch: list[list[int]], target: str, budget: int) -> tuple[list[list[int]], list[bool]]:
    """Tokens of each sequence without the end, and whether it used up the budget. Finished rows leave the batch."""
    width = max(map(len, batch))
    ids = np.array([[*s, *[decoder.end] * (width - len(s))] for s in batch])
    mask = np.arange(width)[None, :] < np.array([len(s) for s in batch])[:, None]
    memory, live = decoder.encode(ids, mask), np.arange(len(batch))
    prefix = np.full((len(batch), 1), decoder.start)
    out: list[list[int]] = [[] for _ in batch]
    full = [True] * len(batch)
    for step in range(budget):
        if step == 0 and decoder.forced(target) is not None:
            nxt = np.full(len(live), decoder.forced(target))
        else:
            scores = np.array(decoder.scores(memory, live, prefix), dtype=np.float64)
            scores[:, list(decoder.banned())] = -np.inf
            nxt = scores.argmax(axis=1)
        going = nxt != decoder.end
        for row, token in zip(live[going].tolist(), nxt[going].tolist(), strict=True):
            out[row].append(token)
        for row in live[~going].tolist():
            full[row] = False
        live, prefix = live[going], np.concatenate([prefix[going], nxt[going, None]], axis=1)
        if not len(live):
            break
    skip = decoder.forced(target) is not None
    return [o[skip:] for o in out], full


class Seq2Seq(Translator):
    def __init__(self, decoder: Decoder, name: str, sources=None, targets=None, *, truncate: bool = False, split_long: bool = False, batch_size: int = 32) -> None:
        self.decoder, self.name, self.sources, self.targets = decoder, name, sources, targets
        self.truncate, self.split_long, self.batch_size = truncate, split_long, batch_size

    def _decode(self, sequences: list[list[int]], target: str) -> tuple[list[list[int]], list[bool]]:
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        out, full = [None] * len(sequences), [False] * len(sequences)
        for k in range(0, len(order), self.batch_size):
            part = order[k : k + self.batch_size]
            budget = min(self.decoder.limit, 2 * max(len(sequences[i]) for i in part) + 10)
            for i, ids, f in zip(part, *greedy(self.decoder, [sequences[i] for i in part], target, budget), strict=True):
                out[i], full[i] = ids, f
        return out, full

    def _sentences(self, sentences: list[str], source: str | None, target: str) -> list[Outcome]:
        d, jobs, owner, gaps = self.decoder, [], [], []
        room = d.limit - len(d.frame([], source, target))
        flags = [Outcome("") for _ in sentences]
        for i, s in enumerate(sentences):
            ids, offsets = d.tokenize(s)
            pieces = [(s, "")]
            if len(ids) > room:
                if self.split_long:
                    pieces = segment.fit(s, offsets, min(128, d.limit - max(1, d.limit // 16)))
                    flags[i].split = True
                elif self.truncate:
                    flags[i].truncated = True
                else:
                    raise InputTooLong(f"{len(ids)} tokens; the model takes {room}")
            for piece, gap in pieces:
                jobs.append(d.frame(d.tokenize(piece)[0][:room], source, target))
                owner.append(i)
                gaps.append(gap)
        done, full = self._decode(jobs, target)
        texts = [d.text(ids).strip() for ids in done]
        if self.split_long:
            for k in [k for k, f in enumerate(full) if f and len(jobs[k]) >= 8]:
                whole = sentences[owner[k]]
                ids, offsets = d.tokenize(whole)
                halves = segment.fit(whole, offsets, -(-len(ids) // 2))
                again, over = self._decode([d.frame(d.tokenize(h)[0][:room], source, target) for h, _ in halves], target)
                if not any(over) and owner.count(owner[k]) == 1:
                    texts[k] = "".join(d.text(x).strip() + g for x, (_, g) in zip(again, halves, strict=True))
                    full[k], flags[owner[k]].split = False, True
        for k, i in enumerate(owner):
            flags[i].text += texts[k] + gaps[k]
            flags[i].limit_reached |= full[k]
        return flags

    def outcomes(self, texts: list[str], source: str | None, target: str) -> list[Outcome]:
        cut = [segment.segment(t) for t in texts]
        distinct = list(dict.fromkeys(s for sentences, _ in cut for s in sentences))
        done = dict(zip(distinct, self._sentences(distinct, source, target) if distinct else [], strict=True))
        result = []
        for sentences, gaps in cut:
            parts = [done[s] for s in sentences]
            text = gaps[0]
            for i, p in enumerate(parts):
                bare = i < len(parts) - 1 and not gaps[i + 1] and p.text[-1:] not in tuple(segment.FULL_WIDTH)
                text += p.text + (" " if bare else gaps[i + 1])
            result.append(Outcome(text, any(p.truncated for p in parts), any(p.limit_reached for p in parts), any(p.split for p in parts)))
        return result

    def translate(self, texts: list[str], source: str | None, target: str) -> list[str]:
        return [o.text for o in self.outcomes(texts, source, target)]
