"""Reads a byte n-gram naive Bayes model in the public langid.py form and scores texts with it in numpy.

The model is a Python literal: base64 of bz2 of a pickle of (log P(feature | class), log P(class), classes, automaton moves,
features of states). Only plain containers, numbers, strings and arrays are unpickled.
"""

from __future__ import annotations

import base64
import bz2
import io
import pickle
import re
import tarfile

import numpy as np


class Strict(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) in (("array", "array"), ("array", "_array_reconstructor")):
            import array

            return getattr(array, name)
        raise pickle.UnpicklingError(f"{module}.{name} isn't allowed in a model")


def read_source(path: str) -> bytes:
    """The text that holds the model: the file itself, or the one in an archive that names it."""
    if not tarfile.is_tarfile(path):
        with open(path, "rb") as f:
            return f.read()
    with tarfile.open(path) as t:
        for m in t:
            if m.isfile() and m.name.endswith("langid.py"):
                return t.extractfile(m).read()
    raise ValueError(f"{path} holds no model")


class ByteBayes:
    """predict(texts): (label, probability) of each text, over all labels or those named, whose softmax it is."""

    def __init__(self, path: str, languages: tuple[str, ...] | None = None) -> None:
        m = re.search(rb'model\s*=\s*b?"""(.*?)"""', read_source(path), re.S)
        if not m:
            raise ValueError(f"{path} holds no model")
        ptc, pc, classes, moves, outputs = Strict(io.BytesIO(bz2.decompress(base64.b64decode(m[1])))).load()
        self.classes = [str(c) for c in classes]
        self.prior = np.array(pc, dtype=np.float64)
        weights = np.array(ptc, dtype=np.float64).reshape(-1, len(self.classes))
        self.moves = np.array(moves, dtype=np.int64).reshape(-1, 256)
        # A state's weight is the sum over its features; states without any have none.
        self.states = np.zeros((len(self.moves), len(self.classes)))
        for state, features in outputs.items():
            if features:
                self.states[state] = weights[list(features)].sum(axis=0)
        if languages is not None:
            if unknown := sorted(set(languages) - set(self.classes)):
                raise ValueError(f"the model doesn't know {', '.join(unknown)}")
            keep = [i for i, c in enumerate(self.classes) if c in languages]
            self.classes = [self.classes[i] for i in keep]
            self.prior, self.states = self.prior[keep], self.states[:, keep]

    def predict(self, texts: list[str]) -> list[list[tuple[str, float]]]:
        """All texts walk the automaton side by side, longest first, so a step is one gather."""
        raw = [t.encode() for t in texts]
        order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
        sizes = np.array([len(raw[i]) for i in order])
        score = np.tile(self.prior, (len(raw), 1))
        state = np.zeros(len(raw), dtype=np.int64)
        table = np.zeros((int(sizes.max(initial=0)), len(raw)), dtype=np.uint8)
        for k, i in enumerate(order):
            table[: len(raw[i]), k] = np.frombuffer(raw[i], dtype=np.uint8)
        for step in table:
            n = int(np.searchsorted(-sizes, 0, side="left"))
            state[:n] = self.moves[state[:n], step[:n]]
            score[:n] += self.states[state[:n]]
            sizes = sizes - 1
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        out: list = [None] * len(raw)
        for k, i in enumerate(order):
            out[i] = list(zip(self.classes, map(float, p[k]), strict=True))
        return out
