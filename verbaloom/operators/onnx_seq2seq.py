"""Decoders over ONNX graphs, and how four families of translation models frame their input.

A folder holds an encoder, a decoder and tokenizer.json; which files a precision has is in plans.catalog. The decoder may take
the keys and values of the steps before it; then each step computes one token, and rows that are finished leave the
cache. onnxruntime and tokenizers are needed where a model runs, not to import this.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

from verbaloom.operators.model_pool import worker_pool
from verbaloom.operators.seq2seq import Decoder, Seq2Seq
from verbaloom.plans.catalog import model_files


def session(path: str | Path, threads: int = 1):
    """A sequential CPU session without an arena; threads is what a task may use, as spark.task.cpus says."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.execution_mode = onnxruntime.ExecutionMode.ORT_SEQUENTIAL
    options.intra_op_num_threads, options.inter_op_num_threads = threads, 1
    options.enable_cpu_mem_arena = False
    return onnxruntime.InferenceSession(str(path), options, providers=["CPUExecutionProvider"])


@dataclass(frozen=True)
class Family:
    """source, target: the token of a language, or None where a family has none; before: which of them comes first in the
    input; forced: whether the target's token is the first that is decoded; banned: tokens that are never decoded."""

    token: Callable[[str, Callable[[str], int | None]], int | None] = lambda code, find: None
    before: str | None = None
    forced: bool = False
    banned: tuple[str, ...] = ()
    any_source: bool = False
    drop_invalid_merges: bool = False


def _wrapped(form: str):
    return lambda code, find: find(form.format(code))


def nllb_token(code: str, find: Callable[[str], int | None], part3: dict[str, str] | None = None, scripts: tuple[str, ...] = ("Latn", "Cyrl", "Arab", "Deva", "Hans", "Hant", "Jpan", "Hang", "Beng", "Grek", "Hebr", "Thai", "Ethi", "Taml", "Telu", "Armn", "Geor", "Gujr", "Guru", "Khmr", "Knda", "Laoo", "Mlym", "Mymr", "Orya", "Sinh", "Tibt", "Tfng", "Olck")) -> int | None:
    """A language by its ISO 639-3 code and a script: the first of these that the vocabulary has."""
    from verbaloom.functions.codes import MACRO, PART1

    name = (part3 or {}).get(code) or PART1.get(code, code)
    names = [name, *[k for k, v in MACRO.items() if v == name]]
    return next((i for n in names for s in scripts if (i := find(f"{n}_{s}")) is not None), None)


#: Which families there are. Opus reads one direction and, for some pairs, a >>code<< that its folder's config names.
FAMILIES: dict[str, Family] = {
    "pair": Family(token=_wrapped(">>{}<<"), banned=("<pad>",)),
    "medium": Family(token=_wrapped("__{}__"), before="source", forced=True, drop_invalid_merges=True),
    "small": Family(token=_wrapped("__{}__"), before="target", any_source=True, drop_invalid_merges=True),
    "large": Family(token=nllb_token, before="source", forced=True),
}


def checked_tokenizer(text: str, drop_invalid_merges: bool):
    """The tokenizer of a tokenizer.json; merges whose parts or result aren't in the vocabulary can be left out."""
    from tokenizers import Tokenizer

    if drop_invalid_merges:
        settings = json.loads(text)
        model = settings["model"]
        if model.get("merges"):
            pair = lambda m: m.split(" ") if isinstance(m, str) else m
            model["merges"] = [m for m in model["merges"] if len(p := pair(m)) == 2 and all(x in model["vocab"] for x in (*p, "".join(p)))]
            text = json.dumps(settings)
    return Tokenizer.from_str(text)


@dataclass
class Memory:
    """What the encoder made of a batch, and the decoder's keys and values so far for the rows that are live."""

    hidden: np.ndarray
    mask: np.ndarray
    rows: np.ndarray
    past: dict[str, np.ndarray] = field(default_factory=dict)


class OnnxDecoder(Decoder):
    def __init__(self, folder: str | Path, family: str, precision: str = "fp32", *, threads: int = 1, codes: dict[str, str] | None = None) -> None:
        folder, self.family = Path(folder), FAMILIES[family]
        names = model_files(family, precision)
        if lost := [n for n in names if not (folder / n).exists()]:
            raise FileNotFoundError(f"{folder} lacks {', '.join(lost)}")
        config = json.loads((folder / "config.json").read_text())
        self.tokenizer = checked_tokenizer((folder / "tokenizer.json").read_text(), self.family.drop_invalid_merges)
        self.codes = codes or {}
        self.start, self.end, self.limit = config["decoder_start_token_id"], config["eos_token_id"], int(config.get("max_length", 512))
        self.prefix = config.get("target_prefix", False)
        self.encoder, self.decoder = (session(folder / n, threads) for n in names[:2])
        self.encoder_inputs = {i.name for i in self.encoder.get_inputs()}
        self.decoder_inputs = {i.name: i for i in self.decoder.get_inputs()}
        self.outputs = [o.name for o in self.decoder.get_outputs()]
        self.cached = [n for n in self.decoder_inputs if n.startswith("past_key_values")]

    def language(self, code: str | None) -> int | None:
        if code is None:
            return None
        token = self.family.token(self.codes.get(code, code), self.tokenizer.token_to_id)
        if token is None and (self.family.before or self.family.forced):
            raise ValueError(f"the model has no token for {code}")
        return token

    def tokenize(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, e.offsets

    def text(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=True)

    def frame(self, ids: list[int], source: str | None, target: str) -> list[int]:
        first = {"source": source, "target": target}.get(self.family.before or "", None)
        if self.family.before is None and self.prefix:
            first = target
        token = self.language(first)
        return [*([] if token is None else [token]), *ids, self.end]

    def forced(self, target: str) -> int | None:
        return self.language(target) if self.family.forced else None

    def banned(self) -> tuple[int, ...]:
        return tuple(i for t in self.family.banned if (i := self.tokenizer.token_to_id(t)) is not None)

    def encode(self, ids: np.ndarray, mask: np.ndarray) -> Memory:
        feed = {"input_ids": ids.astype(np.int64), "attention_mask": mask.astype(np.int64)}
        hidden = self.encoder.run(None, {k: v for k, v in feed.items() if k in self.encoder_inputs})[0]
        return Memory(hidden, mask.astype(np.int64), np.arange(len(ids)))

    def scores(self, memory: Memory, rows: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        ids = prefix.astype(np.int64)
        feed = {"encoder_hidden_states": memory.hidden[rows], "encoder_attention_mask": memory.mask[rows]}
        if self.cached:
            if len(rows) < len(memory.rows):  # finished rows leave
                stay = np.searchsorted(memory.rows, rows)
                memory.past = {k: v[stay] for k, v in memory.past.items()}
                memory.rows = rows
            for name in self.cached:
                shape = [d if isinstance(d, int) else 0 for d in self.decoder_inputs[name].shape]
                feed[name] = memory.past.get(name, np.zeros([len(rows), *shape[1:2], 0, *shape[3:]], dtype=np.float32))
            if memory.past:
                ids = ids[:, -1:]
            feed["use_cache_branch"] = np.array([bool(memory.past)])
        feed["input_ids"] = ids
        out = dict(zip(self.outputs, self.decoder.run(None, {k: v for k, v in feed.items() if k in self.decoder_inputs}), strict=True))
        for name in self.cached:
            new = out[name.replace("past_key_values", "present")]
            if new.shape[2] or name not in memory.past:  # the encoder's part comes once and stays
                memory.past[name] = new
        return out["logits"][:, -1]


def onnx_translator(folder: str, family: str, precision: str = "fp32", *, sources=None, targets=None, limit: int = 2, **options) -> Seq2Seq:
    """A translator over a folder, opened once on each worker and held in its pool."""
    codes, threads = options.pop("codes", None), options.pop("threads", 1)

    class Lazy(Seq2Seq):
        @property
        def decoder(self):
            return worker_pool(limit).get(f"{folder}:{precision}", lambda: OnnxDecoder(folder, family, precision, threads=threads, codes=codes))

        @decoder.setter
        def decoder(self, _) -> None:
            pass

    name = f"{family}-{precision}-{re.sub(r'[^A-Za-z0-9]+', '-', Path(folder).name)}"
    return Lazy(None, name, None if FAMILIES[family].any_source else sources, targets, **options)
