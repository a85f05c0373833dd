"""A detector from a folder with model.onnx, tokenizer.json and config.json (id2label), in Arrow batches.

onnxruntime is needed where the model runs, not to import this. Texts of like length share a batch; a long text is cut
at a blank before it is tokenized, and again in full if the cut left room.
"""

from __future__ import annotations

import json

import numpy as np

CHARS_PER_TOKEN = 8


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def shortened(text: str, max_length: int) -> str:
    """At most max_length * 8 characters, ending at a blank if there is one."""
    limit = max_length * CHARS_PER_TOKEN
    if len(text) <= limit:
        return text
    at = text.rfind(" ", 0, limit + 1)
    return text[: at if at > 0 else limit]


class OnnxClassifier:
    def __init__(self, folder: str, max_length: int = 128, threads: int = 1) -> None:
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads, options.inter_op_num_threads = threads, 1
        options.enable_cpu_mem_arena = False
        self.session = onnxruntime.InferenceSession(f"{folder}/model.onnx", options, providers=["CPUExecutionProvider"])
        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        self.tokenizer.enable_truncation(max_length)
        self.max_length = max_length
        with open(f"{folder}/config.json") as f:
            names = json.load(f)["id2label"]
        self.labels = [names[k] for k in sorted(names, key=int)]
        self.inputs = {i.name for i in self.session.get_inputs()}

    def encoded(self, text: str):
        short = shortened(text, self.max_length)
        found = self.tokenizer.encode(short)
        return found if short == text or found.overflowing else self.tokenizer.encode(text)

    def predict(self, texts: list[str]) -> list[list[tuple[str, float]]]:
        rows = [self.encoded(t).ids for t in texts]
        width = max(map(len, rows), default=0)
        ids = np.array([r + [0] * (width - len(r)) for r in rows], dtype=np.int64)
        feed = {"input_ids": ids, "attention_mask": (np.arange(width)[None] < np.array([len(r) for r in rows])[:, None]).astype(np.int64), "token_type_ids": np.zeros_like(ids)}
        logits = self.session.run(None, {k: v for k, v in feed.items() if k in self.inputs})[0]
        return [list(zip(self.labels, map(float, p), strict=True)) for p in softmax(np.asarray(logits, dtype=np.float64))]


def opener(folder: str, max_length: int = 128, threads: int = 1):
    def open_model():
        import builtins

        held = builtins.__dict__.setdefault("_verbaloom_onnx", {})
        if folder not in held:
            held.clear()
            held[folder] = OnnxClassifier(folder, max_length, threads)
        return held[folder].predict

    return open_model
