"""A provider of text embeddings from a local ONNX model: tokenise, clip, pad, run, take the first token's vector, normalise."""

from __future__ import annotations

import os

import numpy as np

from kinlink.errors import ConfigError
from kinlink.operators.retrieval import unit_rows


class OnnxProvider:
    """embed(texts) -> unit vectors. The model and its tokenizer are loaded where they are first used, once a process: only the folder's name travels to executors."""

    def __init__(self, model_dir: str, max_length: int = 512, threads: int = 1, load=None):
        self.model_dir, self.max_length, self.threads, self._load, self._ready = model_dir, max_length, threads, load, None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _open(self):
        """(session, tokenizer) from the folder's files."""
        model = next((f"{self.model_dir}/{n}" for n in ("model_int8.onnx", "model.onnx") if os.path.exists(f"{self.model_dir}/{n}")), None)
        if model is None or not os.path.exists(f"{self.model_dir}/tokenizer.json"):
            raise ConfigError("SEMANTIC_PROVIDER_NOT_READY", self.model_dir)
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = self.threads
        tokenizer = Tokenizer.from_file(f"{self.model_dir}/tokenizer.json")
        tokenizer.enable_truncation(self.max_length)
        return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"]), tokenizer

    def embed(self, texts: list[str]) -> np.ndarray:
        self._ready = self._ready or (self._load or self._open)()
        session, tokenizer = self._ready
        if not texts:
            return np.zeros((0, 0), np.float32)
        ids = [e.ids[: self.max_length] for e in tokenizer.encode_batch(texts)]
        feed = {k: np.zeros((len(ids), max(1, max(map(len, ids)))), np.int64) for k in ("input_ids", "attention_mask", "token_type_ids")}
        for i, row in enumerate(ids):
            feed["input_ids"][i, : len(row)] = row
            feed["attention_mask"][i, : len(row)] = 1
        wanted = {x.name for x in session.get_inputs()}
        out = np.asarray(session.run(None, {k: v for k, v in feed.items() if k in wanted})[0], np.float32)
        return unit_rows(out[:, 0])
