"""A byte-level encoder with a pointer over the options, in numpy, applied to DataFrames through Arrow batches.

Each row is computed on its own, so its result can't depend on the rows beside it. Weights carry the names of the
published checkpoint layout; tests use invented ones.
"""

from __future__ import annotations

import json
import math
import os
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import NUMBERS, shares

PAD, BOS, EOS, SEP, VOCAB = 256, 257, 258, 259, 260
WEIGHT_BYTES = 512 << 20  # broadcast bound


@dataclass(frozen=True)
class Config:
    vocab_size: int = VOCAB
    max_length: int = 1536
    d_model: int = 384
    n_heads: int = 8
    n_layers: int = 6
    d_ff: int = 1536
    pointer_layers: int = 2
    dropout: float = 0.1
    question_slot: int = 108
    option_slot: int = 191


def shapes(c: Config) -> dict[str, tuple[int, ...]]:
    """Name and shape of every weight."""
    d = c.d_model
    out: dict[str, tuple[int, ...]] = {"token_embed.weight": (c.vocab_size, d), "position_embed.weight": (c.max_length, d)}

    def linear(name: str, o: int, i: int, bias: bool = True) -> None:
        out[f"{name}.weight"] = (o, i)
        if bias:
            out[f"{name}.bias"] = (o,)

    def norm(name: str) -> None:
        out.update({f"{name}.weight": (d,), f"{name}.bias": (d,)})

    def attention(name: str) -> None:
        out.update({f"{name}.in_proj_weight": (3 * d, d), f"{name}.in_proj_bias": (3 * d,)})
        linear(f"{name}.out_proj", d, d)

    for n in range(c.n_layers):
        at = f"encoder.layers.{n}"
        attention(f"{at}.self_attn")
        linear(f"{at}.linear1", c.d_ff, d)
        linear(f"{at}.linear2", d, c.d_ff)
        norm(f"{at}.norm1")
        norm(f"{at}.norm2")
    norm("encoder_norm")
    for name in ("state_proj", "q_proj", "opt_proj", "ptr_query"):
        linear(f"pointer.{name}", d, d)
    linear("pointer.ptr_key", d, d, bias=False)
    out["pointer.ptr_bias"] = (1,)
    for n in range(c.pointer_layers):
        at = f"pointer.blocks.{n}"
        attention(f"{at}.cross")
        attention(f"{at}.set_attn")
        linear(f"{at}.ff.0", 4 * d, d)
        linear(f"{at}.ff.3", d, 4 * d)
        for name in ("ln_cross", "ln_set", "ln_ff"):
            norm(f"{at}.{name}")
    for name in ("state_ln", "ln_out", "unknown_ln"):
        norm(f"pointer.{name}")
    linear("pointer.unknown.0", d, d)
    linear("pointer.unknown.2", 1, d)
    return out


def parameters(c: Config) -> int:
    return sum(math.prod(s) for s in shapes(c).values())


def _erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    p = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - p * np.exp(-x * x))


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def encode(text: str, limit: int) -> list[int]:
    if limit < 2:
        raise ValueError("no room for the marks")
    return [BOS, *text.encode()[: limit - 2], EOS]


class Model:
    def __init__(self, config: Config, weights: dict[str, np.ndarray]):
        want = shapes(config)
        if missing := want.keys() ^ weights.keys():
            raise KeyError(f"weights don't match the configuration: {sorted(missing)[:5]}")
        self.config = config
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}
        for k, s in want.items():
            if self.w[k].shape != s:
                raise ValueError(f"{k}: {self.w[k].shape} instead of {s}")

    def _linear(self, name: str, x: np.ndarray) -> np.ndarray:
        y = x @ self.w[f"{name}.weight"].T
        b = self.w.get(f"{name}.bias")
        return y if b is None else y + b

    def _norm(self, name: str, x: np.ndarray) -> np.ndarray:
        m = x.mean(-1, keepdims=True)
        return (x - m) / np.sqrt(((x - m) ** 2).mean(-1, keepdims=True) + 1e-5) * self.w[f"{name}.weight"] + self.w[f"{name}.bias"]

    def _attend(self, name: str, q: np.ndarray, kv: np.ndarray) -> np.ndarray:
        d, h = self.config.d_model, self.config.n_heads
        w, b = self.w[f"{name}.in_proj_weight"], self.w[f"{name}.in_proj_bias"]
        split = lambda x, i: (x @ w[i * d : (i + 1) * d].T + b[i * d : (i + 1) * d]).reshape(len(x), h, d // h).transpose(1, 0, 2)
        s = split(q, 0) @ split(kv, 1).transpose(0, 2, 1) / math.sqrt(d // h)
        e = np.exp(s - s.max(-1, keepdims=True))
        out = (e / e.sum(-1, keepdims=True)) @ split(kv, 2)
        return self._linear(f"{name}.out_proj", out.transpose(1, 0, 2).reshape(len(q), d))

    def layout(self, state: str, question: str, options: list[str]) -> tuple[np.ndarray, np.ndarray, list[slice]]:
        """Ids and positions of the used slots, and the spans (state, question, options) among them."""
        c = self.config
        ql, sl, ol = shares(c.max_length, len(options), NUMBERS)
        pieces = [encode(state, c.max_length)[-sl:], encode(question, c.max_length)[:ql], *(encode(o, c.max_length)[:ol] for o in options)]
        q_slot = min(ql, max(c.question_slot, len(pieces[1])))
        o_slot = min(ol, max([c.option_slot, *map(len, pieces[2:])]))
        ids, positions, spans, cursor = [], [], [], 0
        for piece, slot in zip(pieces, [sl, q_slot, *[o_slot] * len(options)], strict=True):
            if spans:
                ids.append(SEP)
                positions.append(cursor)
                cursor += 1
            spans.append(slice(len(ids), len(ids) + len(piece)))
            ids += piece
            positions += range(cursor, cursor + len(piece))
            cursor += slot
        return np.array(ids), np.array(positions), spans

    def logits(self, state: str, question: str, options: list[str]) -> np.ndarray:
        """One logit per option, then one for `unknown`. Slots that hold nothing are never computed, which equals masking them."""
        if not options:
            raise ValueError("no options, no logits")
        ids, positions, (s, q, *o) = self.layout(state, question, options)
        x = self.w["token_embed.weight"][ids] + self.w["position_embed.weight"][positions]
        for n in range(self.config.n_layers):
            at = f"encoder.layers.{n}"
            h = self._norm(f"{at}.norm1", x)
            x = x + self._attend(f"{at}.self_attn", h, h)
            x = x + self._linear(f"{at}.linear2", _gelu(self._linear(f"{at}.linear1", self._norm(f"{at}.norm2", x))))
        x = self._norm("encoder_norm", x)
        memory = self._norm("pointer.state_ln", self._linear("pointer.state_proj", x[s]))
        opt = self._linear("pointer.opt_proj", np.stack([x[k].mean(0) for k in o]))
        query = self._linear("pointer.q_proj", x[q].mean(0, keepdims=True))
        y = opt + query
        for n in range(self.config.pointer_layers):
            at = f"pointer.blocks.{n}"
            y = y + self._attend(f"{at}.cross", self._norm(f"{at}.ln_cross", y), memory)
            h = self._norm(f"{at}.ln_set", y)
            y = y + self._attend(f"{at}.set_attn", h, h)
            y = y + self._linear(f"{at}.ff.3", _gelu(self._linear(f"{at}.ff.0", self._norm(f"{at}.ln_ff", y))))
        context = self._norm("pointer.ln_out", y)
        scores = (self._linear("pointer.ptr_query", context) * self._linear("pointer.ptr_key", opt)).sum(-1) * self.config.d_model**-0.5 + self.w["pointer.ptr_bias"]
        summary = memory.mean(0) + context.mean(0) + query[0]
        unknown = self._linear("pointer.unknown.2", _gelu(self._linear("pointer.unknown.0", self._norm("pointer.unknown_ln", summary))))
        return np.concatenate([scores, unknown])


def forced(logits: np.ndarray) -> np.ndarray:
    """Probabilities of the options alone: `unknown` is left out."""
    e = np.exp(logits[:-1] - logits[:-1].max())
    return e / e.sum()


def random_model(config: Config, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    ones = lambda k: "norm" in k or ".ln_" in k or "_ln." in k
    return Model(config, {k: np.ones(s) if ones(k) and k.endswith("weight") else np.zeros(s) if k.endswith("bias") else rng.normal(0, 0.02, s) for k, s in shapes(config).items()})


def save(model: Model, folder: str) -> None:
    """config.json and model.safetensors (a length, a JSON header, then raw tensors)."""
    os.makedirs(folder, exist_ok=True)
    header, at = {}, 0
    for k, v in model.w.items():
        header[k] = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [at, at + v.nbytes]}
        at += v.nbytes
    head = json.dumps(header).encode()
    with open(f"{folder}/model.safetensors", "wb") as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for v in model.w.values():
            out.write(np.ascontiguousarray(v).tobytes())
    with open(f"{folder}/config.json", "w", encoding="utf-8") as out:
        out.write(json.dumps(asdict(model.config), indent=2, sort_keys=True) + "\n")


def load(folder: str, max_length: int | None = None) -> Model:
    """A saved model; a longer context keeps the saved positions and starts the new ones at zero."""
    with open(f"{folder}/config.json", encoding="utf-8") as file:
        saved = json.load(file)
    config = Config(**saved | {"max_length": max(saved["max_length"], max_length or 0)})
    with open(f"{folder}/model.safetensors", "rb") as file:
        raw = file.read()
    n = int.from_bytes(raw[:8], "little")
    header = {k: v for k, v in json.loads(raw[8 : 8 + n]).items() if k != "__metadata__"}
    weights = {k: np.frombuffer(raw[8 + n + v["data_offsets"][0] : 8 + n + v["data_offsets"][1]], np.float32).reshape(v["shape"]) for k, v in header.items()}
    positions = weights["position_embed.weight"]
    # A table longer than the context raises here, one of another width in Model.
    weights["position_embed.weight"] = np.pad(positions, ((0, config.max_length - len(positions)), (0, 0)))
    return Model(config, weights)


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """rows (state, question, candidates, ...) with choice and probabilities by option id, rounded to 6 places."""
    size = sum(v.nbytes for v in model.w.values())
    if size > WEIGHT_BYTES:
        raise ValueError(f"{size} bytes of weights exceed the broadcast bound")
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField("choice", T.StringType()), T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType()))])
    place = {n: rows.columns.index(n) for n in ("state", "question", "candidates")}

    def run(batches):
        for b in batches:
            choice, probabilities = [], []
            for s, q, c in zip(*(b.column(place[n]).to_pylist() for n in ("state", "question", "candidates")), strict=True):
                p = forced(sent.value.logits(s, q, [x["text"] for x in c]))
                choice.append(c[int(p.argmax())]["id"])
                probabilities.append([(x["id"], round(float(v), 6)) for x, v in zip(c, p, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(choice, pa.string()), pa.array(probabilities, pa.map_(pa.string(), pa.float64()))], names=[*b.schema.names, "choice", "probabilities"])

    return rows.mapInArrow(run, schema)
