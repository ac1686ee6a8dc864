"""Model descriptors, validated on the driver before a plan is built, and the errors of the public API."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


class SpanError(ValueError):
    """Base of the errors; ``status`` is the code in the request envelope."""

    status = 255


class InvalidArgument(SpanError):
    status = 1


class InvalidModel(SpanError):
    status = 2


class InvalidInput(SpanError):
    status = 3


TOKENIZERS = ("wordpiece", "sentencepiece", "bytelevel")
BIASES = ("backgroundStay", "backgroundToStart", "endToBackground", "endToStart", "insideToContinue", "insideToEnd")
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Biases:
    """Added to allowed transitions: O to O, O to B or S, E or S to O, E or S to B or S, B or I to I, B or I to E."""

    background_stay: float = 0.0
    background_to_start: float = 0.0
    end_to_background: float = 0.0
    end_to_start: float = 0.0
    inside_to_continue: float = 0.0
    inside_to_end: float = 0.0


@dataclass(frozen=True)
class DecodeConfig:
    name: str
    labels: tuple[str, ...]
    label_map: dict[str, str]
    threshold: float


@dataclass(frozen=True)
class ModelSpec:
    name: str
    model: str
    tokenizer_kind: str
    tokenizer_file: str
    labels: tuple[str, ...]
    label_map: dict[str, str]
    max_tokens: int
    stride: int
    threshold: float
    title_case: bool = False
    decoder: str = "bio"
    biases: Biases = field(default_factory=Biases)
    inputs: dict[str, str] = field(default_factory=dict)
    output: str = "logits"

    @staticmethod
    def from_json(text: str) -> ModelSpec:
        """Unknown keys at the top are ignored, in the decoder they are errors."""
        try:
            raw = json.loads(text)
            tok = raw["tokenizer"]
            decoder = raw.get("decoder") or {"kind": "bio"}
            if isinstance(decoder, str):
                decoder = {"kind": decoder}
            spec = ModelSpec(raw["name"], raw["model"], tok["kind"], tok["file"], tuple(raw["labels"]), dict(raw["labelMap"]), int(raw["maxTokens"]), int(raw["stride"]), float(raw["threshold"]),
                             bool(raw.get("titleCase", False)), decoder.get("kind"), _biases(decoder), dict(raw.get("inputs", {})), raw.get("output", "logits"))
        except (KeyError, TypeError, json.JSONDecodeError) as e:
            raise InvalidModel(f"model descriptor: {e}") from e
        tokenizer_kind(spec.tokenizer_kind)
        if spec.max_tokens < 3:
            raise InvalidModel("maxTokens must be 3 or more")
        if not spec.labels:
            raise InvalidModel("labels must not be empty")
        if spec.decoder not in ("bio", "bioes-viterbi"):
            raise InvalidModel(f"unknown decoder {spec.decoder}")
        if spec.decoder != "bio":
            bioes_tags(spec.labels)
        return spec

    def decode_config(self) -> DecodeConfig:
        return DecodeConfig(self.name, self.labels, self.label_map, self.threshold)

    def to_json(self) -> str:
        out = {"name": self.name, "model": self.model, "tokenizer": {"kind": self.tokenizer_kind, "file": self.tokenizer_file}, "labels": list(self.labels), "labelMap": self.label_map,
               "maxTokens": self.max_tokens, "stride": self.stride, "threshold": self.threshold, "titleCase": self.title_case, "inputs": self.inputs, "output": self.output}
        if self.decoder != "bio":
            out["decoder"] = {"kind": self.decoder, "biases": dict(zip(BIASES, vars(self.biases).values()))}
        return json.dumps(out)


def _biases(decoder: dict) -> Biases:
    if unknown := set(decoder) - {"kind", "biases"}:
        raise InvalidModel(f"unknown decoder key {sorted(unknown)[0]}")
    given = decoder.get("biases", {})
    if unknown := set(given) - set(BIASES):
        raise InvalidModel(f"unknown bias {sorted(unknown)[0]}")
    return Biases(*[float(given.get(b, 0.0)) for b in BIASES])


def tokenizer_kind(kind: str) -> str:
    if kind not in TOKENIZERS:
        raise InvalidModel(f"unknown tokenizer kind {kind}")
    return kind


def bioes_tags(labels: tuple[str, ...] | list[str]) -> list[tuple[str, str]]:
    """``(tag, name)`` of each label: O, or B, I, E, S with a name."""
    out = []
    for x in labels:
        tag, dash, name = x.partition("-")
        if x == "O":
            out.append(("O", ""))
        elif dash and name and tag in ("B", "I", "E", "S"):
            out.append((tag, name))
        else:
            raise InvalidModel(f"{x} is no BIOES label")
    return out


def parse_request(text: str) -> str:
    """The text of a request envelope; other versions are refused."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as e:
        raise InvalidArgument(f"request: {e}") from e
    if not isinstance(raw, dict) or raw.get("schema_version") != SCHEMA_VERSION:
        raise InvalidArgument("schema_version must be 1")
    if not isinstance(raw.get("text"), str):
        raise InvalidArgument("text is missing")
    return raw["text"]


def response(detections: list[dict]) -> str:
    return json.dumps({"schema_version": SCHEMA_VERSION, "detections": detections}, ensure_ascii=False)
