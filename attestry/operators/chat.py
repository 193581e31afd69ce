"""Verdicts of a chat model on claim and evidence, asked over a chat-completions endpoint from the executors."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .evaluate import LABELS

# fixed values: the request's form, the label aliases and the settings' names
BASE, MODEL, KEY = "https://api.openai.com/v1", "gpt-4.1-mini", "OPENAI_API_KEY"
PROMPT = "Classify whether the evidence supports the claim. Return only JSON with label, confidence, and reason. Labels: supported, partially_supported, contradicted, unsupported, uncertain."
ALIASES = {"support": "supported", "refuted": "contradicted", "neutral": "unsupported"}


def request(claim: str, evidence: str, model: str = MODEL) -> dict:
    said = [{"role": "system", "content": PROMPT}, {"role": "user", "content": f"Claim: {claim}\n\nEvidence: {evidence}"}]
    return {"model": model, "temperature": 0, "messages": said}


def reply(content: str) -> tuple[str, float, str]:
    """(label, confidence, reason) of a reply: a JSON object, or one inside other text; an unknown label is uncertain."""
    begin, end = content.find("{"), content.rfind("}")
    if begin < 0 or end < begin:
        raise ValueError("the chat model's reply holds no JSON object")
    found = json.loads(content[begin : end + 1])
    label = str(found.get("label", "uncertain")).strip().casefold().replace("-", "_")
    label = ALIASES.get(label, label)
    return label if label in LABELS else "uncertain", max(0.0, min(1.0, float(found.get("confidence", 0.5)))), str(found.get("reason", ""))


def post(payload: dict, base: str = BASE, timeout: float = 60.0) -> dict:
    headers = {"Authorization": f"Bearer {os.environ[KEY]}", "Content-Type": "application/json"}
    asked = urllib.request.Request(f"{base.rstrip('/')}/chat/completions", json.dumps(payload).encode(), headers, method="POST")
    with urllib.request.urlopen(asked, timeout=timeout) as answer:
        return json.loads(answer.read().decode("utf-8"))


def classified(cases: DataFrame, send: Callable[[dict], dict] | None = None, model: str = MODEL) -> DataFrame:
    """cases (claim, evidence) with predicted, confidence and reason. send: a function from request to answer; without
    one the endpoint is asked, which needs its key in the environment of driver and executors."""
    if send is None and not os.environ.get(KEY):
        raise RuntimeError(f"the raw-llm method needs {KEY}")
    ask, names = send or post, cases.columns

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("claim").to_pylist(), batch.column("evidence").to_pylist(), strict=True)
            said = [reply(str(ask(request(c or "", e or "", model))["choices"][0]["message"]["content"])) for c, e in pairs]
            more = [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()), pa.array([x[2] for x in said], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "predicted", "confidence", "reason"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema)
    return cases.mapInArrow(run, f"{schema}, predicted string, confidence double, reason string")
