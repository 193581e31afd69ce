"""Model opinions for adjudication: any function of text pairs, run as an iterator of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "struct<label:string,confidence:double,reason:string,mode:string>"
#: A model's label below this confidence counts as uncertain.
FLOOR = 0.55
#: Parts of a model's label names and what they stand for.
KINDS = {"entail": "entailment", "contrad": "contradiction", "neutral": "neutral"}
NAMES = {"entailment": "supported", "entails": "supported", "contradiction": "contradicted", "neutral": "unsupported"}


def opinion(load: Callable[[], Callable[[list[tuple[str, str]]], list[tuple[str, float]]]]):
    """A function for adjudicate_pairs(nli=...): adds the column nli from a model.

    load is called once in each Python worker and returns a function from (evidence, claim) pairs to (class, confidence),
    class being one of NAMES; confidences are held to 0..1."""

    def attach(pairs: DataFrame) -> DataFrame:
        names = pairs.columns

        def run(batches):
            model = load()
            for batch in batches:
                said = model(list(zip(batch.column("evidence").to_pylist(), batch.column("claim").to_pylist(), strict=True)))
                rows = []
                for name, sure in said:
                    sure = min(1.0, max(0.0, float(sure)))
                    label = NAMES.get(name.lower(), "uncertain") if sure >= FLOOR else "uncertain"
                    rows.append({"label": label, "confidence": sure, "reason": f"NLI predicts {name.lower()}.", "mode": None})
                kind = pa.struct([("label", pa.string()), ("confidence", pa.float64()), ("reason", pa.string()), ("mode", pa.string())])
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(rows, kind)], [*names, "nli"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
        return pairs.mapInArrow(run, f"{schema}, nli {SCHEMA}")

    return attach


def transformers_model(name: str) -> Callable[[], Callable[[list[tuple[str, str]]], list[tuple[str, float]]]]:
    """A loader for opinion(): a sequence-pair classifier of the transformers library, where that is installed."""

    def load():
        import torch
        from transformers import AutoModelForSequenceClassification, AutoTokenizer

        tokenizer, model = AutoTokenizer.from_pretrained(name), AutoModelForSequenceClassification.from_pretrained(name).eval()
        kinds = {i: next((k for part, k in KINDS.items() if part in label.lower()), label.lower()) for i, label in model.config.id2label.items()}
        if set(KINDS.values()) - set(kinds.values()):
            raise ValueError(f"the model's labels must be {sorted(KINDS.values())}")

        def classify(pairs: list[tuple[str, str]]) -> list[tuple[str, float]]:
            out = []
            for evidence, claim in pairs:
                with torch.inference_mode():
                    shares = torch.softmax(model(**tokenizer(evidence, claim, return_tensors="pt", truncation=True, max_length=512)).logits[0], dim=-1)
                best = int(shares.argmax())
                out.append((kinds[best], round(float(shares[best]), 3)))
            return out

        return classify

    return load


def agreement(judged: DataFrame) -> DataFrame:
    """How often heuristic and model say the same, by label."""
    return judged.groupBy(F.col("heuristic.label").alias("heuristic"), F.col("nli.label").alias("nli")).agg(F.count("*").alias("n"))
