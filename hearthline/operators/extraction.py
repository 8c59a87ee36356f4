"""Structured extraction from listing texts: inputs, cache, an injected provider, and validation.

The provider is a callable from the input text to a JSON answer; it runs inside tasks, on cache misses
only. What it answers is checked against a fixed shape; unknown fields, values out of range and texts
that are too long make it INVALID_OUTPUT, an exception makes it FAILED."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.sellers import claim_flag

Provider = Callable[[str], str]

# The fields of an answer, and the domains of its values.
LEVELS = {"LOW", "MEDIUM", "HIGH", "UNKNOWN"}
SIGNALS = {"seller_motivation": "level", "negotiability": "level", "cash_preference": "value", "reason_for_sale": "value", "condition": "value"}
LISTS = {"legal_claims", "risk_signals"}
MOST_ITEMS, MOST_EVIDENCE, MOST_TEXT = 12, 8, 500

ANSWERED = "input_hash string, status string, answer string"


def input_hash(*parts: Column) -> Column:
    """A hash of the whole input; null and empty parts differ."""
    told = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("\u0001", *told).cast("binary"), 256)


def cached(inputs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs with a successful cached answer, and one row per input hash without one."""
    known = cache.filter("status = 'SUCCESS'").select("input_hash", "answer").dropDuplicates(["input_hash"])
    return inputs.join(known, "input_hash"), inputs.dropDuplicates(["input_hash"]).join(known, "input_hash", "left_anti")


def flaw(answer: str) -> str | None:
    """What is wrong with an answer, or None."""
    try:
        top = json.loads(answer)
    except ValueError:
        return "not JSON"
    if not isinstance(top, dict) or set(top) - set(SIGNALS) - LISTS or set(SIGNALS) - set(top):
        return "fields"
    for name, key in SIGNALS.items():
        signal = top[name]
        if not isinstance(signal, dict) or set(signal) - {key, "confidence", "evidence"} or key not in signal and key == "level":
            return name
        if key == "level" and signal[key] not in LEVELS or _item_flaw(signal):
            return name
    for name in LISTS:
        items = top.get(name, [])
        if not isinstance(items, list) or len(items) > MOST_ITEMS or any(not isinstance(x, dict) or not x.get("code") or _item_flaw(x) for x in items):
            return name
    return None


def _item_flaw(item: dict) -> bool:
    sure, evidence = item.get("confidence"), item.get("evidence", [])
    if isinstance(sure, bool) or not isinstance(sure, (int, float)) or not 0 <= sure <= 100:
        return True
    return not isinstance(evidence, list) or len(evidence) > MOST_EVIDENCE or any(not isinstance(e, dict) or not 1 <= len(str(e.get("text", ""))) <= MOST_TEXT for e in evidence)


def ask(misses: DataFrame, provider: Provider) -> DataFrame:
    """(input_hash, status, answer) of the provider for every row of (input_hash, input)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["input_hash"], batch["input"], strict=True):
                try:
                    answer = provider(text)
                except Exception as e:  # any failure of the provider is a status, not the job's
                    out.append((key, "FAILED", str(e)))
                else:
                    out.append((key, "INVALID_OUTPUT" if flaw(answer) else "SUCCESS", answer))
            yield pd.DataFrame(out, columns=["input_hash", "status", "answer"])

    return misses.select("input_hash", "input").mapInPandas(run, ANSWERED)


def claims(answers: DataFrame, key: str) -> DataFrame:
    """(key and the fields of a flag) for each claim and risk signal with a code in successful answers."""
    item = "array<struct<code:string,severity:string,confidence:double>>"
    parsed = F.from_json("answer", f"legal_claims {item}, risk_signals {item}")
    both = F.concat(F.coalesce("p.legal_claims", F.array().cast(item)), F.coalesce("p.risk_signals", F.array().cast(item)))
    each = answers.filter("status = 'SUCCESS'").select(key, parsed.alias("p")).select(key, F.explode(both).alias("x"))
    made = claim_flag(F.col("x.code"), F.col("x.severity"), F.col("x.confidence"), F.col(key))
    return each.select(key, made.alias("f")).filter("f is not null").select(key, "f.*")
