"""Batch calls to a user-supplied model, reply parsing, and spend."""

from __future__ import annotations

import json
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundspan.functions import fixed_values as fv
from groundspan.schemas import JUDGE_DIMENSIONS
from groundspan.staging import join_checked

# Receives dicts with system and messages; returns one dict per request with
# text and, where known, model, input_tokens, output_tokens, usage_cost.
Completer = Callable[[list[dict]], list[dict]]

_REPLY = (
    "request_id string, text string, model string, input_tokens bigint, "
    "output_tokens bigint, usage_cost string, error string"
)


def batch_complete(requests: DataFrame, completer: Completer) -> DataFrame:
    """Run the model over (request_id, system, messages) in Arrow batches.

    A failing batch is retried request by request; what still fails becomes a
    row with ``error`` set, never a failed task.
    """

    def one(request: dict) -> dict:
        try:
            (reply,) = completer([request])
            return reply
        except Exception as exc:  # noqa: BLE001 - recorded in the row
            return {"error": f"{type(exc).__name__}: {exc}"}

    def checked(reply) -> dict:
        """A reply with the fields of the result; what cannot be read becomes its error."""
        try:
            cost = reply.get("usage_cost")
            return {
                "text": reply.get("text"),
                "model": reply.get("model"),
                "input_tokens": int(reply.get("input_tokens") or 0),
                "output_tokens": int(reply.get("output_tokens") or 0),
                "usage_cost": None if cost is None else str(cost),
                "error": reply.get("error"),
            }
        except Exception as exc:  # noqa: BLE001 - recorded in the row
            error = f"unreadable reply: {type(exc).__name__}: {exc}"
            return {"text": None, "model": None, "input_tokens": 0, "output_tokens": 0, "usage_cost": None, "error": error}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = [
                {
                    "system": row.system,
                    "messages": [dict(m) for m in row.messages],
                }
                for row in batch.itertuples()
            ]
            if not asked:
                continue
            try:
                replies = list(completer(asked))
                if len(replies) != len(asked):
                    raise ValueError(f"{len(replies)} replies to {len(asked)} requests")
            except Exception:  # noqa: BLE001 - isolate the failing request
                replies = [one(request) for request in asked]
            rows = pd.DataFrame([checked(reply) for reply in replies])
            rows.insert(0, "request_id", [None if i is None else str(i) for i in batch["request_id"]])
            yield rows

    return requests.select("request_id", "system", "messages").mapInPandas(run, _REPLY)


# --- spend ------------------------------------------------------------------
def price_table(spark: SparkSession) -> DataFrame:
    rows = [(model, i, o) for model, (i, o) in fv.PRICES.items()]
    return spark.createDataFrame(rows, "model string, usd_in double, usd_out double")


def llm_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost_usd``: what the provider reported, else a list-price estimate, else 0."""
    priced = join_checked(calls, prices, "model", "left", salt_by="model")
    estimate = (
        F.col("input_tokens") * F.col("usd_in") + F.col("output_tokens") * F.col("usd_out")
    ) / 1_000_000
    return priced.withColumn(
        "cost_usd",
        F.coalesce(F.col("usage_cost").try_cast("double"), estimate, F.lit(0.0)),
    ).drop("usd_in", "usd_out")


def cost_by(calls: DataFrame, *keys: str) -> DataFrame:
    """Spend per case, role or run; a turn's rewrite call counts like its answer."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


# --- replies that should contain one JSON object ----------------------------
def first_json_object(text: str | None) -> tuple[str | None, str | None]:
    """The text of the first JSON object in a reply, whatever stands around it, or an error."""
    reply = text or ""
    begin = reply.find("{")
    if begin < 0:
        return None, "no JSON object in the reply"
    try:
        _, end = json.JSONDecoder().raw_decode(reply, begin)
    except json.JSONDecodeError as exc:
        return None, f"JSON object cannot be read: {exc}"
    return reply[begin:end], None


def json_reply(text: Column) -> Column:
    """struct<payload, error> of a model reply."""

    @F.pandas_udf("payload string, error string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [first_json_object(t) for t in texts], columns=["payload", "error"]
        )

    return scan(text)


def clamp_score(value: Column) -> Column:
    """Nearest whole score in 1..5 (halves to even); junk becomes 1."""
    number = F.bround(value.try_cast("double"))
    return F.coalesce(
        F.least(F.greatest(number, F.lit(1.0)), F.lit(5.0)), F.lit(1.0)
    ).cast("int")


def judge_parse(replies: DataFrame, text: str = "text") -> DataFrame:
    """Grades out of judge replies; unreadable ones keep an error and NULL grades."""
    raw = replies.withColumn("_json", json_reply(F.col(text)))
    fields = F.from_json("_json.payload", "map<string,string>")
    parsed = raw.withColumn("_fields", fields)
    ok = F.col("_json.error").isNull()
    for name in JUDGE_DIMENSIONS:
        parsed = parsed.withColumn(
            name, F.when(ok, clamp_score(F.try_element_at("_fields", F.lit(name))))
        )
    claims = F.from_json(
        F.try_element_at("_fields", F.lit("unsupported_claims")), "array<string>"
    )
    return (
        parsed.withColumn(
            "unsupported_claims",
            F.coalesce(claims, F.expr("cast(array() as array<string>)")),
        )
        .withColumn(
            "rationale",
            F.when(
                ok,
                F.substring(
                    F.coalesce(F.try_element_at("_fields", F.lit("rationale")), F.lit("")), 1, 600
                ),
            ),
        )
        .withColumn(
            "judge_error",
            F.when(~ok, F.concat(F.lit("unparseable judge output: "), F.col("_json.error"))),
        )
        .drop("_json", "_fields")
    )


def judge_pass(faithfulness: Column, citation: Column, refusal: Column) -> Column:
    """The three trust grades must each reach 4."""
    return F.coalesce(
        (faithfulness >= 4) & (citation >= 4) & (refusal >= 4), F.lit(False)
    )
