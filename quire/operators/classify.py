"""Model invocation: prompts, guarded and retried calls, status rows, and resuming.

A model is any callable from a list of prompts to a list of answers; without a network the
deterministic rule-based stub stands in for it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.labels import json_answer, validate

Model = Callable[[list[str]], list[str]]
PROMPT = "Classify the following part of an e-book. Answer with a JSON object with the keys label and subtype.\n\n"


def build_prompt(text: Column, system: str = PROMPT) -> Column:
    return F.concat(F.lit(system), text)


def role_split(text: Column, system: str = PROMPT, lead: str = "") -> Column:
    """The prompt as messages: array of (role, content), the instruction apart from the text."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(lead), text)))


def escape_braces(text: Column) -> Column:
    """For template engines: braces doubled."""
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def rule_stub(prompts: list[str]) -> list[str]:
    """A deterministic classifier by surface rules; its answer has the form of a model's."""
    out = []
    for p in prompts:
        body = p[len(PROMPT):] if p.startswith(PROMPT) else p
        low = body.lower()
        if "<graphic" in low and len(body) < 400:
            label = "cover-image"
        elif low.count("<item") + low.count("<ref") > 4:
            label = "toc"
        elif "isbn" in low or "impressum" in low or "verlag" in low:
            label = "imprint"
        elif len(body) > 1500:
            label = "chapter"
        else:
            label = "unknown"
        out.append(json.dumps({"label": label, "subtype": None}))
    return out


def with_retry(model: Model, tries: int = 5, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Model:
    """The model with exponential back-off; the last error is raised."""

    def call(prompts: list[str]) -> list[str]:
        for k in range(tries):
            try:
                return model(prompts)
            except Exception:
                if k == tries - 1:
                    raise
                sleep(base * 2**k)
        raise AssertionError

    return call


_ANSWER = pa.schema([("id", pa.string()), ("answer", pa.string()), ("status", pa.string()), ("error_message", pa.string())])


def _caller(model: Model, batch: int, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep):
    """pause: seconds between two calls of a task, so that a service isn't called too often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        called = False
        for b in batches:
            ids, prompts = b.column("id").to_pylist(), b.column("prompt").to_pylist()
            rows: list[tuple] = []
            for k in range(0, len(ids), batch):
                part = ids[k : k + batch]
                if pause and called:
                    sleep(pause)
                called = True
                try:
                    rows.extend((i, a, "Success", None) for i, a in zip(part, model(prompts[k : k + batch]), strict=True))
                except Exception as e:  # one failed batch doesn't end the run
                    rows.extend((i, None, "Error", f"batch_error: {e}"[:500]) for i in part)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 4, _ANSWER.types)], schema=_ANSWER)

    return run


def run_model(chunks: DataFrame, model: Model = rule_stub, batch: int = 200, most: int = 100_000, last_brace: bool = False, tries: int = 5, base: float = 1.0, pause: float = 0.0) -> DataFrame:
    """(id, label, subtype, status, error_message) of every distinct chunk id.

    A call that fails is made again up to `tries` times, after base, 2 base, 4 base … seconds; pause is the time
    between the calls of a task.

    Blank text is 'no_text' and text beyond `most` characters 'too_long' without a call; a failed batch is
    'batch_error' and an answer without JSON 'parsing_error'; unknown labels become 'unknown'.
    """
    rows = chunks.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("text").alias("text"))
    guard = F.when(~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)), "no_text").when(F.length("text") > most, "too_long")
    rows = rows.withColumn("guard", guard)
    asked = rows.where("guard IS NULL").select("id", build_prompt(F.col("text")).alias("prompt")).mapInArrow(_caller(with_retry(model, tries, base), batch, pause), "id string, answer string, status string, error_message string")
    parsed = asked.withColumn("j", json_answer(F.col("answer"), last_brace))
    label, subtype = validate(F.get_json_object("j", "$.label"), F.get_json_object("j", "$.subtype"))
    label = F.when(F.col("status") == "Error", "batch_error").when(F.col("j").isNull(), "parsing_error").otherwise(label)
    done = parsed.select("id", label.alias("label"), F.when(F.col("j").isNotNull(), subtype).alias("subtype"), "status", "error_message")
    none = F.lit(None).cast("string")
    return done.unionByName(rows.where("guard IS NOT NULL").select("id", F.col("guard").alias("label"), none.alias("subtype"), F.lit("Skipped").alias("status"), none.alias("error_message")))


def pending(chunks: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Chunks without a result yet; a sentinel is a result and isn't retried."""
    return chunks.join(results.select(key).distinct(), key, "left_anti")


def run_log(results: DataFrame, stamp: Column) -> DataFrame:
    """Status rows of a run, all strings."""
    cols = [stamp.alias("timestamp"), F.col("id").alias("chunk_id"), "status", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("label", "error_message"))]
    return results.select(*(F.col(c) if isinstance(c, str) else c for c in cols))


def context_check(prompts: DataFrame, most: int, tokens: Callable[[Column], Column]) -> DataFrame:
    """Prompts with a flag where they exceed the context; they are sent all the same."""
    return prompts.withColumn("over_context", tokens(F.col("prompt")) > most)


def batch_token_stats(rows: DataFrame, tokens: Column, batch: Column) -> DataFrame:
    """Greatest, mean and sum of tokens per batch."""
    return rows.groupBy(batch.alias("batch")).agg(F.max(tokens).alias("max_tokens"), F.avg(tokens).alias("avg_tokens"), F.sum(tokens).alias("sum_tokens"))


def models_long(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Wide results as (id, model, label, subtype)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").alias("label"), F.col(f"`{m}_subtype`").alias("subtype")) for m in models)))
    return results.select("id", pairs.alias("p")).select("id", "p.*")
