"""Extraction of field values from transcripts.

Three extractors: ``rule_responses`` (patterns by field type, built-in expressions), ``fixture_responses`` (a lookup table) and ``call_model``
(a model behind a callable, in Arrow batches with retries).  Raw responses are normalised by expressions afterwards.

The model is the costly part.  ``extract_cached`` asks only for what the cache table doesn't hold, once for each distinct
(text, field, type, version), and writes the answers before anything reads them, so no plan calls twice.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.text import NOT_FOUND, SEPARATOR, normalize_response

#: What the rule extractor takes for a value, by field type.
RULES = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}",
    "phone": "[+]?[0-9][0-9() -]{6,}[0-9]",
    "number": "[0-9]+(?:[.][0-9]+)?",
    "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "time": "[0-9]{1,2}:[0-9]{2}",
}
#: The model and its endpoint, where nothing else is said.
MODEL, HOST = "mistral", "http://localhost:11434"
ATTEMPTS = 3
TIMEOUT_S = 45


def rule_response(text: Column, type_: Column) -> Column:
    """All matches of the type's pattern, first ones first, with the separator between them; "not found" if there are none."""
    out: Column | None = None
    for name, pattern in RULES.items():
        found = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0), SEPARATOR + " ")
        out = F.when(type_ == name, found) if out is None else out.when(type_ == name, found)
    assert out is not None
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(NOT_FOUND))


def rule_responses(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("response", rule_response(F.col("input_text"), F.col("type")))


def fixture_responses(prompts: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Responses from a table (field, response); a field without one isn't found."""
    return prompts.join(fixtures.select("field", "response"), "field", "left").withColumn("response", F.coalesce("response", F.lit(NOT_FOUND)))


def call_model(prompts: DataFrame, ask: Callable[[str], str], attempts: int = ATTEMPTS, in_flight: int = 1, budget_s: float | None = None) -> DataFrame:
    """``prompts`` with ``response`` and ``error``: ``ask`` gets one prompt; after the last attempt the error is kept beside the row.

    A task has up to ``in_flight`` calls open at once, of one Arrow batch at a time, so it asks for no more rows before these are answered.
    With ``budget_s``, a task starts no call after so many seconds: rows that are left come back with the error ``OutOfTime``, the others with their answers.
    """

    def answer(prompt: str, until: float | None) -> tuple[str | None, str | None]:
        error = None
        for k in range(attempts):
            if until is not None and time.monotonic() >= until:
                return None, f"OutOfTime: after {k} attempts" + (f", {error}" if error else "")
            try:
                return ask(prompt), None
            except Exception as e:  # whatever the client raises belongs to this row alone
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        until = None if budget_s is None else time.monotonic() + budget_s
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                done = list(pool.map(lambda p: answer(p, until), batch.column("prompt").to_pylist()))
                columns = [*batch.columns, pa.array([r for r, _ in done], pa.string()), pa.array([e for _, e in done], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "response", "error"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInArrow(run, f"{types}, response string, error string")


def http_client(host: str | None = None, model: str = MODEL, timeout: float = TIMEOUT_S) -> Callable[[str], str]:
    """``ask`` for a generate endpoint: posts (model, prompt, no streaming), returns the answer's ``response``.  The host is that of the driver's environment if none is given."""
    host = (host or os.environ.get("OLLAMA_HOST") or HOST).rstrip("/")

    def ask(prompt: str) -> str:
        import json
        from urllib.request import Request, urlopen

        body = json.dumps({"model": model, "prompt": prompt, "stream": False}).encode()
        with urlopen(Request(host + "/api/generate", body, {"Content-Type": "application/json"}), timeout=timeout) as r:
            return json.load(r)["response"]

    return ask


def cache_key(version: str) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(version), F.coalesce("field", F.lit("")), F.coalesce("type", F.lit("")), F.sha2(F.coalesce("input_text", F.lit("")), 256)), 256)


def extract_cached(prompts: DataFrame, ask: Callable[[str], str], cache_path: str, version: str, attempts: int = ATTEMPTS, concurrency: int | None = None, in_flight: int = 1, budget_s: float | None = None) -> DataFrame:
    """``prompts`` with ``response`` and ``error``, asking only for what the table at ``cache_path`` lacks.

    Misses are distinct by key and dealt to ``concurrency`` tasks of ``in_flight`` calls each, which bounds how many calls run at once.  Answers are appended to the
    cache; failures are not, so the next run asks again.  A task that is retried may repeat its own calls, never another's.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("cache_key", cache_key(version))
    spark.createDataFrame([], "cache_key string, response string").write.mode("append").parquet(cache_path)
    cache = spark.read.schema("cache_key string, response string").parquet(cache_path)
    misses = keyed.select("cache_key", "prompt").join(cache, "cache_key", "left_anti").dropDuplicates(["cache_key"])
    if concurrency:
        misses = misses.repartition(concurrency, "cache_key")
    run_path = f"{cache_path.rstrip('/')}-runs/{uuid4().hex}"  # of this run alone: earlier results still read theirs
    call_model(misses, ask, attempts, in_flight, budget_s).select("cache_key", "response", "error").write.parquet(run_path)
    run = spark.read.schema("cache_key string, response string, error string").parquet(run_path)
    run.filter("error IS NULL").select("cache_key", "response").write.mode("append").parquet(cache_path)
    known = spark.read.schema("cache_key string, response string").parquet(cache_path).withColumn("error", F.lit(None).cast("string"))
    answers = known.unionByName(run.filter("error IS NOT NULL").select("cache_key", "response", "error"))
    return keyed.join(answers.dropDuplicates(["cache_key"]), "cache_key", "left").drop("cache_key")


def answers(responses: DataFrame) -> DataFrame:
    """(submission_id, template_id, pos, field, is_plural, values) of raw responses."""
    n = normalize_response(F.col("response"))
    return responses.select("submission_id", "template_id", "pos", "field", n["is_plural"].alias("is_plural"), n["values"].alias("values"))


def answers_by_submission(rows: DataFrame) -> DataFrame:
    """One row for each submission with its answers in field order; bounded by the template's number of fields."""
    entry = F.struct("pos", "field", "is_plural", "values")
    return rows.groupBy("submission_id").agg(F.array_sort(F.collect_list(entry)).alias("answers"))


def answers_json(entries: Column) -> Column:
    """A submission's answers as one JSON object: null, a string, or a list."""
    value = lambda e: F.when(e["values"].isNull(), "null").when(e["is_plural"], F.to_json(e["values"])).otherwise(F.regexp_replace(F.to_json(e["values"]), r"^\[|\]$", ""))
    name = lambda e: F.regexp_replace(F.to_json(F.array(e["field"])), r"^\[|\]$", "")
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(name(e), F.lit(": "), value(e))), ", "), F.lit("}"))
