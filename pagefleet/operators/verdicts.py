"""Agent requests and answers as data: B8 agent_requests, A9 unwrap_agent_responses,
A10 default_answers, D6 apply_verdicts, I23 verdict, E6 totals, K3 scorer hook.

The reference asks an external agent per item over a transport. Here the
work rows become request envelopes written as data, answers come back as
data (landed files, a default answer file, or a user ``mapInPandas``
scorer), and the join of the two decides every outcome. Failures are rows,
never exceptions: only ``try_*`` functions touch the answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefleet import schemas
from pagefleet.functions import scalar

ColumnOrName = Column | str


def request_id(task: str, key: ColumnOrName) -> Column:
    """A deterministic 32-hex request id from (task, key): a retried task
    produces the same ids, so answers still join."""
    k = F.col(key) if isinstance(key, str) else key
    return F.substring(F.sha2(F.concat_ws("\u0001", F.lit(task), k.cast("string")), 256), 1, 32)


def agent_requests(df: DataFrame, task: str, params: Column, key: str) -> DataFrame:
    """Work rows -> JSON-RPC envelopes ``{jsonrpc: "2.0", id, method: task, params}``."""
    rid = request_id(task, key)
    body = F.to_json(F.struct(
        F.lit(schemas.JSONRPC_VERSION).alias("jsonrpc"), rid.alias("id"), F.lit(task).alias("method"),
        params.alias("params"),
    ))
    return df.select(F.col(key), rid.alias("request_id"), body.alias("body"))


def json_truthy(v: Column) -> Column:
    """Python truthiness of a JSON value (null/false/0/""/[]/{} are falsy)."""
    kind = F.schema_of_variant(v)
    as_text = F.to_json(v)
    return (
        v.isNotNull() & (kind != "VOID")
        & ~((kind == "BOOLEAN") & (as_text == "false"))
        & ~(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") & (as_text.try_cast("double") == 0))
        & ~(kind.startswith("DECIMAL") & (as_text.try_cast("double") == 0))
        & ~((kind == "STRING") & (as_text == '""'))
        & ~(as_text.isin("[]", "{}"))
    )


def unwrap_agent_responses(raw: DataFrame, body: str = "body") -> DataFrame:
    """JSON-RPC response bodies -> ``ok, result (VARIANT object), error``.

    Failures: invalid JSON, a body that is not an object, a truthy ``error``,
    a ``result`` present but not an object. A missing ``result`` is ``{}``.
    """
    v = F.try_parse_json(F.col(body))
    kind = F.schema_of_variant(v)
    err = F.variant_get(v, "$.error", "variant")
    res = F.variant_get(v, "$.result", "variant")
    res_kind = F.schema_of_variant(res)
    error = (
        F.when(v.isNull(), F.lit("agent response was not valid JSON"))
        .when(~kind.startswith("OBJECT"), F.lit("agent response was not a JSON object"))
        .when(json_truthy(err), F.concat(F.lit("agent returned JSON-RPC error: "), F.to_json(err)))
        .when(res.isNotNull() & ~res_kind.startswith("OBJECT"), F.lit("agent JSON-RPC 'result' was not an object"))
    )
    result = F.when(res.isNull(), F.parse_json(F.lit("{}"))).otherwise(res)
    return raw.select(
        "*",
        error.isNull().alias("ok"),
        F.when(error.isNull(), result).alias("result"),
        error.alias("error"),
    )


def default_answers(spark: SparkSession, path: str, task: str) -> DataFrame:
    """A10: one JSON object file used as the answer to every request of a task.

    A missing file, bad JSON or a non-object becomes one failed answer row.
    The result is one row: join it with ``F.broadcast`` (its size is fixed).
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    if not fs.exists(jvm_path):
        return spark.createDataFrame(
            [(task, False, None, f"no answer fixture for task_type={task!r} at {path}")],
            "task string, ok boolean, result_json string, error string",
        ).select("task", "ok", F.lit(None).cast("variant").alias("result"), "error")
    text = spark.read.text(path, wholetext=True)
    v = F.try_parse_json(F.col("value"))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return text.select(
        F.lit(task).alias("task"),
        is_obj.alias("ok"),
        F.when(is_obj, v).alias("result"),
        F.when(v.isNull(), F.lit(f"failed to load answer file {path}"))
        .when(~is_obj, F.lit(f"answer file {path} must contain a JSON object")).alias("error"),
    )


def one_per_request(answers: DataFrame, key: str = "request_id") -> DataFrame:
    """``key, ok, result, error``: an answer that landed more than once counts once, a good one before a failed one.

    Only the repeated requests are reduced (the largest text of a result or
    error among the best); answers that landed once, nearly all of them, pass
    untouched.
    """
    rows = answers.where(F.col(key).isNotNull()).select(F.col(key), F.coalesce("ok", F.lit(False)).alias("ok"), "result", "error")
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(key)
    text = F.struct("ok", F.to_json("result").alias("r"), F.col("error").alias("e"))
    best = rows.join(again, key, "left_semi").groupBy(key).agg(F.max(text).alias("a")).select(
        key, F.col("a.ok").alias("ok"), F.parse_json("a.r").alias("result"), F.col("a.e").alias("error"))
    return rows.join(again, key, "left_anti").unionByName(best)


def apply_verdicts(
    opportunities: DataFrame,
    answers: DataFrame,
    key: str = "request_id",
    min_confidence: float = schemas.MIN_CONFIDENCE,
) -> DataFrame:
    """Pending opportunities ⟕ answers -> outcome rows.

    No or failed answer -> FAILED with the error; an answer failing validation
    (enums, confidence in [0, 1], the layout an object) -> FAILED with the field
    messages; otherwise APPROVED iff confidence >= ``min_confidence`` else
    REJECTED. ``answers``: ``key, ok, result, error``.
    """
    a = one_per_request(answers, key).select(F.col(key).alias("_k"), F.col("ok").alias("_ok"), F.col("result").alias("_r"),
                                             F.col("error").alias("_e"))
    j = opportunities.join(a, F.col(key) == F.col("_k"), "left")
    r = F.col("_r")
    pattern = F.try_variant_get(r, "$.monetization_pattern", "string")
    layout = F.try_variant_get(r, "$.architectural_layout", "string")
    conf_kind = F.schema_of_variant(F.variant_get(r, "$.confidence", "variant"))
    # Absent, the confidence is 0.0 and the layout empty; an explicit null is neither.
    conf = F.when(conf_kind.isNull(), F.lit(0.0)).otherwise(F.try_variant_get(r, "$.confidence", "double"))
    seo = F.variant_get(r, "$.seo_keyword_layout", "variant")
    problems = F.filter(F.array(
        F.when(pattern.isNull() | ~pattern.isin(*schemas.MONETIZATION_PATTERNS),
               F.lit("monetization_pattern: Input should be 'local_lead_generation', 'contextual_affiliation' "
                     "or 'premium_cpc'")),
        F.when(layout.isNull() | ~layout.isin(*schemas.TEMPLATE_TYPES),
               F.lit("architectural_layout: Input should be 'directory' or 'calculator'")),
        F.when(conf_kind.isNull(), F.lit(None))
        .when(conf.isNull() | ~conf_kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*|STRING)$"),
              F.lit(f"confidence: {schemas.MSG_NUMBER}"))
        .when(F.isnan(conf) | (conf < 0), F.lit(f"confidence: {schemas.MSG_GE.format(0)}"))
        .when(conf > 1, F.lit(f"confidence: {schemas.MSG_LE.format(1)}")),
        F.when(~F.schema_of_variant(seo).startswith("OBJECT"),
               F.lit("seo_keyword_layout: Input should be a valid dictionary")),
    ), lambda e: e.isNotNull())
    answered = F.coalesce(F.col("_ok"), F.lit(False))
    error = (
        F.when(F.col("_k").isNull(), F.lit("agent evaluation failed: no answer"))
        .when(~answered, F.concat(F.lit("agent evaluation failed: "), F.coalesce(F.col("_e"), F.lit("unknown"))))
        .when(F.size(problems) > 0, F.array_join(problems, "; "))
    )
    status = F.when(error.isNotNull(), F.lit("FAILED")).otherwise(F.upper(scalar.verdict(conf, min_confidence)))
    ok = error.isNull()
    return j.select(
        *[F.col(c) for c in opportunities.columns],
        status.alias("status"),
        F.when(ok, conf).alias("confidence"),
        F.when(ok, pattern).alias("monetization_pattern"),
        F.when(ok, layout).alias("template_type"),
        F.when(ok, F.try_variant_get(seo, "$.route_pattern", "string")).alias("seo_route_pattern"),
        F.when(ok, F.try_variant_get(seo, "$.high_volume_columns", "array<string>")).alias("seo_high_volume_columns"),
        F.when(ok, F.try_variant_get(seo, "$.sample_routes", "array<string>")).alias("seo_sample_routes"),
        F.when(ok, F.try_variant_get(r, "$.rationale", "string")).alias("rationale"),
        error.alias("error"),
    )


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], key: str, payload: Column,
               task: str) -> DataFrame:
    """K3: answers from a user scorer run inside the tasks (``mapInPandas``).

    ``scorer`` gets a pandas frame ``request_id, params`` (JSON text) and
    returns ``request_id, body`` (JSON-RPC response text); the bodies are
    unwrapped by A9 like any landed answer.
    """
    reqs = df.select(request_id(task, key).alias("request_id"), F.to_json(payload).alias("params"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield scorer(pdf)[["request_id", "body"]]

    return unwrap_agent_responses(reqs.mapInPandas(run, "request_id string, body string"))
