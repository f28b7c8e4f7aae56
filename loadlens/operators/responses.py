"""Checks of chat responses: whole payloads, and streams by what their events say and what came before them.

Codes are those of the first check that fails, in a fixed order. Everything is expressed over variants: no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.sources.files import is_blank, json_kind, member, sse_events, sse_rest, strict_json

# Finish reasons of a text answer.
FINISH = ("stop", "length", "content_filter")


def _no(c: Column) -> Column:
    """Whether a condition does not hold; null is no."""
    return ~F.coalesce(c, F.lit(False))


def _said(value: Column) -> Column:
    """Whether a variant is a text that is not blank."""
    return F.coalesce((json_kind(value) == "string") & ~is_blank(value.try_cast("string")), F.lit(False))


def _text(value: Column) -> Column:
    return F.when(json_kind(value) == "string", value.try_cast("string"))


def _zero(value: Column) -> Column:
    """Whether a variant equals zero: a number, or false, which counts as it."""
    kind = json_kind(value)
    return F.coalesce((kind.isin("integer", "number") & (value.try_cast("double") == 0)) | ((kind == "boolean") & ~value.try_cast("boolean")), F.lit(False))


def _usage_code(usage: Column) -> Column:
    """What is wrong with token counts: completion before prompt tokens."""
    count = lambda name: F.when(json_kind(member(usage, name)) == "integer", member(usage, name).try_cast("decimal(38,0)"))
    return F.when(_no(json_kind(usage) == "object"), "missing_usage").when(_no(count("completion_tokens") > 0), "invalid_completion_tokens").when(_no(count("prompt_tokens") >= 0), "invalid_prompt_tokens")


def _completion(usage: Column) -> Column:
    return member(usage, "completion_tokens").try_cast("decimal(38,0)")


def payload_code(body: Column | str, max_tokens: int | None = None, max_bytes: int | None = None) -> Column:
    """First failing code of a whole response body; null if it is a complete answer.

    ``max_tokens`` is what the request asked for at most and ``max_bytes`` the longest body that is read. A null body is no JSON.
    """
    text = F.col(body) if isinstance(body, str) else body
    root = strict_json(text)
    choice = member(root, "choices[0]")
    finish, message, usage = member(choice, "finish_reason"), member(choice, "message"), member(root, "usage")
    code = (
        F.when(F.octet_length(text) > max_bytes, "response_too_large") if max_bytes is not None else F.when(F.lit(False), "response_too_large")
    ).when(root.isNull(), "invalid_json").when(json_kind(root) != "object", "response_not_object").when(member(root, "error").isNotNull(), "error_response_shape")
    code = (
        code.when(_no(json_kind(member(root, "choices")) == "array") | choice.isNull() | member(root, "choices[1]").isNotNull(), "missing_or_empty_choices").when(_no(json_kind(choice) == "object"), "choice_not_object")
        .when(~_zero(member(choice, "index")), "invalid_choice_index").when(~_said(finish), "missing_finish_reason").when(~_text(finish).isin(*FINISH), "unsupported_finish_reason").when(_no(json_kind(message) == "object"), "missing_assistant_message")
        .when(_no(_text(member(message, "role")) == "assistant"), "invalid_assistant_role").when(~_said(member(message, "content")), "empty_completion_output").when(_usage_code(usage).isNotNull(), _usage_code(usage))
    )
    return code if max_tokens is None else code.when(_completion(usage) > max_tokens, "reported_completion_tokens_exceed_request_cap")


def stream_steps(chunks: DataFrame, key: str = "request_id", order: str = "seq", data: str = "event") -> DataFrame:
    """What each event of a stream says by itself: key, order, done, wrong (its own code), usage_wrong, shape (the code of its choice), and the marks role, output, finish, usage, empty and tokens that it leaves."""
    root = F.col("_root")
    choices, choice = member(root, "choices"), member(root, "choices[0]")
    usage, finish, delta = member(root, "usage"), member(choice, "finish_reason"), member(choice, "delta")
    role, content, reasoning = member(delta, "role"), member(delta, "content"), member(delta, "reasoning_content")
    there = lambda v: F.coalesce(json_kind(v) != "null", F.lit(False))
    other = lambda v: there(v) & (json_kind(v) != "string")
    wrong = F.when(root.isNull(), "malformed_stream_json").when(json_kind(root) != "object", "stream_event_not_object").when(member(root, "error").isNotNull(), "stream_error_event")
    shape = (
        F.when(_no(json_kind(choices) == "array") | _no(json_kind(choice) == "object") | member(root, "choices[1]").isNotNull(), "invalid_stream_choices").when(~_zero(member(choice, "index")), "invalid_choice_index")
        .when(there(finish) & ~_said(finish), "invalid_finish_reason").when(there(finish) & ~_text(finish).isin(*FINISH), "unsupported_finish_reason").when(_no(json_kind(delta) == "object"), "invalid_stream_delta")
        .when(role.isNotNull() & _no(_text(role) == "assistant"), "invalid_assistant_role").when(other(content), "invalid_stream_content_type").when(other(reasoning), "invalid_stream_reasoning_type")
    )
    rows = chunks.select(F.col(key), F.col(order), F.col(data).alias("_data")).withColumn("_done", F.coalesce(F.col("_data") == "[DONE]", F.lit(False))).withColumn("_root", strict_json(F.when(~F.col("_done"), F.col("_data"))))
    live = ~F.col("_done")
    has_usage = live & there(usage)
    return rows.select(
        key, order, F.col("_done").alias("done"), F.when(live, wrong).alias("wrong"), F.when(has_usage, _usage_code(usage)).alias("usage_wrong"), F.when(live, shape).alias("shape"), has_usage.alias("usage"),
        (live & F.coalesce((json_kind(choices) == "array") & choice.isNull(), F.lit(False))).alias("empty"), (live & role.isNotNull()).alias("role"), (live & (_said(content) | _said(reasoning))).alias("output"), (live & there(finish)).alias("finish"),
        F.when(has_usage, _completion(usage)).alias("tokens"),
    )


def check_streams(chunks: DataFrame, key: str = "request_id", order: str = "seq", data: str = "event", max_tokens: int | None = None) -> DataFrame:
    """key, code, events and tokens of each stream in a log of chunks; code is null where role, output, finish, usage and the end mark follow each other as they must.

    The marks of a stream only ever go from unseen to seen, so the state before an event is a running maximum over the
    events before it: a window that holds one row at a time, however long a stream is. The first event with a code decides;
    a stream without one is judged by what it never said. Events of equal order are in the order of their data. A null event is malformed.
    """
    steps = stream_steps(chunks, key, order, data)
    before = Window.partitionBy(key).orderBy(order, "done", "finish", "usage").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda mark: F.coalesce(F.max(mark).over(before), F.lit(False))
    state = steps.select("*", *[seen(m).alias(f"_{m}") for m in ("done", "usage", "finish", "role")])
    c = F.col
    sound = F.lit("")
    code = (
        F.when(c("done") & c("_done"), "duplicate_stream_done").when(c("done"), sound).when(c("_done"), "stream_data_after_done").when(c("wrong").isNotNull(), c("wrong"))
        .when(c("usage") & c("_usage"), "duplicate_stream_usage").when(c("usage") & ~c("_finish"), "stream_usage_before_finish").when(c("usage_wrong").isNotNull(), c("usage_wrong"))
        .when(c("empty") & ~c("usage"), "empty_stream_event_without_usage").when(c("empty"), sound).when(c("usage"), "stream_usage_with_choice_data").when(c("_usage"), "stream_choice_after_usage").when(c("_finish"), "stream_choice_after_finish")
        .when(c("shape").isNotNull(), c("shape")).when(c("output") & ~c("_role") & ~c("role"), "output_before_assistant_role")
    )
    judged = state.withColumn("_code", F.nullif(code, sound))
    of = judged.groupBy(key).agg(
        F.min(F.when(c("_code").isNotNull(), F.struct(order, "_code"))).alias("_first"), *[F.max(m).alias(f"_{m}") for m in ("done", "output", "finish", "usage", "role")], F.count("*").alias("events"), F.max("tokens").cast("long").alias("tokens")
    )
    rest = F.when(~c("_done"), "stream_missing_done").when(~c("_output"), "empty_completion_output").when(~c("_finish"), "missing_finish_reason").when(~c("_usage"), "missing_usage")
    if max_tokens is not None:
        rest = rest.when(c("tokens") > max_tokens, "reported_completion_tokens_exceed_request_cap")
    rest = rest.when(~c("_role"), "missing_assistant_role")
    return of.select(key, F.coalesce(c("_first._code"), rest).alias("code"), "events", "tokens")


def check_stream_bodies(bodies: DataFrame, key: str = "request_id", body: str = "body", max_tokens: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """key, code, events and tokens of raw stream bodies: events are cut out and judged; a longer body than ``max_bytes`` is response_too_large, one that breaks off in a line of no kind malformed_sse. A body without events has no end mark."""
    found = check_streams(sse_events(bodies.where(F.col(body).isNotNull()), key, body), key, max_tokens=max_tokens)
    large = F.coalesce(F.octet_length(body) > max_bytes, F.lit(False)) if max_bytes is not None else F.lit(False)
    marks = bodies.select(key, large.alias("_large"), F.coalesce(sse_rest(F.col(body)), F.lit(False)).alias("_rest"))
    # A finding inside the events comes before the broken end; what a stream never said does not count then.
    late = F.col("code").isNull() | F.col("code").isin("stream_missing_done", "empty_completion_output", "missing_finish_reason", "missing_usage", "reported_completion_tokens_exceed_request_cap", "missing_assistant_role")
    code = F.when(F.col("_large"), "response_too_large").when(F.col("_rest") & late, "malformed_sse").when(F.col("events").isNull(), "stream_missing_done").otherwise(F.col("code"))
    return marks.join(found, key, "left").select(key, code.alias("code"), F.coalesce("events", F.lit(0).cast("long")).alias("events"), "tokens")
