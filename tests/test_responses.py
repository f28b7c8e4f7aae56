"""Response codes against a plain reading of the checks, on generated payloads and streams."""


import json
import random

import pytest

from loadlens.operators import responses
from loadlens.sources import files
from tests.test_strict_json import plain

OK = ("stop", "length", "content_filter")
is_int = lambda x: isinstance(x, int) and not isinstance(x, bool)
said = lambda x: isinstance(x, str) and x.strip() != ""


def usage_code(u):
    if not isinstance(u, dict):
        return "missing_usage"
    for name, least in (("completion_tokens", 1), ("prompt_tokens", 0)):
        if not (is_int(u.get(name)) and u[name] >= least):
            return f"invalid_{name}"
    return None


def plain_payload(body, cap):
    ok, p = plain(body)
    choices = p.get("choices") if isinstance(p, dict) else None
    choice = choices[0] if isinstance(choices, list) and len(choices) == 1 else None
    of = choice if isinstance(choice, dict) else {}
    message = of.get("message") if isinstance(of.get("message"), dict) else {}
    checks = [
        (not ok, "invalid_json"), (not isinstance(p, dict), "response_not_object"), (isinstance(p, dict) and "error" in p, "error_response_shape"), (not isinstance(choices, list) or len(choices) != 1, "missing_or_empty_choices"), (not isinstance(choice, dict), "choice_not_object"),
        (of.get("index") != 0, "invalid_choice_index"), (not said(of.get("finish_reason")), "missing_finish_reason"), (of.get("finish_reason") not in OK, "unsupported_finish_reason"), (not isinstance(of.get("message"), dict), "missing_assistant_message"), (message.get("role") != "assistant", "invalid_assistant_role"),
        (not said(message.get("content")), "empty_completion_output"),
    ]
    code = next((c for bad, c in checks if bad), None) or usage_code(p.get("usage"))
    return code or ("reported_completion_tokens_exceed_request_cap" if p["usage"]["completion_tokens"] > cap else None)


def obj(rng, **fields):
    """JSON of an object whose fields are texts of JSON; None leaves one out."""
    return "{" + ",".join(f'"{k}":{v}' for k, v in fields.items() if v is not None) + "}"


def pick(rng, usual, *odd, p=0.12):
    return rng.choice(odd) if rng.random() < p else usual


def payload(rng):
    message = obj(rng, role=pick(rng, '"assistant"', '"user"', "null", None, "5", p=0.1), content=pick(rng, '"NaN x"', '"  "', '""', "5", "null", None, '"\\u2028"', p=0.1))
    choice = obj(rng, index=pick(rng, "0", "0.0", "false", '"0"', "1", "null", None, "-0", "true", p=0.15), finish_reason=pick(rng, '"stop"', '"length"', '"tool_calls"', '" "', "null", None, "5", p=0.15), message=pick(rng, message, "null", None, "[]", p=0.06))
    usage = obj(rng, prompt_tokens=pick(rng, "0", "-1", "true", "1.0", None, p=0.1), completion_tokens=pick(rng, "2", "0", "9", "true", '"2"', "2.0", "10000000000000000000000", None, p=0.15))
    choices = pick(rng, f"[{choice}]", "[]", f"[{choice},{choice}]", "[5]", "{}", "null", None, "[null]", p=0.1)
    body = obj(rng, choices=choices, usage=pick(rng, usage, "null", None, "[]", p=0.06), error=pick(rng, None, "null", '"x"', p=0.05))
    return pick(rng, body, "[]", "5", "{", body + "x", "null", p=0.04)


def test_payload_codes_are_those_of_a_plain_reading(spark):
    rng = random.Random(3)
    bodies = [payload(rng) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").repartition(4)
    got = {r["i"]: r["c"] for r in df.select("i", responses.payload_code("b", max_tokens=8).alias("c")).collect()}
    want = [plain_payload(b, 8) for b in bodies]
    assert len(set(want)) == 16  # every code, and none
    assert [(bodies[i], got[i], w) for i, w in enumerate(want) if got[i] != w] == []


def plain_stream(events, cap):
    seen, tokens = set(), None
    for data in events:
        if data == "[DONE]":
            if "done" in seen:
                return "duplicate_stream_done"
            seen.add("done")
            continue
        if "done" in seen:
            return "stream_data_after_done"
        ok, e = plain(data)
        for bad, code in ((not ok, "malformed_stream_json"), (not isinstance(e, dict), "stream_event_not_object"), (isinstance(e, dict) and "error" in e, "stream_error_event")):
            if bad:
                return code
        counts, choices = e.get("usage"), e.get("choices")
        if counts is not None:
            code = "duplicate_stream_usage" if "usage" in seen else "stream_usage_before_finish" if "finish" not in seen else usage_code(counts)
            if code:
                return code
            tokens = counts["completion_tokens"]
            seen.add("usage")
        if choices == []:
            if counts is None:
                return "empty_stream_event_without_usage"
            continue
        if counts is not None:
            return "stream_usage_with_choice_data"
        for mark in ("usage", "finish"):
            if mark in seen:
                return f"stream_choice_after_{mark}"
        if not (isinstance(choices, list) and len(choices) == 1 and isinstance(choices[0], dict)):
            return "invalid_stream_choices"
        c = choices[0]
        finish, delta = c.get("finish_reason"), c.get("delta")
        d = delta if isinstance(delta, dict) else {}
        odd = lambda k: d.get(k) is not None and not isinstance(d[k], str)
        for bad, code in (
            (c.get("index") != 0, "invalid_choice_index"), (finish is not None and not said(finish), "invalid_finish_reason"), (finish is not None and finish not in OK, "unsupported_finish_reason"), (not isinstance(delta, dict), "invalid_stream_delta"),
            ("role" in d and d["role"] != "assistant", "invalid_assistant_role"), (odd("content"), "invalid_stream_content_type"), (odd("reasoning_content"), "invalid_stream_reasoning_type"),
        ):
            if bad:
                return code
        seen |= {"role"} if "role" in d else set()
        if said(d.get("content")) or said(d.get("reasoning_content")):
            if "role" not in seen:
                return "output_before_assistant_role"
            seen.add("output")
        seen |= {"finish"} if finish is not None else set()
    for mark, code in (("done", "stream_missing_done"), ("output", "empty_completion_output"), ("finish", "missing_finish_reason"), ("usage", "missing_usage")):
        if mark not in seen:
            return code
    if tokens > cap:
        return "reported_completion_tokens_exceed_request_cap"
    return None if "role" in seen else "missing_assistant_role"


def chunk(rng, delta, finish="null"):
    choice = obj(rng, index=pick(rng, "0", "1", None, '"0"', p=0.02), delta=pick(rng, delta, "null", "5", None, p=0.02), finish_reason=finish)
    return obj(rng, choices=pick(rng, f"[{choice}]", "null", "[5]", f"[{choice},{choice}]", "{}", "[]", None, p=0.03), usage=pick(rng, None, "null", '{"prompt_tokens":1,"completion_tokens":2}', p=0.03), error=pick(rng, None, "null", p=0.01))


def stream(rng):
    usage = obj(rng, prompt_tokens=pick(rng, "3", "-1", '"3"', p=0.05), completion_tokens=pick(rng, "2", "0", "9", "1.5", "true", p=0.1))
    events = [chunk(rng, pick(rng, '{"role":"assistant"}', '{"role":null}', '{"role":"user"}', "{}", p=0.1))]
    events += [chunk(rng, pick(rng, '{"content":"x NaN"}', '{"content":"  "}', '{"content":5}', '{"reasoning_content":"y"}', '{"reasoning_content":[]}', '{"content":null}', '{"role":"assistant","content":"z"}', p=0.2)) for _ in range(rng.randrange(4))]
    events += [chunk(rng, "{}", pick(rng, '"stop"', '"tool_calls"', '" "', "5", "null", p=0.15)), pick(rng, f'{{"choices":[],"usage":{usage}}}', '{"choices":[],"usage":[]}', '{"choices":[]}', f'{{"usage":{usage}}}', p=0.1), "[DONE]"]
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        i, j = rng.randrange(len(events)), rng.randrange(len(events))
        how = rng.randrange(4)
        if how == 0:
            events[i], events[j] = events[j], events[i]
        elif how == 1:
            events.insert(i, events[j])
        elif how == 2 and len(events) > 1:
            del events[i]
        else:
            events[i] = rng.choice(["{", "[]", "5", '{"error":null}', events[i] + "]"])
    return events


def test_stream_codes_are_those_of_a_plain_reading(spark):
    rng = random.Random(11)
    streams = [stream(rng) for _ in range(5000)]
    rows = [(i, n, e) for i, s in enumerate(streams) for n, e in enumerate(s)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "request_id int, seq int, event string")
    got = {r["request_id"]: r["code"] for r in responses.check_streams(df, max_tokens=8).collect()}
    want = [plain_stream(s, 8) for s in streams]
    assert len(set(want)) == 28
    assert [(streams[i], got.get(i), w) for i, w in enumerate(want) if got.get(i) != w] == []


def plain_body(body):
    """Events of a body and whether it breaks off in a line of no kind."""
    lines = body.split("\n")
    events, data = [], []
    for line in (x.rstrip("\r") for x in lines[:-1]):
        if not line and data:
            events.append("\n".join(data))
            data = []
        elif line.startswith("data:"):
            data.append(line[5:].lstrip())
    last = lines[-1].rstrip("\r")
    if last.startswith("data:"):
        data.append(last[5:].lstrip())
    return events + (["\n".join(data)] if data else []), bool(last) and not last.startswith(("data:", ":"))


def test_bodies_are_cut_into_events(spark):
    parts = ["data: a\n", "data:b\n", "\n", "\r\n", ": note\n", "event: x\n", "data:  c d\r\n", "data:\n", "id", "data: [DONE]", "\r"]
    rng = random.Random(2)
    bodies = [""] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string")
    got = {}
    for r in files.sse_events(df, "request_id", "body").orderBy("request_id", "seq").collect():
        got.setdefault(r["request_id"], []).append(r["event"])
    rest = {r["request_id"]: r["x"] for r in df.select("request_id", files.sse_rest(df["body"]).alias("x")).collect()}
    assert [(b, got.get(i, []), rest[i]) for i, b in enumerate(bodies) if (got.get(i, []), rest[i]) != plain_body(b)] == []


def test_whole_bodies(spark):
    good = [json.dumps({"choices": [{"index": 0, "delta": {"role": "assistant", "content": "hi"}}]}), json.dumps({"choices": [{"index": 0, "delta": {}, "finish_reason": "stop"}]}), '{"choices":[],"usage":{"prompt_tokens":1,"completion_tokens":2}}', "[DONE]"]
    body = "".join(f"data: {e}\n\n" for e in good)
    cases = {1: (body, None), 2: (body + "junk", "malformed_sse"), 3: (body + ": x" * 9000, "response_too_large"), 4: ("", "stream_missing_done"), 5: (None, "stream_missing_done"), 6: ("data: {\n\njunk", "malformed_stream_json"), 7: (body.replace("\n", "\r\n"), None), 8: ("junk", "malformed_sse")}
    df = spark.createDataFrame([(i, b) for i, (b, _) in cases.items()], "request_id int, body string")
    got = {r["request_id"]: r["code"] for r in responses.check_stream_bodies(df, max_bytes=9000).collect()}
    assert got == {i: c for i, (_, c) in cases.items()}


@pytest.mark.parametrize("size", [1, 3])
def test_a_long_stream_is_no_array(spark, size):
    rows = spark.range(20000 * size).selectExpr("1 AS request_id", "id AS seq", """'{"choices":[{"index":0,"delta":{"role":"assistant","content":"x"}}]}' AS event""")
    assert responses.check_streams(rows).first()["code"] == "stream_missing_done"
    assert "collect_list" not in responses.check_streams(rows)._jdf.queryExecution().toString()


