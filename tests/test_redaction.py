"""Redaction of nested values."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quillstone.operators import telemetry as T


def plain(v):
    """The same on parsed values."""
    if isinstance(v, dict):
        return {k: "[REDACTED]" if any(s in k.lower() for s in T.SENSITIVE) else plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, str):
        for pattern, label in T._PYTHON:
            v = pattern.sub(label, v)
    return v


CASES = [
    {"secret": {"value": "hunter2", "deep": [{"a": 1}]}, "password": 12345, "kept": [1, 2.5, None, True]},
    {"a": {"b": [{"My_API_KEY_2": ["x", {"y": "}"}]}, "Bearer abc.def", {"c": "sk-" + "a" * 30}]}},
    {"credential": None, "auth_token": False, "note": "say \"password\": \"no\" and \\", "x": {}, "y": [], "access_token": {}},
    {"password": "p" * 100_000, "more": "q" * 100_000},
    [{"secret": [[[]]]}, "nvapi-" + "z" * 40, "é \t"],
    "Bearer tok", 5, {}, {"k": "\\\"secret\\\": 1"},
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_walk_equals_the_one_on_parsed_values(case, form):
    assert json.loads(T.redacted(json.dumps(CASES[case], **form))) == plain(CASES[case])


def test_what_is_not_hidden_stays_as_written():
    text = ' { "a" : 1.50 , "secret" :  [ 1, {"x":2} ] , "n": 1e5, "u": "\\u00e9" } '
    assert T.redacted(text) == ' { "a" : 1.50 , "secret" :  "[REDACTED]" , "n": 1e5, "u": "\\u00e9" } '


def test_what_is_no_json():
    assert T.redacted('{"password": "x') == '"[REDACTED]"'
    assert T.redacted("plain Bearer abc") == "plain Bearer [REDACTED_TOKEN]"
    assert T.redacted("[" * 200_000 + '"secret"') == '"[REDACTED]"'


def test_long_values_take_no_time():
    for text in ('{"password": "' + '\\"' * 500_000 + '"}', '{"a": "' + "\\\\" * 500_000 + '"}', '{"secret": ' + "[" * 500 + "]" * 500 + "}"):
        began = time.process_time()
        json.loads(T.redacted(text))
        assert time.process_time() - began < 5


def test_sink_masks_structs_maps_and_numbers(spark, tmp_path):
    rows = spark.sql("""SELECT 'r1' AS request_id, named_struct('api_key', named_struct('v', 1), 'list', array(map('password', 7, 'n', 8))) AS details, 12345 AS secret_number,
        'Bearer abc' AS note UNION ALL SELECT NULL, NULL, NULL, NULL""")
    T.write_traces(rows, str(tmp_path / "traces"))
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "traces")).collect())
    assert [json.loads(x) for x in got] == [
        {"request_id": "r1", "details": {"api_key": "[REDACTED]", "list": [{"password": "[REDACTED]", "n": 8}]}, "secret_number": "[REDACTED]", "note": "Bearer [REDACTED_TOKEN]"}, {}
    ]
    assert spark.createDataFrame([(None,)], "x string").select(T.redact_json(F.col("x")).alias("y")).first().y is None
