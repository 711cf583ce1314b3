"""Secrets under JSON keys: lines, log lines, any depth."""

import json

from veilspark.operators import context


def test_json_secrets_in_lines_log_lines_and_deep(spark):
    deep = 400
    rows = [
        (1, '{"password":"hunter22","name":"x"}'),
        (2, '{"token":"first1"}\n{"n":1}\n {"token":"second2"}\n'),
        (3, '[INFO] say "hi: user {"a":[{"api_key":"abc]}123"}]} then [1, {"secret":"tail9"}] and {not json'),
        (4, '{"a":' * deep + '{"password":"deep77"}' + "}" * deep),
        (5, "[[[[ " + '{"password": {"user_token": ["t0k3n", "null", 5]}}'),
        (6, 'log {\n  "client_secret": "multi\\"line"\n}\nend'),
        (7, "2024 plain"), (8, None), (9, ""), (10, '{"password":"open'),
    ]
    found = context.json_secrets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    got = sorted((r.doc_id, r.path, r.key, r.value, r.confidence) for r in found.collect())
    at = {i: t.index("{") for i, t in rows if t and "{" in t}
    assert got == sorted([
        (1, "$.password", "password", "hunter22", "high"),
        (2, "$@0.token", "token", "first1", "high"),
        (2, f"$@{rows[1][1].rindex('{')}.token", "token", "second2", "high"),
        (3, f"$@{at[3]}.a[0].api_key", "api_key", "abc]}123", "high"),
        (3, f"$@{rows[2][1].index('[1,')}[1].secret", "secret", "tail9", "high"),
        (4, "$" + ".a" * deep + ".password", "password", "deep77", "high"),
        (5, "$@5.password.user_token[0]", "user_token", "t0k3n", "medium"),
        (6, "$@4.client_secret", "client_secret", 'multi"line', "high"),
    ])
    assert json.loads(rows[3][1])
