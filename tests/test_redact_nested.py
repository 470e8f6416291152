"""Redaction below the top of attributes, against a recursive walk."""

from __future__ import annotations

import json
import random
import re

import pytest
from tidemark.operators import redact
from tidemark.operators.redact import Policy

NAME = re.compile(rf"(?i)^(?:.*[._-])?(?:{'|'.join(redact.SECRET_NAMES)})$", re.S)
PLAIN = re.compile(r"(?i)\b(?:password|token)\s*[=:]\s*[^\s,;&)}\]]+|\b[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")


def walk(value, found: list, key: str | None = None):
    if key is not None and NAME.match(key):
        if value in (None, "", [], {}) and value is not False and value != 0:
            return value
        found.append("secret_kv")
        return "[REDACTED]"
    if isinstance(value, str):
        def put(m):
            found.append("email" if "@" in m[0] else "secret_kv")
            return "[REDACTED:email]" if "@" in m[0] else re.match(r"[^=:]*[=:]\s*", m[0])[0] + "[REDACTED]"

        return PLAIN.sub(put, value)
    if isinstance(value, dict):
        return {k: walk(v, found, k) for k, v in value.items()}
    if isinstance(value, list):
        return [walk(v, found) for v in value]
    return value


def deep(depth: int, inner):
    for i in range(depth):
        inner = {"a": inner} if i % 2 else [inner, i]
    return inner


def made(rng: random.Random, depth: int = 0):
    kind = rng.randrange(9 if depth < 6 else 6)
    if kind < 6:
        return [None, True, -1.5, "", rng.choice(['say "hi" \\ to {x}', "mail a.b@c.org, please", "password=abc", "token: é", "line\nnext", "[1,2]{}:,"]), 0][kind]
    if kind == 6:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    names = ["a", "user", "password", "db_password", "x.Token", "tokens", "my-api_key", 'q"uote', "note", "authorization"]
    return {n: made(rng, depth + 1) for n in rng.sample(names, rng.randrange(4))}


def redacted(spark, values: list, policy: Policy | None = None):
    rows = [(i, json.dumps(v, ensure_ascii=False, separators=(",", ":"))) for i, v in enumerate(values)]
    e = spark.createDataFrame(rows, "id long, v string").selectExpr("id", "'m' message", "'r' raw", "map('detail', v) attributes")
    out = redact.redact_entries(e, policy).selectExpr("id", "attributes.detail v", "redactions").orderBy("id").collect()
    return [(r.v, sorted(r.redactions)) for r in out]


def agree(spark, values: list) -> None:
    for (text, rules), value in zip(redacted(spark, values), values, strict=True):
        found: list[str] = []
        expected = walk(value, found)
        assert json.loads(text) == expected and rules == sorted(found)


def test_any_depth(spark):
    secret = {"token": deep(40, {"x": "s1secret", "y": "s2secret"}), "z": 1}
    agree(spark, [deep(d, secret) for d in (0, 1, 2, 3, 10, 50, 200)])
    leaked = redacted(spark, [secret])[0][0]
    assert leaked == '{"token":"[REDACTED]","z":1}'


def test_trees_as_a_walk_does(spark):
    rng = random.Random(11)
    agree(spark, [made(rng) for _ in range(400)])


def test_values_that_stay(spark):
    agree(spark, [{"password": v} for v in (None, "", [], {}, 0, False, [0], {"a": {}}, "x")] + [[], {}, [[]], [{}], {"a": {"password": [], "token": {"b": []}}}])


def test_blanks_and_long_strings(spark):
    text = '{ "a" : { "password" : { "b" : [ 1 , 2 ] } , "c" : "x" } }'
    e = spark.createDataFrame([(text,)], "v string").selectExpr("'m' message", "'r' raw", "map('detail', v) attributes")
    found = redact.redact_entries(e).selectExpr("attributes.detail v").first().v
    assert json.loads(found) == {"a": {"password": "[REDACTED]", "c": "x"}}
    agree(spark, [{"a": ['\\"\n' * 30_000], "password": "y" * 100_000}, {"list": [{"token": i} for i in range(500)]}])


def test_strings_are_scanned_by_what_they_say(spark):
    e = spark.createDataFrame([('"password=abc"',), ('"a \\"quoted\\" token: x\\ny"',)], "v string").selectExpr("'m' message", "'r' raw", "map('note', v) attributes")
    assert [r.v for r in redact.redact_entries(e).selectExpr("attributes.note v").collect()] == ['"password=[REDACTED]"', '"a \\"quoted\\" token: [REDACTED]\\ny"']


@pytest.mark.parametrize("policy", [Policy(disabled=frozenset(["secret_kv"])), Policy(enabled=False)])
def test_names_follow_the_policy(spark, policy):
    text, rules = redacted(spark, [{"a": {"password": "x", "mail": "a@b.org"}}], policy)[0]
    assert json.loads(text) == {"a": {"password": "x", "mail": "[REDACTED:email]" if policy.enabled else "a@b.org"}} and rules == (["email"] if policy.enabled else [])
