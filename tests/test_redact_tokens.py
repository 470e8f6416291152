"""Tokens of nested JSON are as many as its strings and turns, not as its brackets."""

import re

from tidemark.operators.redact import TOKEN


def test_a_way_down_and_a_way_up_are_a_token_each():
    text = '{"a": [' * 40 + '{"x":1,"db_token":{"b":{"c":"s"}}}' + "]}" * 40
    tokens = re.findall(TOKEN, text)
    assert "".join(tokens) == text
    assert len(tokens) == 8, tokens
