"""Backends for the tests."""


def echo():
    return lambda prompts: [p[-1]["content"] for p in prompts]
