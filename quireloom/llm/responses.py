"""What problems 3 and 4 share: the text inside a response, without wrappers, and texts that hold nothing."""

from __future__ import annotations

import re

# Words that stand for an absent text.
ABSENT = ("null", "none", "nil", "n/a", "na", "nan", "undefined", "empty", "无", "空", "暂无", "无内容", "没有")

_FENCE = re.compile(r"\A```[\w-]*[ \t]*\n?(.*?)\n?(?:```)?\Z", re.S)
_QUOTED = re.compile(r"^[ \t]*>[ \t]?", re.M)
#: A short line that announces a text and ends in a colon or a dash.
_ANNOUNCES = re.compile(
    r"\A\s*(?:(?:以下|下面)(?:是|为)[^\n：:。]{0,60}|[^\n：:。，,]{0,8}(?:译文|翻译)(?:如下)?|(?:here is|here's)?[^\n：:.]{0,40}"
    r"(?:translation|translated text|text)[^\n：:.]{0,20}|(?:sure|certainly|of course)[^\n：:.]{0,60})"
    r"\s*(?:[：:]|——)[ \t]*\n*",
    re.I,
)
_EDGES = " \t\r\n​‌‍⁠﻿­‎‏　 "


def unwrap(text: str) -> str:
    """The text without code fences, quote marks before lines and one announcing line."""
    body = text.strip(_EDGES)
    if body.startswith("```"):
        body = _FENCE.match(body).group(1).strip(_EDGES)
    if body.startswith(">"):
        body = _QUOTED.sub("", body).strip(_EDGES)
    return _ANNOUNCES.sub("", body, count=1).strip(_EDGES)


_HOLDS = re.compile(r"[^\W_]", re.U)


def is_empty(body: str) -> bool:
    """Whether an unwrapped text holds nothing: no letter or digit, or only a word for an absent text."""
    if not _HOLDS.search(body):
        return True
    return len(body) <= 12 and re.sub(r"[\W_]+", "", body.replace("/", "")).lower() in {
        re.sub(r"[\W_]+", "", a) for a in ABSENT
    }
