"""The connector to a language model: answers for masked conversations, in batches of rows.

Without an address the answer is made in SQL (plans.engine.demo_answer); a client is any function of a list of
{role, content} messages, called on the executors - client() makes one of a chat endpoint."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def answers(client: Callable[[list[dict]], str], retries: int = 2) -> Callable[[Column], Column]:
    """A column function for Engine.chat: the client's answer, or null where it keeps failing."""

    @F.pandas_udf("string")
    def ask(conversations: pd.Series) -> pd.Series:
        out = []
        for messages in conversations:
            said = [{"role": m["role"], "content": m["masked"]} for m in messages]
            text = None
            for _ in range(retries + 1):
                try:
                    text = client(said)
                    break
                except OSError:  # the network's; anything else is a bug to show
                    continue
            out.append(text)
        return pd.Series(out, dtype=object)

    return ask


def client(base_url: str, model: str, key: str = "", stream: bool = False, timeout: float = 30.0, most_bytes: int = 1 << 20) -> Callable[[list[dict]], str]:
    """A client of a chat endpoint: a JSON answer, or with `stream` server-sent events. An answer of more than
    `most_bytes`, another status than 200 and a broken body are errors of the network (OSError)."""

    def ask(messages: list[dict]) -> str:
        body = json.dumps({"model": model, "messages": messages, "stream": stream}).encode()
        head = {"Content-Type": "application/json", "Accept": "text/event-stream" if stream else "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with urllib.request.urlopen(urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", body, head), timeout=timeout) as reply:
            data = reply.read(most_bytes + 1)
        if len(data) > most_bytes:
            raise OSError("the answer is too long")
        try:
            if stream:
                return chunks_to_text(data.decode().splitlines())
            return json.loads(data)["choices"][0]["message"]["content"] or ""
        except (ValueError, LookupError, TypeError) as e:
            raise OSError(f"the answer can't be read: {e}") from e

    return ask


def chunks_to_text(lines: list[str]) -> str:
    """The text of a server-sent event stream of answer deltas."""
    out = []
    for line in lines:
        if line.startswith("data:") and line[5:].strip() != "[DONE]":
            for choice in json.loads(line[5:]).get("choices", []):
                out.append((choice.get("delta") or choice.get("message") or {}).get("content") or "")
    return "".join(out)
