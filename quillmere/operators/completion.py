"""Completions by a language model: an interface, a client for chat endpoints, and a judge of answers."""

from __future__ import annotations

import json
import os
import re
import urllib.request
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CompletionError(RuntimeError):
    """The model gave no usable answer."""


class Completion(Protocol):
    def complete(self, prompt: str, system: str | None = None) -> str: ...


class ChatEndpoint:
    """A model behind an HTTP endpoint that takes a list of messages. post can be replaced in tests."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 60.0, post: Callable[[dict], dict] | None = None):
        self.url, self.model, self.key, self.timeout = url.rstrip("/"), model, key, timeout
        self.post = post or self._post

    def _post(self, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)

    def complete(self, prompt: str, system: str | None = None) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        try:
            return self.post({"model": self.model, "messages": messages, "temperature": 0})["choices"][0]["message"]["content"]
        except (OSError, KeyError, IndexError, TypeError, ValueError) as error:
            raise CompletionError(str(error)) from error


def object_in(text: str) -> dict:
    """The object within a reply that may be fenced or surrounded by talk."""
    found = re.search(r"\{.*\}", text, re.S)
    try:
        made = json.loads(found[0]) if found else None
    except ValueError as error:
        raise CompletionError("the reply holds no valid object") from error
    if not isinstance(made, dict):
        raise CompletionError("the reply holds no object")
    return made


def complete_json(model: Completion, prompt: str, system: str | None = None) -> dict:
    return object_in(model.complete(prompt, system))


def create_completion(model: Completion | None = None) -> Completion | None:
    """The given model, else one named by COMPLETION_URL, COMPLETION_MODEL and COMPLETION_KEY, else None."""
    if model is not None or not os.environ.get("COMPLETION_URL"):
        return model
    return ChatEndpoint(os.environ["COMPLETION_URL"], os.environ.get("COMPLETION_MODEL", ""), os.environ.get("COMPLETION_KEY", ""))


JUDGED = {
    "faithfulness": "Evidence:\n{context}\n\nAnswer:\n{answer}\n\nWhich share of the answer's statements does the evidence support? Reply with one object {{\"score\": a number from 0 to 1}}.",
    "relevancy": "Question:\n{question}\n\nAnswer:\n{answer}\n\nHow fully does the answer reply to the question? Reply with one object {{\"score\": a number from 0 to 1}}.",
}


def judged(answers: DataFrame, model: Completion, measures: tuple[str, ...] = ("faithfulness", "relevancy"), context_chars: int = 6000, answer_chars: int = 3000) -> DataFrame:
    """Adds a model's score for each measure to answers (question, answer, context).

    Contexts and answers are cut to what a prompt may hold. A failed or senseless reply gives
    null for that measure alone; scores are kept within 0 and 1. A null answer isn't judged.
    """

    def score(prompt: str) -> float | None:
        try:
            value = float(complete_json(model, prompt)["score"])
        except (CompletionError, KeyError, TypeError, ValueError):
            return None
        return min(1.0, max(0.0, value)) if value == value else None

    def measure(name: str):
        @F.pandas_udf("double")
        def told(question: pd.Series, answer: pd.Series, context: pd.Series) -> pd.Series:
            rows = zip(question, answer, context, strict=True)
            return pd.Series([None if a is None else score(JUDGED[name].format(question=q or "", answer=a[:answer_chars], context=(c or "")[:context_chars])) for q, a, c in rows], dtype="float64")

        return told("question", "answer", "context")

    return answers.withColumns({f"judged_{name}": measure(name) for name in measures})


def generated(questions: DataFrame, model: Completion, grounded: bool = False) -> DataFrame:
    """Adds free_answer: what a model says to a question, with its context as the only source where grounded. Failures give null."""

    @F.pandas_udf("string")
    def said(question: pd.Series, context: pd.Series) -> pd.Series:
        out = []
        for q, c in zip(question, context, strict=True):
            try:
                out.append(None if q is None else model.complete(f"Answer from this text alone:\n{c or ''}\n\n{q}" if grounded else q))
            except CompletionError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return questions.withColumn("free_answer", said("question", "context"))
