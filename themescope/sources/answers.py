"""Asks a chat-completion service for each prompt; gives the attempts that ``operators.responses`` resolves.

Write the attempts to a table before use: a lost executor would otherwise send its prompts again.
"""

from __future__ import annotations

import http.client
import json
import logging
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

ATTEMPTS = "row_id long, attempt int, http_status int, body string, exception string"
# Names of the settings of a service.
KEY, MODEL, REFERER, TITLE = "OPENROUTER_API_KEY", "OPENROUTER_MODEL", "HTTP_REFERER", "X_TITLE"

log = logging.getLogger("themescope")


@dataclass(frozen=True)
class Service:
    """An address and its limits; ``pause`` seconds lie between two prompts of one task, ``pace`` between two of the whole run.

    system: told before every prompt.
    """

    url: str
    key: str
    model: str
    system: str | None = None
    referer: str | None = None
    title: str | None = None
    max_tokens: int = 3000
    timeout: float = 60.0
    pause: float = 0.5
    pace: float = 0.0
    attempts: int = 3
    backoff: float = 1.0

    def __post_init__(self) -> None:
        if not self.key:
            raise ValueError("the service needs a key")

    @classmethod
    def from_settings(cls, url: str, settings: Mapping[str, str] | None = None, **limits) -> Service:
        """Key, model, referer and title from the environment, or any other settings; key and model must be there."""
        given = os.environ if settings is None else settings
        for name in (KEY, MODEL):
            if not given.get(name):
                raise ValueError(f"{name} is not set")
        return cls(url, given[KEY], given[MODEL], referer=given.get(REFERER), title=given.get(TITLE), **limits)

    def once(self, prompt: str) -> tuple[int | None, str | None, str | None]:
        """(status, content, exception) of one call."""
        told = [{"role": "system", "content": self.system}] if self.system else []
        asked = {"model": self.model, "messages": [*told, {"role": "user", "content": prompt}], "temperature": 0.0, "max_tokens": self.max_tokens}
        heads = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"} | ({"HTTP-Referer": self.referer} if self.referer else {}) | ({"X-Title": self.title} if self.title else {})
        request = urllib.request.Request(self.url, json.dumps(asked).encode(), heads)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.status, json.load(answer)["choices"][0]["message"]["content"], None
        except urllib.error.HTTPError as e:
            return e.code, None, None
        except (OSError, http.client.HTTPException, ValueError, LookupError, TypeError) as e:
            return None, None, f"{type(e).__name__}: {e}"

    def wait(self, attempt: int, status: int | None, exception: str | None) -> float:
        """Seconds before the next attempt: after a 429, and after an exception or a body that is no answer unless it was the last."""
        return self.backoff * 2**attempt if status == 429 or ((exception or status == 200) and attempt + 1 < self.attempts) else 0.0

    def ask(self, prompt: str) -> Iterator[tuple[int, int | None, str | None, str | None]]:
        """Attempts until a body that is a JSON object; only a 429 and an exception are waited for."""
        for k in range(self.attempts):
            status, body, exception = self.once(prompt)
            yield k, status, body, exception
            if exception is None and status == 200 and is_object(body):
                return
            time.sleep(self.wait(k, status, exception))


def is_object(body: str | None) -> bool:
    body = body or ""
    if body.startswith("```json"):
        body = body.replace("```json", "").replace("```", "")
    try:
        return isinstance(json.loads(body.strip()), dict)
    except ValueError:
        return False


def ask(prompts: DataFrame, service: Service) -> DataFrame:
    """Attempts for (row_id, prompt). Blank descriptions are to be filtered out before.

    With a ``pace``, every task waits so long that all together keep to it: at most as many tasks ask at once as there
    are partitions and cores.
    """
    at_once = max(1, min(prompts.rdd.getNumPartitions(), prompts.sparkSession.sparkContext.defaultParallelism)) if service.pace else 0
    between = max(service.pause, service.pace * at_once)

    def calls(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row_id, prompt in zip(part.row_id, part.prompt, strict=True):
                rows = [(row_id, *a) for a in service.ask(prompt)]
                log.info("row %s: %s attempts", row_id, len(rows))
                out = pd.DataFrame(rows, columns=["row_id", "attempt", "http_status", "body", "exception"])
                yield out.astype({"http_status": "Int32"})
                time.sleep(between)

    return prompts.select("row_id", "prompt").mapInPandas(calls, ATTEMPTS)
