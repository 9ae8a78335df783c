"""Lookups of keys in a remote catalogue, in batches of a bounded size, with what went wrong as a column.

A client is a function from up to 50 keys to their records; it may raise. Keys are made canonical and distinct first and
dealt over tasks, so every key is asked for once and no task, nor the driver, sees them all. A chunk that fails is tried
again; one that fails for good gives a row with the error for each of its keys, and the others go on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids

#: Keys per request, requests' pause after a rate limit.
CHUNK = 50
PAUSE_S = 0.26
#: Characters of an error and of an entry's text that are worth keeping.
ERROR_CHARS, TEXT_CHARS = 200, 40

RESULT = "key string, payload string, error string, attempts int"


class LookupFailed(Exception):
    """Something the catalogue answered; retried unless `final`."""

    kind, final = "failed", False


class RateLimited(LookupFailed):
    kind = "rate_limit"


class NotConfigured(LookupFailed):
    kind, final = "not_configured", True


class BadStatus(LookupFailed):
    kind = "status"

    def __init__(self, status: int):
        super().__init__(status)
        self.final = 400 <= status < 500 and status != 429

    def __str__(self) -> str:
        return f"status {self.args[0]}"


def describe(error: BaseException) -> str:
    """kind: message, cut to what is worth keeping."""
    kind = error.kind if isinstance(error, LookupFailed) else type(error).__name__
    return f"{kind}: {error}"[:ERROR_CHARS]


def looked_up(keys: DataFrame, client: Callable[[list[str]], dict[str, str]], key: str = "isbn13", chunk: int = CHUNK, tries: int = 3, pause_s: float = PAUSE_S) -> DataFrame:
    """key, payload, error, attempts of each distinct valid ISBN among the keys, in whatever form they come.

    A key the catalogue doesn't know has neither payload nor error. The answers' keys may have any form of the ISBN.
    KeyboardInterrupt and the like end the task; everything a client raises otherwise is the chunk's error. Null and
    invalid keys are left out. The client is sent to tasks, so it must not hold a connection.
    """
    canonical = keys.select(ids.to_isbn13(F.col(key)).alias("key")).filter("key is not null").distinct()

    def ask(part: list[str]) -> Iterator[tuple]:
        for attempt in range(1, tries + 1):
            try:
                answer = client(part)
            except Exception as e:  # noqa: BLE001  the policy: a failed lookup is a row, not the end of the job
                error, final = describe(e), isinstance(e, LookupFailed) and e.final
                if final or attempt == tries:
                    return [(k, None, error, attempt) for k in part]
                time.sleep(pause_s * attempt)
            else:
                return [(k, answer.get(k), None, attempt) for k in part]

    def run(batches):
        waiting: list[str] = []
        for pdf in batches:
            waiting += pdf["key"].tolist()
            while len(waiting) >= chunk:
                part, waiting = waiting[:chunk], waiting[chunk:]
                yield pd.DataFrame(ask(part), columns=["key", "payload", "error", "attempts"]).astype({"attempts": "int32"})
        if waiting:
            yield pd.DataFrame(ask(waiting), columns=["key", "payload", "error", "attempts"]).astype({"attempts": "int32"})

    return canonical.mapInPandas(run, RESULT)


def recorded(answers: DataFrame, keys: DataFrame, key: str = "isbn13") -> DataFrame:
    """looked_up over a recorded table of answers (key, payload, error): a join, for batch jobs and for tests."""
    canonical = keys.select(ids.to_isbn13(F.col(key)).alias("key")).filter("key is not null").distinct()
    one = answers.select(ids.to_isbn13(F.col("key")).alias("key"), "payload", "error").filter("key is not null")
    one = one.groupBy("key").agg(F.max_by(F.struct("payload", "error"), F.struct(F.col("payload").isNotNull(), "payload")).alias("a"))
    return canonical.join(one, "key", "left").select("key", "a.payload", F.substring("a.error", 1, ERROR_CHARS).alias("error"), F.lit(1).alias("attempts"))


def lookup_log(entries: DataFrame, results: DataFrame) -> DataFrame:
    """entry_id, entry_text, query, hits, error per entry and lookup: what a person reads when nothing was found.

    entries: entry_id, isbn13, raw_text.
    """
    text = F.substring(F.regexp_replace(F.coalesce("raw_text", F.lit("")), "\\s+", " "), 1, TEXT_CHARS)
    asked = entries.select("entry_id", text.alias("entry_text"), ids.to_isbn13(F.col("isbn13")).alias("query")).filter("query is not null")
    return asked.join(results.withColumnRenamed("key", "query"), "query", "left").select("entry_id", "entry_text", "query", F.col("payload").isNotNull().cast("int").alias("hits"), "error")
