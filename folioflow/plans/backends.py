"""What turns a prompt's text into an answer. A backend takes rows and the names of their prompt and text
columns and adds the answer.

``identity`` and ``glossary`` are expressions; ``http`` calls a local generation server from Arrow batches,
one connection a partition. A backend whose answers vary from call to call says so (``varies``): only such
a one is asked again. A null prompt is not sent.
"""

from __future__ import annotations

import http.client as http_client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from folioflow.functions.fixed_values import GLOSSARY
from folioflow.functions.pytext import NAME

URL = "http://localhost:11434"
OPTIONS = {"temperature": 0.2, "num_predict": 4096, "top_p": 0.9}
FIX_OPTIONS = {"temperature": 0.1, "num_predict": 2048, "top_p": 0.9}
TRIES, WAIT, TIMEOUT = 3, 3, 300

Backend = Callable[[DataFrame, str, str, str], DataFrame]


def identity(rows: DataFrame, prompt: str, text: str, out: str) -> DataFrame:
    return rows.withColumn(out, F.col(text))


def glossary_text(text: Column) -> Column:
    """Whole English terms replaced by the glossary's, the longest that fits, in one pass (an extension)."""
    by_letter: dict[str, list[str]] = {}
    for term in sorted(GLOSSARY, key=lambda t: (-len(t), t)):
        by_letter.setdefault(term[0], []).append(term[1:])
    pattern = rf"(?iu)(?<!{NAME})(?:{'|'.join(f'{a}(?:{"|".join(rest)})' for a, rest in by_letter.items())})(?!{NAME})"
    table = F.create_map(*[F.lit(x) for pair in GLOSSARY.items() for x in pair])
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.element_at(table, F.lower(m)), F.lit("")))), "")


def glossary(rows: DataFrame, prompt: str, text: str, out: str) -> DataFrame:
    return rows.withColumn(out, glossary_text(F.col(text)))


def server_ready(model: str, url: str = URL) -> bool:
    """Whether the server answers and lists the model."""
    try:
        urllib.request.urlopen(url, timeout=3)
        with urllib.request.urlopen(f"{url}/api/tags", timeout=5) as answer:
            return any(model in m["name"] for m in json.loads(answer.read()).get("models", []))
    except (OSError, ValueError, KeyError):
        return False


class Client:
    """A connection to a generation server that is kept open between requests and opened anew after an error."""

    def __init__(self, model: str, url: str = URL, options: dict | None = None, tries: int = TRIES, wait: float = WAIT):
        self.model, self.url, self.options, self.tries, self.wait = model, urllib.parse.urlsplit(url), options or OPTIONS, tries, wait
        self.connection: http_client.HTTPConnection | None = None

    def generate(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": False, "options": self.options}).encode()
        for left in reversed(range(self.tries)):
            try:
                if self.connection is None:
                    kind = http_client.HTTPSConnection if self.url.scheme == "https" else http_client.HTTPConnection
                    self.connection = kind(self.url.netloc, timeout=TIMEOUT)
                self.connection.request("POST", f"{self.url.path.rstrip('/')}/api/generate", body, {"Content-Type": "application/json"})
                answer = self.connection.getresponse()
                content = answer.read()
                if answer.status != 200:
                    raise OSError(f"the server answered {answer.status}")
                return json.loads(content).get("response", "")
            except (OSError, http_client.HTTPException, ValueError):
                self.close()
                if not left:
                    raise
                time.sleep(self.wait)
        return ""

    def close(self) -> None:
        if self.connection is not None:
            self.connection.close()
        self.connection = None


def http(model: str, url: str = URL, options: dict | None = None, lenient: bool = False) -> Backend:
    """A backend on a generation server; the answer is cleaned by the caller. ``lenient``: a request that
    fails after all tries gives null; else it ends the job."""

    def run(rows: DataFrame, prompt: str, text: str, out: str) -> DataFrame:
        place = rows.columns.index(prompt)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = Client(model, url, options)

            def answer(p: str | None) -> str | None:
                try:
                    return None if p is None else client.generate(p)
                except (OSError, http_client.HTTPException, ValueError):
                    if not lenient:
                        raise
                    return None

            for batch in batches:
                answers = pa.array([answer(p) for p in batch.column(place).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, answers], names=[*batch.schema.names, out])
            client.close()

        return rows.mapInArrow(ask, StructType([*rows.schema.fields]).add(out, StringType()))

    run.varies = True
    return run


def generate(prompt: str, model: str, url: str = URL, options: dict | None = None, tries: int = TRIES) -> str:
    """One answer over a connection of its own."""
    client = Client(model, url, options, tries)
    try:
        return client.generate(prompt)
    finally:
        client.close()


def varies(backend: Backend) -> bool:
    return getattr(backend, "varies", False)


BACKENDS: dict[str, Backend] = {"identity": identity, "glossary": glossary}
