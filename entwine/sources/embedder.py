"""Embeddings of texts from a service, in Arrow batches; each distinct text is asked for once."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[list[str]], list[list[float]]]


def http_client(url: str, model: str, timeout: int = 30, retries: int = 2) -> Client:
    """POSTs {texts, model_name} to /embed and reads {embeddings}."""

    def ask(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"texts": texts, "model_name": model}).encode()
        for attempt in range(retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{url}/embed", body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                    got = json.loads(r.read())["embeddings"]
                if len(got) != len(texts):
                    raise ValueError(f"asked for {len(texts)} embeddings, got {len(got)}")
                return got
            except OSError:
                if attempt == retries:
                    raise
                time.sleep(2**attempt)
        raise AssertionError

    return ask


_cache: dict[tuple[str, str], list[float]] = {}


def cached(ask: Client, name: str, size: int) -> Client:
    """Remembers up to `size` embeddings in the process, for the later calls of all tasks that it runs; then takes in no more."""

    def answer(texts: list[str]) -> list[list[float]]:
        new = [t for t in dict.fromkeys(texts) if (name, t) not in _cache]
        got = dict(zip(new, ask(new))) if new else {}
        for t in new[: max(0, size - len(_cache))]:
            _cache[name, t] = got[t]
        return [got[t] if t in got else _cache[name, t] for t in texts]

    return answer


def embed_texts(df: DataFrame, client: Callable[[], Client], dim: int, batch_size: int = 32, text: str = "text", cache_size: int = 0, cache_name: str = "") -> DataFrame:
    """Adds `vector`. client() is called on the executors. Null and empty texts get the zero vector.

    cache_size: how many embeddings each Python process of the executors remembers under cache_name (the model).
    """
    distinct = df.filter(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(text).alias("__t")).distinct()

    def run(batches):
        ask = cached(client(), cache_name, cache_size) if cache_size else client()
        for b in batches:
            texts = b.column(0).to_pylist()
            out = [v for s in range(0, len(texts), batch_size) for v in ask(texts[s : s + batch_size])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["__t", "vector"])

    known = distinct.mapInArrow(run, "__t string, vector array<float>")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    joined = df.drop("vector").join(known, df[text] == known["__t"], "left").drop("__t")
    return joined.withColumn("vector", F.when(F.coalesce(F.col(text), F.lit("")) == "", zero).otherwise(F.col("vector")))


def healthy(url: str, timeout: int = 5) -> bool:
    try:
        with urllib.request.urlopen(f"{url}/health", timeout=timeout) as r:
            return r.status == 200
    except OSError:
        return False
