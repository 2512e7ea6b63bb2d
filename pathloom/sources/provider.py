"""Language-model calls as a pluggable, batched and cached provider, and text vectors likewise."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One call for many prompts, in order; None for what a reply lacks.
Call = Callable[[list[str]], "list[str | None]"]
#: A vector for each text, in order.
Encode = Callable[[list[str]], "list[list[float]]"]


def cache_key(prompt: Column, options: dict[str, float | int]) -> Column:
    """SHA-256 of a prompt and its options, in a fixed order."""
    return F.sha2(F.to_json(F.struct(prompt.alias("prompt"), *(F.lit(v).alias(k) for k, v in sorted(options.items())))), 256)


class Caller:
    """Batched calls of one task. A batch gets up to `attempts` calls, each for what is still
    missing; what no call answers goes to `single`, some at once. Once every call of a batch
    has failed, batches are given up for good and all later prompts go to `single` alone.
    Nothing raises: a failure is an empty reply with a reason."""

    def __init__(self, call: Call, single: Callable[[str], str] | None = None, attempts: int = 3, at_once: int = 8):
        self.call, self.single, self.attempts, self.at_once, self.batched = call, single, attempts, at_once, True

    def __call__(self, prompts: list[str]) -> list[tuple[str, str | None]]:
        """(reply, reason) of each prompt; the reason is null where there is a reply."""
        out: list[str | None] = [None] * len(prompts)
        why, worked = "no reply", False
        for _ in range(self.attempts if self.batched else 0):
            todo = [i for i, x in enumerate(out) if x is None]
            if not todo:
                break
            try:
                got = self.call([prompts[i] for i in todo])
            except Exception as failed:  # noqa: BLE001  a provider's failure is data
                why = f"{type(failed).__name__}: {failed}"
                continue
            worked = True
            for i, text in zip(todo, got, strict=False):  # a short reply leaves the rest for the next call
                out[i] = text
        if self.batched and prompts and not worked and self.single is not None:
            self.batched = False

        def alone(i: int) -> tuple[str, str | None]:
            if self.single is None:
                return "", why
            try:
                return self.single(prompts[i]) or "", None
            except Exception as failed:  # noqa: BLE001
                return "", f"{type(failed).__name__}: {failed}"

        said = [(x or "", None) for x in out]
        left = [i for i, x in enumerate(out) if x is None]
        with ThreadPoolExecutor(self.at_once) as pool:
            for i, pair in zip(left, pool.map(alone, left), strict=True):
                said[i] = pair
        return said


def answer_chunk(prompts: list[str], call: Call, single: Callable[[str], str] | None, attempts: int = 3, at_once: int = 8) -> list[str]:
    """The replies to one chunk of prompts; see `Caller`."""
    return [text for text, _ in Caller(call, single, attempts, at_once)(prompts)]


def payload(model: str, messages: list[dict[str, str]], options: dict[str, float | int], most: int, token: str | None = None) -> tuple[dict[str, str], dict]:
    """Headers and body of a chat request."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    return headers, {"model": model, "messages": messages, "max_tokens": most, **options}


def complete(prompts: DataFrame, call: Call, cache: DataFrame | None = None, options: dict | None = None, batch: int = 500, single: Callable[[str], str] | None = None, attempts: int = 3) -> DataFrame:
    """prompt_id, prompt -> prompt_id, key, response, error. Cached responses are joined; of the
    others each distinct prompt goes to `call` once, in batches on the executors; a failure
    gives an empty response and its reason, and doesn't touch other prompts."""
    keyed = prompts.withColumn("key", cache_key(F.col("prompt"), options or {}))
    todo, done = keyed, None
    if cache is not None:
        known = cache.dropDuplicates(["key"])
        done = keyed.join(known.select("key", "response"), "key").select("prompt_id", "key", "response", F.lit(None).cast("string").alias("error"))
        todo = keyed.join(known.select("key"), "key", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(call, single, attempts)
        for part in parts:
            for i in range(0, len(part), batch):
                own = part.iloc[i : i + batch]
                said = caller(own["prompt"].tolist())
                yield own[["key"]].assign(response=[x[0] for x in said], error=[x[1] for x in said])

    said = todo.groupBy("key").agg(F.first("prompt").alias("prompt")).mapInPandas(run, "key string, response string, error string")
    fresh = todo.join(said, "key").select("prompt_id", "key", "response", "error")
    return fresh if done is None else done.unionByName(fresh)


def recorded(responses: DataFrame, prompts: DataFrame, options: dict | None = None) -> DataFrame:
    """The offline provider: recorded responses (key, response), '' where none is known."""
    keyed = prompts.withColumn("key", cache_key(F.col("prompt"), options or {}))
    return keyed.join(responses.dropDuplicates(["key"]), "key", "left").select("prompt_id", "key", F.coalesce("response", F.lit("")).alias("response"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored (key, response); the table may hold a key more than once."""
    return spark.read.schema("key string, response string").parquet(path)


def write_cache(done: DataFrame, path: str) -> None:
    """Appends the responses that say something, a key once."""
    done.where("response <> ''").dropDuplicates(["key"]).select("key", "response").write.mode("append").parquet(path)


def usage(done: DataFrame, prompts: DataFrame) -> DataFrame:
    """One row: calls, empty replies, characters asked and answered."""
    both = done.join(prompts.select("prompt_id", "prompt"), "prompt_id")
    return both.agg(F.count("*").alias("calls"), F.count_if(F.col("response") == "").alias("empty"), F.coalesce(F.sum(F.length("prompt")), F.lit(0)).alias("chars_in"), F.coalesce(F.sum(F.length("response")), F.lit(0)).alias("chars_out"))


def encoded(texts: DataFrame, encode: Encode, batch: int = 256) -> DataFrame:
    """(text, embedding, error) of unit length for distinct texts (text). `encode` runs on the
    executors a batch at a time; where a batch fails its texts are tried one by one, and one
    that fails alone has no vector but a reason."""

    def unit(v: list[float]) -> list[float]:
        size = sum(x * x for x in v) ** 0.5 or 1.0
        return [float(x / size) for x in v]

    def alone(text: str) -> tuple[list[float] | None, str | None]:
        try:
            return unit(encode([text])[0]), None
        except Exception as failed:  # noqa: BLE001  one text's failure is data
            return None, f"{type(failed).__name__}: {failed}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                own = part["text"].iloc[i : i + batch].tolist()
                try:
                    vectors = encode(own)
                    if len(vectors) != len(own):
                        raise ValueError(f"{len(vectors)} vectors for {len(own)} texts")
                    rows = [(unit(v), None) for v in vectors]
                except Exception:  # noqa: BLE001
                    rows = [alone(t) for t in own]
                yield pd.DataFrame({"text": own, "embedding": [r[0] for r in rows], "error": [r[1] for r in rows]})

    return texts.select("text").distinct().mapInPandas(run, "text string, embedding array<float>, error string")


def embed(texts: DataFrame, encode: Encode, known: DataFrame | None = None, batch: int = 256) -> DataFrame:
    """(text, embedding) of unit length for distinct texts; `known` vectors are not made again,
    and texts that can't be encoded are left out."""
    want = texts.select("text").where("text is not null").distinct()
    todo = want if known is None else want.join(known.select("text"), "text", "left_anti")
    fresh = encoded(todo, encode, batch).where("embedding is not null").select("text", "embedding")
    return fresh if known is None else known.select("text", "embedding").join(want, "text", "left_semi").unionByName(fresh)


class VectorStore:
    """Vectors kept by their text's SHA-256 and the encoder's name, in a folder that only grows:
    every run appends what it had to make. Two runs may append the same text; readers take one."""

    def __init__(self, spark: SparkSession, path: str, encoder: str):
        self.spark, self.path, self.encoder = spark, path.rstrip("/"), encoder

    def _rows(self) -> DataFrame:
        schema = "key string, encoder string, embedding array<float>"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def known(self, texts: DataFrame) -> DataFrame:
        """(text, embedding) of the texts that are stored."""
        own = self._rows().where(F.col("encoder") == self.encoder).groupBy("key").agg(F.min("embedding").alias("embedding"))
        return texts.select("text").where("text is not null").distinct().withColumn("key", F.sha2("text", 256)).join(own, "key").select("text", "embedding")

    def embed(self, texts: DataFrame, encode: Encode, batch: int = 256) -> DataFrame:
        """(text, embedding) of all texts; those that aren't stored are encoded, stored, and read
        back, so that a later run finds what this one used."""
        missing = texts.select("text").where("text is not null").distinct().join(self.known(texts), "text", "left_anti")
        fresh = encoded(missing, encode, batch).where("embedding is not null")
        fresh.select(F.sha2("text", 256).alias("key"), F.lit(self.encoder).alias("encoder"), "embedding").write.mode("append").parquet(self.path)
        return self.known(texts)

    def compact(self, path: str, files: int = 1) -> VectorStore:
        """The store with each text once, in a new folder."""
        self._rows().groupBy("encoder", "key").agg(F.min("embedding").alias("embedding")).select("key", "encoder", "embedding").repartition(files, "key").write.parquet(path)
        return VectorStore(self.spark, path, self.encoder)
