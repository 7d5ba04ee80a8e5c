"""Where models plug in: a callable each for generation and embedding, run once a task over batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame



class Conversation(NamedTuple):
    """A system prompt and messages (role, text), oldest first."""

    system: str
    messages: list[tuple[str, str]]


Generate = Callable[[list[str]], list[str]]
Converse = Callable[[list[Conversation]], list[str]]
Embed = Callable[[list[str]], np.ndarray]


def _replies(df: DataFrame, columns: list[str], ask: Callable[[tuple], object], make: Callable[[], Callable[[list], list[str]]], output: str, retries: int) -> DataFrame:
    """df with the reply to what ask() makes of each row's columns. Empty replies and calls that fail are tried again."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{output}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            asked = [ask(row) for row in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in columns], strict=True)]
            replies, open_ = [""] * len(asked), list(range(len(asked)))
            for attempt in range(retries):
                if not open_:
                    break
                try:
                    answers = model([asked[i] for i in open_])
                except Exception:
                    if attempt + 1 == retries:
                        raise
                    continue
                for i, r in zip(open_, answers, strict=True):
                    replies[i] = r or ""
                open_ = [i for i in open_ if not replies[i].strip()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string())], names=[*b.schema.names, output])

    return df.mapInArrow(run, schema)


def generate(df: DataFrame, prompt: str, make: Callable[[], Generate], output: str = "raw", retries: int = 3) -> DataFrame:
    """df with the reply to each prompt; make() is called once a task. Empty replies and calls that fail are tried again, `retries` times in all; a last failure is raised."""
    return _replies(df, [prompt], lambda row: row[0], make, output, retries)


def converse(df: DataFrame, system: str, messages: str, make: Callable[[], Converse], output: str = "raw", retries: int = 3) -> DataFrame:
    """The same for a model that takes a system prompt and messages (an array of role and text), the last of which it is to answer."""
    return _replies(df, [system, messages], lambda row: Conversation(row[0] or "", [(m["role"], m["text"]) for m in row[1] or []]), make, output, retries)


def healthy(make: Callable[[], Generate], prompt: str = "ping") -> bool:
    """Whether a model can be made and answers one prompt, here on the driver."""
    try:
        return len(make()([prompt])) == 1
    except Exception:
        return False


def embed(df: DataFrame, text: str, make: Callable[[], Embed], output: str = "embedding", batch: int = 64) -> DataFrame:
    """df with unit vectors of its texts, `batch` texts at a time."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{output}` array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            texts, rows = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()], []
            for i in range(0, len(texts), batch):
                v = np.asarray(model(texts[i : i + batch]), dtype=np.float32)
                rows += list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float32()))], names=[*b.schema.names, output])

    return df.mapInArrow(run, schema)


def hashed_words(size: int = 64) -> Embed:
    """A stand-in encoder without a model: signed hashes of words, repeatable everywhere."""

    def one(text: str) -> np.ndarray:
        v = np.zeros(size, np.float32)
        for w in text.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            v[h % size] += 1 if h >> 63 else -1
        return v

    return lambda texts: np.stack([one(t) for t in texts]) if texts else np.zeros((0, size), np.float32)


def letters(size: int = 26) -> Embed:
    """A plainer stand-in: how often each of the first `size` letters occurs, which SQL can count as well."""
    return lambda texts: np.array([[t.lower().count(chr(97 + i)) for i in range(size)] for t in texts], np.float32).reshape(len(texts), size)
