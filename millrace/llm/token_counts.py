"""Token counts: lengths only, by batches of even size, with long texts cut where it is safe."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._arrow import appended, pieces, utf8
from millrace.llm._chunks import ChunkStore

BATCH_BYTES = 1 << 16


def by_bytes(texts: list[bytes], limit: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    """The texts in runs of about ``limit`` bytes."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def cuttable(config: dict) -> bool:
    """Whether texts may be cut at blanks between words: byte-level, and no step sees a whole text."""
    pre = config.get("pre_tokenizer") or {}
    plain = not (config.get("normalizer") or config.get("truncation") or config.get("padding"))
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
    added = all(
        not (t.get("lstrip") or t.get("rstrip")) and not any(c.isspace() for c in t["content"])
        for t in config.get("added_tokens", [])
    )
    return plain and level and not pre.get("add_prefix_space") and added


class Counter:
    """Lengths for one tokeniser file: ``.json`` (tokenizers) or ``.model`` (sentencepiece)."""

    def __init__(self, path: str):
        cuts = False
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._lengths = lambda texts: map(len, self.model.encode(texts, num_threads=1))
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            encode = self.model.encode_batch_fast
            self._lengths = lambda texts: map(len, encode(texts, add_special_tokens=False))
            with open(path, encoding="utf-8") as file:
                cuts = cuttable(json.load(file))
        self.store = ChunkStore(self.lengths, lengths_only=True) if cuts else None

    def lengths(self, texts: list[bytes]) -> list[int]:
        return [
            n for run in by_bytes(texts) for n in self._lengths([t.decode() for t in run])
        ]

    def count(self, texts: pa.Array) -> np.ndarray:
        if self.store:
            return np.diff(self.store.lookup(texts)[1])
        whole = texts.fill_null("").cast(pa.binary()).to_pylist()
        return np.array(self.lengths(whole), np.int64)


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    The numbers are those of the library for the file at ``path`` (which every
    executor can open), with no begin, end or added special tokens; special
    strings inside a text count as its default has it. Texts are cut only for
    byte-level tokenisers, where that provably changes nothing; others get whole
    texts. A null text is empty: 0, 0, false. Nulls elsewhere, ties and repeated
    rows pass through; an existing column of one of the three names is an error.
    No shuffle, and only numbers come back.
    """
    new = [("n_bytes", T.LongType()), ("n_tokens", T.LongType())]
    rest = [f for f in docs.schema.fields if f.name != text]
    clash = {*(n for n, _ in new), "over_limit"} & {f.name for f in rest}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in pieces(batches, text):
            column = batch.column(text)
            yield appended(
                batch.drop_columns([text]),
                n_bytes=pa.array(np.diff(utf8(column)[1])),
                n_tokens=pa.array(counter.count(column)),
            )

    schema = T.StructType([*rest, *(T.StructField(n, t) for n, t in new)])
    return docs.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
