"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import arrow_limits, utf8

#: Characters after which a text is cut at the next safe boundary; UTF-8 bytes of one call of the encoder.
SEGMENT_CHARS, BATCH_BYTES = 1 << 15, 1 << 20
#: A space between two characters that are neither a space nor its stand-in. No piece of the vocabulary goes on from a
#: non-space to a space, so merges never cross here; and the encoder puts a space before each segment, as here in the text.
SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")

_models: dict[int, object] = {}


def _load(model: bytes):
    if (key := hash(model)) not in _models:
        import sentencepiece

        _models[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _models[key]


def segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    """``text`` in parts whose token counts add up to the whole text's; a text without safe boundaries stays whole."""
    out, start = [], 0
    while len(text) - start > size and (cut := SAFE.search(text, start + size)):
        out.append(text[start : cut.start()])
        start = cut.end()
    return [*out, text[start:]]


def check_boundaries(model: bytes) -> None:
    """Fail if a piece of the vocabulary holds a space after a non-space: the cuts would not be safe."""
    sp = _load(model)
    for i in range(sp.get_piece_size()):
        if re.search("[^▁]▁", sp.id_to_piece(i)):
            raise ValueError(f"piece {i} crosses a word boundary")


def _counts(batches: Iterator[pa.RecordBatch], model: bytes, limit: int) -> Iterator[pa.RecordBatch]:
    sp = _load(model)

    def flush(queue: list[tuple[int, str]], tokens: list[int]) -> None:
        for (row, _), ids in zip(queue, sp.encode([s for _, s in queue], num_threads=1), strict=True):
            tokens[row] += len(ids)
        queue.clear()

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        n_bytes, tokens, queue, held = [], [0] * len(ids), [], 0
        for row, value in enumerate(texts):
            text = value.as_py() or ""
            n_bytes.append(len(utf8(text)))
            for s in segments(text):
                queue.append((row, s))
                held += len(utf8(s))
                if held >= BATCH_BYTES:
                    flush(queue, tokens)
                    held = 0
        flush(queue, tokens)
        over = [n > limit for n in tokens]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(df: DataFrame, *, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row of a table with doc_id and text.

    Counts are those of the library on whole texts, without begin and end tokens. The model file (bounded by its
    vocabulary) is read on the driver and travels with the task. Nothing but lengths leaves Python.

    Edge cases: null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows pass through; other columns
    are ignored; an empty table gives an empty result. Long texts are encoded in parts, so memory follows the part.
    """
    arrow_limits(df.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    check_boundaries(model)
    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", "text").mapInArrow(
        lambda batches: _counts(batches, model, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
