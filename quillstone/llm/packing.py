"""Packing along a space-filling curve: neighbours by content share a sequence."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_limits, mix64, shuffle_partitions, tidy, utf8, written

#: Dimensions that document vectors are projected to, and bits of each in the curve's key.
DIMS, BITS = 4, 8
#: Words and chunks of text whose ids a worker keeps; then it starts anew.
MEMO = 3 << 18
#: Ids of one range of the sort, about.
RANGE_IDS = 1 << 22
#: Words joined for one call of the tokenizer.
JOINED = 4096
#: Texts in which the vocabulary's normal form is plain lower case and its words are those of WORD.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ \\t\\n\\r\\x0b\\x0c]*")
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \\t\\n\\r\\x0b\\x0c]+")

#: The pattern of words in the vocabulary's own description (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_loaded: dict[int, tuple] = {}


def _tokenizer(spec: str) -> tuple:
    if (key := hash(spec)) not in _loaded:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(spec)
        bare = Tokenizer.from_str(json.dumps(json.loads(spec) | {"normalizer": None}))
        vocab = tok.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        _loaded[key] = tok, bare, ends, {}
    return _loaded[key]


def check_vocabulary(spec: str) -> None:
    """Fail for a tokenizer whose words are not those that texts are parted into here, or whose ids do not fit 16 bits."""
    read = json.loads(spec)
    steps = [x.get("type") for x in (read.get("normalizer") or {}).get("normalizers", [])]
    parts = (read.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = next((p["pattern"].get("Regex") for p in parts if p.get("type") == "Split"), None)
    model = read["model"]
    if steps != ["NFC", "Replace", "Lowercase"] or pattern != SPLIT or model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or read.get("post_processor"):
        raise ValueError("this tokenizer parts texts into other words")
    if max(model["vocab"].values()) >= 1 << 16 or any(t["id"] >= 1 << 16 for t in read.get("added_tokens", [])):
        raise ValueError("ids beyond 16 bits")


def _learn_words(tok, ends: np.ndarray, words: list[str], memo: dict) -> None:
    """The ids of words, many in one call: white space parts them there, and a word's last id tells that it is the last."""
    for i in range(0, len(words), JOINED):
        some = words[i : i + JOINED]
        ids = np.array(tok.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u2")
        last = np.flatnonzero(ends[ids]) + 1
        if len(last) != len(some):  # not the words of this vocabulary after all: one by one
            memo.update((w, np.array(tok.encode(w, add_special_tokens=False).ids, dtype="<u2").tobytes()) for w in some)
            continue
        raw, at = ids.tobytes(), 0
        for w, end in zip(some, (2 * last).tolist(), strict=True):
            memo[w] = raw[at:end]
            at = end


def token_ids(texts: list[str], spec: str, end_id: int) -> list[bytes]:
    """Each text's ids and ``end_id`` as little-endian unsigned 16-bit integers.

    The vocabulary parts a text into words, drops white space, and encodes words one by one. A plain text is parted here;
    words met before come from the worker's memo, the others go to the tokenizer many at a time. Any other text is parted
    at ASCII white space only, which takes no part in its normal forms, and each chunk goes to the tokenizer as it stands.
    """
    tok, bare, ends, memo = _tokenizer(spec)
    if len(memo) > MEMO:
        memo.clear()
    plain = [PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
    parts = [WORD.findall(t.lower()) if p else utf8(t).split() for t, p in zip(texts, plain, strict=True)]
    new = lambda which: [w for w in set().union(*(x for x, p in zip(parts, plain, strict=True) if p is which)) if w not in memo]
    _learn_words(bare, ends, new(True), memo)
    chunks = new(False)  # bytes, not str
    for i in range(0, len(chunks), JOINED):
        found = tok.encode_batch([c.decode("utf-8", "replace") for c in chunks[i : i + JOINED]], add_special_tokens=False)
        memo.update((c, np.array(e.ids, dtype="<u2").tobytes()) for c, e in zip(chunks[i : i + JOINED], found, strict=True))
    end = end_id.to_bytes(2, "little")
    return [b"".join(map(memo.__getitem__, x)) + end for x in parts]


#: A hash-drawn odd number from -65535 to 65535 of each id on each coordinate.
_DRAWN = 2 * mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)).view("<u2").reshape(-1, DIMS).astype(np.int32) - 65535
#: Texts whose ids are projected at once, about this many of them.
PROJECTED = 1 << 20


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """The Hilbert keys of texts from their ids (with an end id each, which does not count): a hashed bag of ids projected to
    DIMS coordinates.

    A coordinate is the mean of a hash-drawn value of each id, scaled to BITS bits around 0; texts that share their frequent
    ids get near coordinates, and the curve keeps near points near. Sums are of integers. Without ids the key is 0.
    """
    lengths = np.array([len(x) // 2 for x in texts], dtype=np.int64)
    sums, at = np.empty((len(texts), DIMS), dtype=np.int64), 0
    while at < len(texts):
        stop = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), PROJECTED, side="right")))
        ids = np.frombuffer(b"".join(texts[at:stop]), dtype="<u2")
        first = np.cumsum(lengths[at:stop]) - lengths[at:stop]
        sums[at:stop] = np.add.reduceat(_DRAWN[ids], first, axis=0, dtype=np.int64) - _DRAWN[ids[first + lengths[at:stop] - 1]]
        at = stop
    top = (1 << BITS) - 1
    means = sums / np.maximum(lengths - 1, 1)[:, None] / 65535
    points = np.clip((means / 0.25 + 1) / 2 * top, 0, top).astype(np.int64)
    return np.where(lengths > 1, hilbert(points, BITS), 0)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Points' (rows') places on the Hilbert curve through the cube of 2**bits cells a side, by Gray-code rotation per level."""
    n = points.shape[1]
    ranks = np.arange(1 << n)
    gray = ranks ^ (ranks >> 1)
    of_gray = np.argsort(gray)
    enters = np.concatenate([[0], gray[(ranks[1:] - 1) // 2 * 2]])  # the corner where the curve enters a rank's sub-cube
    ones = np.array([int(x ^ (x + 1)).bit_length() - 1 for x in ranks.tolist()])  # trailing ones
    across = np.concatenate([[0], ones[ranks[1:] - (ranks[1:] % 2 == 0)] % n])  # the axis along which it crosses it
    left = lambda x, k: (x << k | x >> (n - k)) & ((1 << n) - 1)
    place, entry, turn = (np.zeros(len(points), dtype=np.int64) for _ in range(3))
    for level in range(bits - 1, -1, -1):
        cell = ((points >> level & 1) << np.arange(n)).sum(axis=1)
        rank = of_gray[left(cell ^ entry, n - (turn + 1) % n)]
        place = place << n | rank
        entry ^= left(enters[rank], (turn + 1) % n)
        turn = (turn + across[rank] + 1) % n
    return place


def _encode(batches: Iterator[pa.RecordBatch], spec: str, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = token_ids([x.as_py() or "" for x in batch.column(1)], spec, end_id)
        keys = curve_keys(ids)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
            ["doc_id", "key", "n", "ids"],
        )


def _run_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row the ids before it in its partition."""
    total = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = total + np.cumsum(n)
        total = int(ends[-1]) if len(ends) else total
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n, pa.int64())], [*batch.schema.names, "at"])


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    for batch in batches:
        ids_of, at_of, docs = batch.column("ids"), batch.column("begin").to_pylist(), batch.column("doc_id").to_pylist()
        rows = []
        for doc, at, packed in zip(docs, at_of, ids_of, strict=True):
            ids = np.frombuffer(packed.as_buffer(), dtype="<u2").astype("<u4")
            start = 0
            while start < len(ids):
                take = min(len(ids) - start, length - (at + start) % length)
                part = ids[start : start + take]
                rows.append((doc, start, take, zlib.crc32(part.tobytes()), len(ids), (at + start) // length, (at + start) % length, part.astype("<u2").tobytes()))
                start += take
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        types = [batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def pack_curve(df: DataFrame, *, tokenizer_path: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Pack the texts of a table with doc_id and text into sequences of ``length`` ids, neighbours on the curve together.

    Returns a row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (16-bit little-endian).
    Texts are encoded once and written; the ids are then range-sorted by curve key and written with running sums. Part
    totals (one number a partition) turn these into places in one endless run of ids, which is cut every ``length`` ids.
    So every sequence but the last is full, no padding, and each row finds its pieces by itself.

    Edge cases: null and empty texts hold the end id alone; null ids and repeated rows are packed like others; a text longer
    than a sequence spans several; an empty table gives an empty result; other columns are ignored; a tokenizer with other
    word rules or with ids beyond 16 bits is refused.
    """
    spark = df.sparkSession
    arrow_limits(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    check_vocabulary(spec)
    kind = dict(df.dtypes)["doc_id"]
    encoded = df.select("doc_id", "text").mapInArrow(lambda b: tidy(_encode(b, spec, end_id)), f"doc_id {kind}, key long, n long, ids binary")
    encoded = written(encoded, "ids")
    # at least as many ranges as hold RANGE_IDS each
    total = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ordered = encoded.repartitionByRange(max(shuffle_partitions(spark), total // RANGE_IDS), "key", F.xxhash64("doc_id", "n"))
    ordered = ordered.sortWithinPartitions("key", F.xxhash64("doc_id", "n"), F.crc32("ids")).withColumn("part", F.spark_partition_id())
    ordered = written(ordered.mapInArrow(lambda b: tidy(_run_starts(b)), f"doc_id {kind}, key long, n long, ids binary, part int, at long"), "run")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row a partition of the sort: bounded by the partition count
    placed = ordered.join(F.broadcast(totals), "part").select("doc_id", (F.col("base") + F.col("at")).alias("begin"), "ids")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return placed.mapInArrow(lambda b: tidy(_pieces(b, length)), schema)
