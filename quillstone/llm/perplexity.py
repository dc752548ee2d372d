"""Quality rules with n-gram perplexity: modified Kneser-Ney models of each language, counted by Spark, and bands."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_limits, if_small, mix64, own_names, shingle_hashes, shuffle_partitions, tidy, utf8, word_hashes, word_spans, written

#: The model: n-grams of ORDER characters over 1 << SYMBOL_BITS symbols, each in one integer of 50 bits.
ORDER, SYMBOL_BITS = 5, 10
#: Symbols of the start of a text, of line breaks, other white space and digits. Other code points below PLAIN stand for
#: themselves in lower case; later ones share the 256 symbols from PLAIN on by their low byte, which tells the letters of
#: one script apart; languages have models of their own.
START, BREAK, SPACE, DIGIT, PLAIN = 0, 10, 32, 48, 768
#: A document is refused where its log perplexity is further than BAND robust deviations from its language's median;
#: nearer than FLOOR nats it stays: a narrow language never refuses what differs by a hair.
BAND, FLOOR = 6.0, 0.75
#: Bins a nat in the histograms that medians and deviations come from.
BINS = 1000
#: Characters that a task holds at once, and n-grams that it sorts at once.
PIECE, GATHER = 1 << 18, 1 << 22
#: Log probabilities are summed as integers, so many to the nat: the same on any cluster.
NAT = 1 << 16
#: n-grams of the model that are broadcast at most (16 bytes each); of a larger one each chunk of texts, of CHUNK_CHARS characters or
#: so, gets what it holds, with the same results.
BROADCAST_GRAMS, CHUNK_CHARS = 1 << 22, 1 << 24


def _symbol_table() -> np.ndarray:
    """The symbol of each code point below 1 << 16."""
    table = np.zeros(1 << 16, dtype=np.uint16)
    for cp in range(len(table)):
        c = chr(cp)
        low = c.lower()
        low = ord(low) if len(low) == 1 else cp
        if c in "\n\r\v\f":
            table[cp] = BREAK
        elif c.isspace():
            table[cp] = SPACE
        elif c.isdigit():
            table[cp] = DIGIT
        else:
            table[cp] = max(1, low) if low < PLAIN else PLAIN + (low & 255)
    return table


_TABLE = _symbol_table()
_TOP = np.uint64(1 << 63)


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = _TABLE[np.minimum(points, len(_TABLE) - 1)]
    high = points >= len(_TABLE)
    if high.any():
        out[high] = PLAIN + (points[high] & 255)
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams that end at each character of the texts, with STARTs before a text's first, and the texts they are of, PIECE
    characters or so at a time: a long text comes in several pieces."""
    held, docs, size = [], [], 0

    def made() -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in held])
        s = np.concatenate(held).astype(np.uint64)
        code = np.zeros(len(s) - ORDER + 1, dtype=np.uint64)
        for i in range(ORDER):
            code <<= np.uint64(SYMBOL_BITS)
            code |= s[i : i + len(code)]
        inside = np.ones(len(s), dtype=bool)  # n-grams begin here; not where they reach into the next text
        for k in range(1, ORDER):
            inside[np.cumsum(lengths) - k] = False
        return code[inside[: len(code)]], np.repeat(np.array(docs), lengths - ORDER + 1)

    start = np.full(ORDER - 1, START, dtype=np.uint16)
    for doc, text in enumerate(texts):
        before = start
        for at in range(0, len(text or ""), PIECE):
            part = np.concatenate([before, symbols(text[at : at + PIECE])])
            before = part[-ORDER + 1 :]
            held.append(part), docs.append(doc)
            size += len(part)
            if size >= PIECE:
                yield made()
                held, docs, size = [], [], 0
    if held:
        yield made()


_COUNTS = "lang long, code long, n0 long, n1 long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, code, n0, n1): how often a language's n-gram is in either half of the task's texts, combined GATHER n-grams
    at a time; Spark combines them before the shuffle."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    size = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for (lang, half), parts in sorted(held.items()):
            codes = np.sort(np.concatenate(parts))
            parts.clear()
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            n = np.diff(np.append(first, len(codes)))
            columns = [np.full(len(n), lang), codes[first].view(np.int64), *((n, 0 * n) if half == 0 else (0 * n, n))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["lang", "code", "n0", "n1"])
        held.clear()

    for batch in batches:
        texts, lang = batch.column("text").to_pylist(), batch.column("__lang").to_numpy()
        half = batch.column("__half").to_numpy()
        for key in sorted(set(zip(lang.tolist(), half.tolist(), strict=True))):
            some = np.flatnonzero((lang == key[0]) & (half == key[1])).tolist()
            for codes, _ in _pieces([texts[i] for i in some]):
                held.setdefault(key, []).append(codes)
                size += len(codes)
                if size >= GATHER:
                    yield from counted()
                    size = 0
    yield from counted()


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4; never above the
    count."""
    if not (n[0] and n[1]):
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return tuple(min(max(d, 0.1), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True))


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(lang, code, q0, q1): -log p of an n-gram's last character after those before it, in units of 1 / NAT, under the models of
    either half, for each row of (lang, code, n0, n1).

    Interpolated modified Kneser-Ney: the highest order uses counts, each lower order the number of distinct characters seen
    before its n-gram, the lowest is mixed with the uniform distribution over all symbols. A language's n-grams are its own;
    discounts are shared. Only counts of counts reach the driver: eight numbers an order.
    """
    tables = {ORDER: counts}
    seen = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(c)
    for k in range(ORDER - 1, 0, -1):
        rest = F.col("code").bitwiseAND(F.lit((1 << SYMBOL_BITS * k) - 1)).alias("code")
        tables[k] = written(tables[k + 1].groupBy("lang", rest).agg(seen("n0"), seen("n1")), f"grams{k}")
    times = lambda h, j: F.sum((F.col(f"n{h}") == j).cast("long")).alias(f"t{h}{j}")
    every = [t.groupBy().agg(F.lit(k).alias("k"), *(times(h, j) for h in (0, 1) for j in (1, 2, 3, 4))) for k, t in tables.items()]
    for t in every[1:]:
        every[0] = every[0].unionByName(t)
    of_order = {r["k"]: r for r in every[0].collect()}
    below = None
    for k in range(1, ORDER + 1):
        cuts = [_discounts([of_order[k][f"t{h}{j}"] or 0 for j in (1, 2, 3, 4)]) for h in (0, 1)]
        context, rest = F.shiftrightunsigned("code", SYMBOL_BITS), F.col("code").bitwiseAND(F.lit((1 << SYMBOL_BITS * (k - 1)) - 1))
        sums = [F.sum(f"n{h}").alias(f"total{h}") for h in (0, 1)]
        sums += [F.sum((c if j < 3 else F.col(f"n{h}") > 2).cast("long")).alias(f"s{h}{j}") for h in (0, 1) for j in (1, 2, 3) for c in [F.col(f"n{h}") == j]]
        contexts = tables[k].groupBy("lang", context.alias("context")).agg(*sums)
        rows = tables[k].withColumn("context", context).join(contexts, ["lang", "context"])
        if below is None:
            rows = rows.withColumns({f"b{h}": F.lit(1.0 / (1 << SYMBOL_BITS)) for h in (0, 1)})
        else:
            rows = rows.withColumn("rest", rest).join(below.select("lang", F.col("code").alias("rest"), F.col("p0").alias("b0"), F.col("p1").alias("b1")), ["lang", "rest"])
        p = []
        for h, d in enumerate(cuts):
            n, total = F.col(f"n{h}"), F.col(f"total{h}")
            cut = F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
            spare = sum((F.col(f"s{h}{j}") * d[j - 1] for j in (2, 3)), F.col(f"s{h}1") * d[0])
            p.append(F.when(total > 0, (n - cut + spare * F.col(f"b{h}")) / total).otherwise(F.col(f"b{h}")).alias(f"p{h}"))
        below = rows.select("lang", "code", *p)
    return below.select("lang", "code", *(F.round(-F.log(f"p{h}") * NAT).cast("int").alias(f"q{h}") for h in (0, 1)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, q): an n-gram's hash, whose order as a signed integer is that of its bits, and q0 and q1 in one integer."""
    for batch in batches:
        lang, code, q0, q1 = (batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("lang", "code", "q0", "q1"))
        q = q0 << np.uint64(32) | q1
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (mix64(code + mix64(lang)) ^ _TOP, q)], ["key", "q"])


def _collected(model: DataFrame) -> tuple[str, bytes, bytes]:
    """The digest of the model's sorted hash arrays, and these: 16 bytes an n-gram."""
    found = model.mapInArrow(_hashed, "key long, q long").orderBy("key").toArrow()
    keys, q = (b"".join(chunk.to_numpy().tobytes() for chunk in found[c].chunks) for c in ("key", "q"))
    digest = hashlib.sha256(keys)
    digest.update(q)
    return digest.hexdigest(), keys, q


class GramTable:
    """-log p of n-grams by their hashes: sorted arrays, and where the hashes of each prefix begin."""

    def __init__(self, keys: bytes, q: bytes):
        self.keys, both = np.frombuffer(keys, dtype="<u8") ^ _TOP, np.frombuffer(q, dtype="<i4").reshape(-1, 2)
        self.q = both[:, 1], both[:, 0]
        bits = max(1, len(self.keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The places of hashes, all of which are there."""
        at = self.first[h >> self.shift]
        late = np.flatnonzero(self.keys[at] < h)
        while len(late):
            at[late] += 1
            late = late[self.keys[at[late]] < h[late]]
        return at


_tables: dict[str, GramTable] = {}


def _table(broadcast) -> GramTable:
    """The worker's table of a broadcast, made once; known by the digest of all it holds, as workers outlive a model."""
    digest, keys, q = broadcast.value
    if digest not in _tables:
        _tables.clear()
        _tables[digest] = GramTable(keys, q)
    return _tables[digest]


_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[list(b"#*$%&|<>")] = True


def features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    raw = utf8(text)
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = word_spans(data) if len(data) else (np.empty(0, int), np.empty(0, int))
    n_words = len(starts)
    n_symbols = int(_SIGNS[data].sum())
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = int((first[ends] - first[starts]).sum())
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    repeats = 0
    if n_words >= 3:
        windows = shingle_hashes(word_hashes(data), 3)
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(len(windows) + 2, dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = twice.copy()
        covered[1:] |= twice[:-1]
        covered[2:] |= twice[:-2]
        repeats = int(covered.sum())
    return n_words, word_chars, n_symbols, len(lines) - len(set(lines)), repeats


def _measure(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """Adds the features and, with a broadcast table, the sum of the n-grams' -log p under the other half's model."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows = np.array([features(t) for t in texts], dtype=np.int64).reshape(-1, len(names))
        columns = list(rows.T)
        if table is not None:
            columns.append(_units(texts, batch.column("__lang").to_numpy(), batch.column("__half").to_numpy(), _table(table)))
        made = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names, *(["__units"] if table is not None else [])])


def _codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, lang, code) of the n-grams of a chunk's texts, each once for GATHER n-grams or so of the task."""
    held: dict[tuple[int, int], list[np.ndarray]] = {}
    size = 0

    def distinct() -> Iterator[pa.RecordBatch]:
        for (chunk, lang), parts in sorted(held.items()):
            codes = np.unique(np.concatenate(parts))
            parts.clear()
            columns = [np.full(len(codes), chunk), np.full(len(codes), lang), codes.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["chunk", "lang", "code"])
        held.clear()

    for batch in batches:
        texts, lang, chunk = _unzipped(batch.column("text")), batch.column("__lang").to_numpy(), batch.column("chunk").to_numpy()
        for key in sorted(set(zip(chunk.tolist(), lang.tolist(), strict=True))):
            some = np.flatnonzero((chunk == key[0]) & (lang == key[1])).tolist()
            for codes, _ in _pieces([texts[i] for i in some]):
                held.setdefault(key, []).append(codes)
                size += len(codes)
                if size >= GATHER:
                    yield from distinct()
                    size = 0
    yield from distinct()


def _zipped(batches: Iterator[pa.RecordBatch], zipped: bool) -> Iterator[pa.RecordBatch]:
    """The rows of texts that the task has not met before; texts are compressed one by one, if they are not yet ``zipped``."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = zip(batch.column("__key").to_pylist(), batch.column("__lang").to_pylist(), strict=True)
        some = batch.take(pa.array([i for i, key in enumerate(keys) if not (key in seen or seen.add(key))], pa.int64()))
        if not zipped:
            packed = pa.array([zlib.compress(utf8(t), 3) for t in some.column("text").to_pylist()], pa.binary())
            some = pa.RecordBatch.from_arrays([packed if c == "text" else some.column(c) for c in some.schema.names], some.schema.names)
        yield some


def _unzipped(column: pa.Array) -> list[str]:
    return [zlib.decompress(t).decode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _hashed_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = next(_hashed(iter([batch])))
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), *made.columns], ["chunk", "key", "q"])


def _units(texts: list[str], lang: np.ndarray, half: np.ndarray, grams: GramTable) -> np.ndarray:
    """The sum of each text's n-grams' -log p under the other half's model."""
    lang, units = mix64(lang.view(np.uint64)), np.zeros(len(texts), dtype=np.int64)
    for codes, doc in _pieces(texts):
        at = grams.find(mix64(codes + lang[doc]))
        q = np.where(half[doc] == 0, grams.q[1][at], grams.q[0][at])
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        units[doc[first]] += np.add.reduceat(q.astype(np.int64), first)
    return units


def _score_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__key, __lang, __units) of texts. Rows come chunk by chunk, in each the sorted hash arrays of its n-grams before the texts."""
    now, keys, q, grams = None, [], [], None
    for batch in batches:
        chunk, kind = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(batch)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if not len(part):
                continue
            if chunk[a] != now:
                now, keys, q, grams = chunk[a], [], [], None
            if kind[a] == 0:
                keys.append(part.column("key").to_numpy().tobytes())
                q.append(part.column("q").to_numpy().tobytes())
                continue
            if grams is None:
                grams, keys, q = GramTable(b"".join(keys), b"".join(q)), [], []
            lang, half = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__lang", "__half"))
            units = _units(_unzipped(part.column("text")), lang, half, grams)
            yield pa.RecordBatch.from_arrays([part.column("__key"), part.column("__lang"), pa.array(units)], ["__key", "__lang", "__units"])


def _chunk_scores(df: DataFrame, model: DataFrame, n_grams: int) -> DataFrame:
    """(__key, __lang, __units) of each text for a model too large to broadcast: distinct texts are dealt to chunks, each chunk gets the
    sorted hash arrays of those n-grams that it holds, once each, and its texts are looked up there. A chunk is bounded, and
    so are its arrays, whatever the model's size. Copies of a text are left out by each task, and then by its chunk; texts are
    compressed, as they move twice."""
    chunks = max(shuffle_partitions(df.sparkSession), n_grams // CHUNK_CHARS)
    columns = "__key long, __lang long, __half long, text binary"
    texts = df.select("__key", "__lang", "__half", "text").where(F.length("text") > 0).mapInArrow(lambda b: tidy(_zipped(b, False)), columns)
    texts = texts.withColumn("chunk", F.pmod(F.xxhash64("__key", "__lang"), F.lit(chunks)).cast("long")).repartition(chunks, "chunk")
    texts = written(texts.mapInArrow(lambda b: tidy(_zipped(b, True)), columns + ", chunk long"), "chunks")
    codes = texts.select("chunk", "__lang", "text").mapInArrow(lambda b: tidy(_codes_of(b)), "chunk long, lang long, code long")
    found = codes.join(written(model, "model"), ["lang", "code"]).select("chunk", "lang", "code", "q0", "q1")
    arrays = written(found.mapInArrow(_hashed_chunks, "chunk long, key long, q long"), "arrays")
    none = lambda *kinds: [F.lit(None).cast(kind).alias(name) for name, kind in kinds]
    rows = arrays.select("chunk", F.lit(0).alias("kind"), "key", "q", *none(("__key", "long"), ("__lang", "long"), ("__half", "long"), ("text", "binary")))
    rows = rows.unionByName(texts.select("chunk", F.lit(1).alias("kind"), *none(("key", "long"), ("q", "long")), "__key", "__lang", "__half", "text"))
    dealt = rows.repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind", "key")
    return dealt.mapInArrow(lambda b: tidy(_score_chunks(b)), "__key long, __lang long, __units long")


def bands(scored: DataFrame) -> DataFrame:
    """(__lang, __low, __high): the least and the greatest log_ppl kept of each language of a table (__lang, log_ppl).

    Medians and median deviations are exact on BINS bins a nat: of a histogram of integers, the same on any cluster, with at
    most as many rows a language as it has texts or bins.
    """
    bins = scored.groupBy("__lang", F.round(F.col("log_ppl") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    mid = bins.groupBy("__lang").agg(F.percentile("bin", 0.5, F.col("n")).alias("mid"))
    off = bins.join(mid, "__lang").groupBy("__lang", "mid").agg(F.percentile(F.abs(F.col("bin") - F.col("mid")), 0.5, F.col("n")).alias("off"))
    reach = F.greatest(F.lit(BAND * 1.4826 / BINS) * F.col("off"), F.lit(FLOOR))
    return off.select("__lang", (F.col("mid") / BINS - reach).alias("__low"), (F.col("mid") / BINS + reach).alias("__high"))


@own_names
def judge(df: DataFrame, *, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds to the rows of a table with text and lang: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ppl,
    base_failed and kept.

    base_failed: fewer than 50 words, or over half of the words in 3-word windows that the text has twice or more. log_ppl: the
    sum of -log p of the text's characters by word of the text, under its language's model of the half of the texts that it and
    its copies are not in, so that odd text cannot vouch for itself. (By word, as by character repeated signs look fluent.)
    kept: not base_failed, and log_ppl within the band of its language.

    The table is read twice, to count and to score; what is scored is written, without the columns in ``drop``. Counts are of
    all rows and grow with the table: characters are combined in each task and by Spark, and lower orders and
    probabilities are joins and aggregations. Beyond BROADCAST_GRAMS n-grams the model is not sent to the tasks:
    distinct texts are dealt to chunks, and each chunk gets sorted hash arrays of its own n-grams, with the same results.

    Edge cases: null and empty texts have zero features, a null log_ppl and fail; null is a language of its own, and so is the
    empty string; a language's only document is its median and stays; repeated rows are judged alike; an empty table gives an
    empty result; columns named like a result are replaced, others pass through.
    """
    spark = df.sparkSession
    arrow_limits(spark)
    df = df.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl", "base_failed", "kept")
    key = F.xxhash64("text")
    lang = F.when(F.col("lang").isNull(), F.lit(0)).otherwise(F.xxhash64(F.col("lang").cast("string")))
    df = df.withColumns({"__key": key, "__lang": lang.cast("long"), "__half": key.bitwiseAND(F.lit(1)).cast("long")})
    counts = df.select("text", "__lang", "__half").mapInArrow(lambda b: tidy(_count(b)), _COUNTS)
    counts = written(counts.groupBy("lang", "code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    n_codes, n_grams = counts.agg(F.count("*"), F.coalesce(F.sum(F.col("n0") + F.col("n1")), F.lit(0))).first()
    small = n_codes <= BROADCAST_GRAMS
    model, store = log_probabilities(counts), None
    if small:
        store = spark.sparkContext.broadcast(_collected(model))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(["__units"] if small else [])]
    scored = df.mapInArrow(lambda b: tidy(_measure(b, store)), ", ".join([fields, *(f"{c} long" for c in added)]))
    if not small:
        scored = scored.join(_chunk_scores(df, model, n_grams), ["__key", "__lang"], "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    log_ppl = F.when(F.col("n_words") > 0, F.col("__units") / F.col("n_words") / NAT)
    scored = written(scored.withColumns({"log_ppl": log_ppl, "base_failed": failed}).drop("__units", "__key", "__half", *drop), "scored")
    limits = if_small(written(bands(scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull())), "bands"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("__low"), F.col("__high")), F.lit(False))
    return scored.join(limits, "__lang", "left").withColumn("kept", kept).drop("__lang", "__low", "__high")
