"""Substring dedup by repeated-phrase automata: passages that recur are confirmed, compiled and looked for in all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import arrow_limits, discard, ranked, shingle_hashes, shuffle_partitions, tidy, utf8, word_hashes, word_spans, written

#: Words of the shingles whose least hash marks a window.
SHINGLE = 5
#: Windows of one piece of a document; pieces of a document that stay together; windows of a chunk, for which one automaton is
#: compiled, about.
PIECE, TOGETHER, CHUNK = 128, 64, 1 << 17
#: Bytes of a text, and of several, that are read at once.
READ = 1 << 22
#: Bits of a word's place in its document.
PLACE = 28


def _parts(texts: list[bytes | None], overlap: int) -> Iterator[tuple[np.ndarray, list[int], list[int], np.ndarray]]:
    """(bytes, texts' numbers, words before, ends) of parts of texts, about READ bytes at once. A longer text comes in several
    parts that share ``overlap`` words. ends: where the next part begins."""
    held, of, before, size = [], [], [], 0

    def made() -> tuple:
        raw = b"".join(x + b"\n" for x in held)
        return np.frombuffer(raw, dtype=np.uint8), of, before, np.cumsum([len(x) + 1 for x in held])

    for i, text in enumerate(texts):
        at = words = 0
        text = text or b""
        while at < len(text):
            part = text[at : at + READ]
            rest = at + READ < len(text)
            if rest:
                starts, ends = word_spans(np.frombuffer(part, dtype=np.uint8))
                if len(starts) < 2 * overlap + 2:  # words of megabytes: the text in one
                    part, rest = text[at:], False
            if rest:
                part = part[: ends[-2]]  # the last word may go on
                step, shared = int(starts[-1 - overlap]), len(starts) - 1 - overlap
            held.append(part), of.append(i), before.append(words)
            size += len(part)
            if rest:
                at, words = at + step, words + shared
            else:
                at = len(text)
            if size >= READ:
                yield made()
                held, of, before, size = [], [], [], 0
    if held:
        yield made()


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if reach < width else values


def _mark(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(mark, text, at, n): runs of n windows from word ``at`` on with one mark, the least hash of the window's shingles. Equal
    windows have equal marks. A text that a task has seen is not marked again."""
    k, seen = min(SHINGLE, window), set()
    for batch in batches:
        keys, texts = batch.column("th").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
        fresh = [i for i, key in enumerate(keys) if not (key in seen or seen.add(key))]
        if len(seen) > 1 << 20:
            seen.clear()
        th = np.array([keys[i] for i in fresh], dtype=np.int64)
        for data, of, before, stops in _parts([texts[i] for i in fresh], window - 1):
            words = word_hashes(data)
            if len(words) < window:
                continue
            part = np.searchsorted(stops, word_spans(data)[0], side="right")
            first = np.searchsorted(part, np.arange(len(of)))
            marks = least_of(shingle_hashes(words, k), window - k + 1)
            at = np.flatnonzero(part[: len(marks)] == part[window - 1 :])
            if not len(at):
                continue
            marks, part = marks[at], part[at]
            fresh_run = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]) | (part[1:] != part[:-1])]))
            own = part[fresh_run]
            place = at[fresh_run] - first[own] + np.array(before)[own]
            if int(place.max()) >> PLACE:
                raise ValueError(f"a text of over {1 << PLACE} words")
            columns = [marks[fresh_run].view(np.int64), th[np.array(of)[own]], place, np.diff(np.append(fresh_run, len(at)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["mark", "th", "at", "n"])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(no, doc_id, piece, at, text): the runs of a document's windows that may recur, each document's pieces by themselves."""
    names = ["no", "doc_id", "piece", "at", "words"]
    for batch in batches:
        rows = []
        for no, doc_id, text, runs in zip(batch.column("no").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            starts, ends = word_spans(np.frombuffer(raw, dtype=np.uint8))
            at = np.array([(r["at"], r["at"] + r["n"]) for r in runs], dtype=np.int64)
            at = np.minimum(at[np.argsort(at[:, 0])], len(starts) - window + 1)
            fresh = np.flatnonzero(np.concatenate([[True], at[1:, 0] > np.maximum.accumulate(at[:, 1])[:-1]]))
            for a, b in zip(at[fresh, 0].tolist(), np.maximum.reduceat(at[:, 1], fresh).tolist(), strict=True):
                while a < b:
                    stop = min(b, (a // PIECE + 1) * PIECE)
                    rows.append((no, doc_id, a // PIECE, a, raw[starts[a] : ends[stop + window - 2]]))
                    a = stop
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names)


_OTHER = np.uint64(0x5851F42D4C957F2D)


def _hash_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(h, g, place): 96 bits of each window of pieces, and document and word in one integer."""
    for batch in batches:
        no, at = batch.column("no").to_numpy(), batch.column("at").to_numpy()
        for data, of, before, stops in _parts(batch.column("words").to_pylist(), window - 1):
            words = word_hashes(data)
            if len(words) < window:
                continue
            part = np.searchsorted(stops, word_spans(data)[0], side="right")
            first = np.searchsorted(part, np.arange(len(of)))
            h, g = shingle_hashes(words, window), shingle_hashes(words * _OTHER ^ _OTHER, window)
            inside = np.flatnonzero(part[: len(h)] == part[window - 1 :])
            own = part[inside]
            row = np.array(of)[own]
            place = no[row] << PLACE | (at[row] + inside - first[own] + np.array(before)[own])
            columns = [(h[inside].view(np.int64), pa.int64()), ((g[inside] >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()), (place, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["h", "g", "place"])


#: Letters of one place of a word's code; a node of an automaton has no more children than that, which it searches one by one.
LETTERS = 256


def codes(words: set[bytes]) -> tuple[dict[bytes, str], int]:
    """A code for each word, and its length: a letter for each digit of its number, from another alphabet at each place, so that
    a run of codes is found at words' beginnings only."""
    length = 1
    while LETTERS**length < len(words):
        length += 1
    digits = [[chr(1 + place * LETTERS + i) for i in range(LETTERS)] for place in range(length)]
    return {w: "".join(digits[place][i // LETTERS**place % LETTERS] for place in range(length)) for i, w in enumerate(sorted(words))}, length


class Phrases:
    """An automaton that finds phrases of ``window`` words: of each text of a document those that begin at its words from ``low`` to
    ``high``.

    Each phrase holds one anchor, about half a phrase of words that begins at a multiple of their number in its text. The
    automaton is of the anchors, a thirteenth of what it would be of all phrases; where it finds one, the phrases around it
    are looked up as they stand."""

    def __init__(self, texts: list[tuple[int, bytes, int, int]], window: int):
        import ahocorasick

        parts = [(doc_id, text.split()[max(0, low) : high + window]) for doc_id, text, low, high in texts]
        self.codes, self.length = codes({w for _, words in parts for w in words})
        self.window, self.anchor, self.least = window, (window + 1) // 2, {}
        self.step, unit = window - self.anchor + 1, self.length
        self.automaton = ahocorasick.Automaton()
        for doc_id, words in parts:
            coded = "".join(map(self.codes.__getitem__, words))
            for i in range(0, len(coded) - window * unit + 1, unit):
                phrase = coded[i : i + window * unit]
                if self.least.get(phrase, doc_id) >= doc_id:
                    self.least[phrase] = doc_id
            for i in range(0, len(coded) - self.anchor * unit + 1, self.step * unit):
                self.automaton.add_word(coded[i : i + self.anchor * unit], 0)
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, doc_id: int, text: bytes) -> list[tuple[int, int]]:
        """Spans of words, as far as they touch united, of all occurrences of phrases that a smaller document holds."""
        out: list[tuple[int, int]] = []
        if not len(self.automaton):
            return out
        other, unit, size = "\0" * self.length, self.length, self.window * self.length
        words = text.split()
        coded, fresh = "".join([self.codes.get(w, other) for w in words]), 0
        for end, _ in self.automaton.iter(coded):
            at = (end + 1) // unit - self.anchor
            for a in range(max(fresh, at - self.step + 1), min(at, len(words) - self.window) + 1):
                if self.least.get(coded[a * unit : a * unit + size], doc_id) < doc_id:
                    if out and a <= out[-1][1]:
                        out[-1] = out[-1][0], a + self.window
                    else:
                        out.append((a, a + self.window))
            fresh = at + 1
        return out


def _locate(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(no, start, stop): spans to remove. Rows come chunk by chunk, in each the phrases' texts first."""
    now, texts, phrases = None, [], None
    for batch in batches:
        rows = []
        for chunk, kind, no, doc_id, at, low, high, words in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "no", "doc_id", "at", "low", "high", "words")), strict=True):
            if chunk != now:
                now, texts, phrases = chunk, [], None
            if kind == 0:
                texts.append((doc_id, words, low - at, high - at))
                continue
            if phrases is None:
                phrases, texts = Phrases(texts, window), []
            rows += [(no, at + a, at + b) for a, b in phrases.found(doc_id, words)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["no", "start", "stop"])


def _keep(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_removed and text: the words outside the spans, joined by one space."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, copy, spans in zip(batch.column("text"), batch.column("copy").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = b"" if not text.is_valid else text.as_buffer().to_pybytes()
            words = words.split()
            n, out = len(words), words
            if copy:
                out = [] if n >= window else words
            elif spans:
                out, at = [], 0
                for s in sorted(spans, key=lambda s: s["start"]):
                    out += words[at : max(at, s["start"])]
                    at = max(at, s["stop"])
                out += words[at:]
            n_words.append(n), n_removed.append(n - len(out)), kept.append(b" ".join(out))
        columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "text"])


def cut_repeats(df: DataFrame, *, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and text for each row of a table with doc_id (read as a long) and text: the words of the text
    that are left, joined by one space, when each word goes that a run of ``window`` words covers which also begins in a
    document with a smaller doc_id. Windows are judged on the input.

    1. Recurring passages are confirmed. Each window is marked by the least hash of its shingles, about one mark for five
       windows; marks of one text only go, combined before the shuffle. Windows under the others are hashed (96 bits), and
       those that two texts hold are known by the first document that has them.
    2. Automata are compiled by chunks of the documents' pieces: a chunk gets the texts of just those pieces of smaller
       documents that hold a window which also occurs in it, and compiles what lies between the first and the last such window.
    3. The pieces of all documents pass their chunk's automaton, which finds each occurrence, word by word: hashes decide only
       what is looked at.

    Scale: texts are shuffled twice, by document, to meet their marks and to meet what goes; nothing that grows with the table is
    broadcast. Copies of a text are one document for all steps. Frequent marks, windows and passages are combined in each task, and the joins
    they are in can be split. A long document is dealt to many chunks. Memory follows a chunk or one text.

    Edge cases: null and empty texts have no words; a row without doc_id keeps all words and takes none from others; rows that
    repeat a doc_id are documents each, none smaller than another; a text of fewer words than a window keeps all; a text
    of over 2**28 words is refused; an empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    arrow_limits(spark)
    th, tg = F.xxhash64("text").alias("th"), F.hash("text").alias("tg")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", th, tg, "text")
    marks = written(named.select("th", "text").mapInArrow(lambda b: tidy(_mark(b, window)), "mark long, th long, at int, n int"), "marks")
    shared = written(marks.groupBy("mark").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").select("mark"), "shared")
    runs = marks.join(shared.hint("merge"), "mark").select("th", "at", "n").distinct().groupBy("th").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    # the first document of each text, numbered in their order
    keys = named.select("doc_id", "th", "tg")
    firsts = written(keys.groupBy("th", "tg").agg(F.min("doc_id").alias("doc_id")), "firsts")
    numbered = ranked(firsts, [F.col("doc_id"), F.col("th"), F.col("tg")], "no")
    wanted = written(numbered.join(runs, "th"), "wanted")
    discard(marks)
    cut = named.join(wanted.hint("merge"), ["doc_id", "th", "tg"]).select("no", "doc_id", "text", "runs")
    pieces = written(cut.mapInArrow(lambda b: tidy(_cut(b, window)), "no long, doc_id long, piece int, at int, words binary"), "pieces")

    windows = written(pieces.select("no", "at", "words").mapInArrow(lambda b: tidy(_hash_windows(b, window)), "h long, g int, place long"), "windows")
    chunks = max(shuffle_partitions(spark), windows.count() // CHUNK)
    chunk = lambda no, piece: F.pmod(F.xxhash64(no, F.floor(piece / TOGETHER)), F.lit(chunks)).alias("chunk")
    no_of, word_of = (lambda c: F.shiftright(c, PLACE)), (lambda c: F.col(c).bitwiseAND((1 << PLACE) - 1).cast("int"))
    piece_of = lambda c: F.floor(word_of(c) / PIECE).cast("int")
    first = windows.groupBy("h", "g").agg(F.min("place").alias("first"), F.max("place").alias("last")).where(no_of("first") < no_of("last"))
    met = windows.join(first, ["h", "g"]).where(no_of("place") > no_of("first"))
    routes = met.select(chunk(no_of("place"), piece_of("place")), no_of("first").alias("no"), piece_of("first").alias("piece"), word_of("first").alias("word"))
    routes = routes.groupBy("chunk", "no", "piece").agg(F.min("word").alias("low"), F.max("word").alias("high"))
    columns = ["chunk", "kind", "no", "doc_id", "at", "low", "high", "words"]
    phrases = written(routes, "routes").join(pieces, ["no", "piece"]).withColumn("kind", F.lit(0)).select(*columns)
    streamed = pieces.withColumns({"chunk": chunk(F.col("no"), F.col("piece")), "kind": F.lit(1), "low": F.lit(None).cast("int"), "high": F.lit(None).cast("int")}).select(*columns)
    dealt = phrases.unionByName(streamed).repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind")
    spans = dealt.mapInArrow(lambda b: tidy(_locate(b, window)), "no long, start int, stop int")
    spans = spans.groupBy("no").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    own = spans.join(numbered, "no").select("doc_id", "th", F.lit(False).alias("copy"), "spans")
    copies = keys.distinct().join(firsts.withColumnRenamed("doc_id", "first"), ["th", "tg"]).where("doc_id > first")
    copies = copies.select("doc_id", "th", F.lit(True).alias("copy"), F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans"))
    gone = written(own.unionByName(copies), "spans")
    discard(windows)
    rows = docs.withColumn("th", th).join(gone.hint("merge"), ["doc_id", "th"], "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
    kind = dict(df.dtypes)["doc_id"]
    out = rows.mapInArrow(lambda b: tidy(_keep(b, window)), "doc_id long, n_words long, n_removed long, text string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
