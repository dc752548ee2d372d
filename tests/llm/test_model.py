"""The quality rules' model and bands against plain ones."""

import math
import random
import re
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.llm import perplexity

DOC = "doc_id long, text string, lang string"


def plain_symbol(c):
    if c in "\n\r\v\f":
        return 10
    if c.isspace():
        return 32
    if c.isdigit():
        return 48
    low = c.lower() if len(c.lower()) == 1 and ord(c) < 1 << 16 else c
    return max(1, ord(low)) if ord(low) < 768 else 768 + (ord(low) & 255)


def plain_grams(text, lang):
    s = [0] * 4 + [plain_symbol(c) for c in text or ""]
    return [(lang, *s[i : i + 5]) for i in range(len(s) - 4)]


def plain_model(grams):
    """Interpolated modified Kneser-Ney with dictionaries, of n-grams that begin with their language."""
    levels = [Counter() for _ in range(5)]
    levels[4].update(grams)
    for k in range(3, -1, -1):
        levels[k] = Counter((g[0], *g[2:]) for g in levels[k + 1])
    cuts, after = [], []
    for c in levels:
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
            cuts.append([min(max(x, 0.1), k - 0.05) for x, k in zip(raw, (1, 2, 3), strict=True)])
        else:
            cuts.append([0.5] * 3)
        by = defaultdict(list)
        for g, v in c.items():
            by[g[:-1]].append(v)
        after.append(by)

    def p(g):
        if len(g) == 1:
            return 1 / 1024
        k = len(g) - 2
        below, seen = (g[0], *g[2:]), after[k].get(g[:-1])
        if not seen:
            return p(below)
        cut = lambda v: cuts[k][min(v, 3) - 1]
        v = levels[k].get(g, 0)
        return ((v - cut(v) if v else 0) + sum(map(cut, seen)) * p(below)) / sum(seen)

    return p


def plain_scores(rows, halves):
    grams = {(t, lang): plain_grams(t, lang) for _, t, lang in rows}
    models = [plain_model([g for (_, t, lang), h in zip(rows, halves, strict=True) if h == half for g in grams[t, lang]]) for half in (0, 1)]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    return [-sum(math.log(models[1 - h](g)) for g in grams[t, lang]) / words(t) if words(t) else None for (_, t, lang), h in zip(rows, halves, strict=True)]


@pytest.mark.parametrize("limits", [{}, {"PIECE": 37, "GATHER": 500}, {"BROADCAST_GRAMS": 0, "PIECE": 64}, {"BROADCAST_GRAMS": 0, "CHUNK_CHARS": 200, "GATHER": 300}])
def test_scores_are_those_of_modified_kneser_ney(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(perplexity, k, v)
    rng = random.Random(4)
    pool = "the The of a stone river é 水火 σΣ light 12 ~ 😀 İ\x00".split(" ")
    rows = [(i, " ".join(rng.choice([*pool, f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(1, 70))), rng.choice(["en", "el", None, ""])) for i in range(60)]
    rows += [(60, rows[0][1], "en"), (61, rows[1][1], rows[1][2]), (62, None, "en"), (63, "", None), (64, " \n", "en"), (65, "one", "en"), (None, "no id here", "x"), (66, "lonely", "zz")]
    df = spark.createDataFrame(rows, DOC).withColumn("kept", F.lit("clash")).withColumn("lang2", F.lit(1)).repartition(5)
    got = {(r.doc_id, r.text, r.lang): r for r in perplexity.judge(df).collect()}
    halves = {(r[0], r[1], r[2]): r[3] & 1 for r in df.select("doc_id", "text", "lang", F.xxhash64("text")).collect()}
    assert set(halves.values()) == {0, 1} and len(got) == len(rows)
    for row, want in zip(rows, plain_scores(rows, [halves[r] for r in rows]), strict=True):
        have = got[row].log_ppl
        assert (have is None) == (want is None) and (want is None or math.isclose(have, want, rel_tol=1e-4)), (row, have, want)


def test_bands_are_medians_and_deviations(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh"[: 2 + i % 5]) for _ in range(rng.randint(1, 9))) for _ in range(80)), rng.choice(["en", "de", None])) for i in range(150)]
    rows += [(200, " ".join(f"q{rng.randint(0, 10**6)}z" for _ in range(90)), "en"), (201, rows[0][1], "only"), (202, "short", "en"), (203, "same words here " * 60, "en")]
    got = perplexity.judge(spark.createDataFrame(rows, DOC)).collect()
    by = defaultdict(list)
    for r in got:
        if not r.base_failed:
            by[r.lang].append(round(r.log_ppl * 1000))
    for r in got:
        kept = not r.base_failed
        if kept:
            mid = statistics.median(by[r.lang])
            reach = max(perplexity.BAND * 1.4826 * statistics.median(abs(x - mid) for x in by[r.lang]) / 1000, perplexity.FLOOR)
            kept = abs(r.log_ppl - mid / 1000) <= reach + 1e-9
        assert r.kept == kept, r
    verdict = {r.doc_id: r.kept for r in got}
    assert verdict[201] and not any(verdict[i] for i in (200, 202, 203)) and sum(verdict.values()) > 140
    assert perplexity.judge(spark.createDataFrame([], DOC)).count() == 0


def test_what_is_gathered_grows_with_the_texts(spark):
    rng = random.Random(6)
    rows = [(" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(100)), 0, 0) for _ in range(200)]
    grams = lambda n: spark.createDataFrame(rows[:n], "text string, __lang long, __half long").mapInArrow(perplexity._count, perplexity._COUNTS).select("code").distinct().count()
    assert grams(200) > 4 * grams(40) > 0


def test_wrong_languages_and_odd_words_are_refused(spark):
    rng = random.Random(8)
    words = {"en": "the stone river light green under walks slowly often north wind paper".split(), "fr": "la pierre rivière lumière verte sous marche lentement souvent nord vent papier".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(90)), lang) for i in range(120) for lang in [("en", "fr")[i % 2]]]
    rows += [(500, rows[0][1][::2] + rows[1][1], "en"), (501, rows[1][1] + " fin", "en"), (502, rows[2][1].replace(" ", "### "), "en")]
    long_text = " ".join(rng.choice(words["en"]) for _ in range(200_000))
    rows.append((503, long_text, "en"))
    got = {r.doc_id: r for r in perplexity.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert all(got[i].kept for i in range(120)) and not any(got[i].kept for i in (500, 501, 502))
    assert got[503].n_words == 200_000 and got[503].log_ppl is not None
