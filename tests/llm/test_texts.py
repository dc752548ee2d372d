"""Token counts, personal data, quality rules and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from quillstone.llm import packing, perplexity, pii, tokens

SCHEMA = "doc_id long, text string, lang string, n_words long"
TEXTS = ["", None, "One two.", " lead", "trail ", "a  b   c", "</s> <s> <unk>", "é ü ß 中文 😀", "x" * 5000, "word " * 9000, "<|endoftext|>x", "\n\t\x0b mixed\r\nlines", "▁odd▁ ▁"]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "en", 9) for i, t in enumerate(texts)] + [(None, "no id", "en", 9), (0, texts[0], "en", 9)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_token_counts(spark, monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    df, rows = frame(spark)
    got = tokens.token_counts(df, model_path=path).collect()
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, *_ in rows)
    assert Counter(map(tuple, got)) == want
    assert tokens.token_counts(df.where("false"), model_path=path).count() == 0


def test_segments_add_up():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    random.seed(4)
    for _ in range(400):
        t = "".join(random.choice("ab  ▁.\né") for _ in range(random.randint(0, 60)))
        assert sum(len(x) for x in sp.encode(tokens.segments(t, 5))) == len(sp.encode(t)), repr(t)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            small = kind != "ip" or all(int(x[-3000:]) <= 255 and not x[:-3000].strip("0") for x in m[0].split("."))
            if small and {"email": True, "ip": True, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_spans_are_those_of_the_patterns():
    random.seed(1)
    for n in range(20000):
        t = "".join(random.choice("a1 2.@+-().53b%é") for _ in range(random.randint(0, 40)))
        assert [s for s in pii.find_spans(t) if s[0] in BASE] == base_spans(t), repr(t)
    text = "me@x.org, 4111 1111 1111 1111 +1 (555) 010-9999, 10.0.0.1 https://u:p@h/x?y token = \"abc123def456\""
    kinds = Counter(k for k, _, _ in pii.find_spans(text))
    assert kinds == {"email": 1, "card": 1, "phone": 1, "ip": 1, "url": 1, "account": 1}
    text = 'averyveryverylongscheme+x.y://u:p@h, DE89 3704 0044 0532 0130 00, DE88370400440532013000; AKIA' + "Q7" * 8 + ", xAKIA" + "Q7" * 8 + ", ghp_" + "a1" * 18
    found = pii.find_spans(text)
    assert [(k, text[a:b]) for k, a, b in found if k in ("url", "iban", "key")] == [
        ("url", "averyveryverylongscheme+x.y://u:p@h,"), ("iban", "DE89 3704 0044 0532 0130 00"), ("key", "AKIA" + "Q7" * 8), ("key", "ghp_" + "a1" * 18)
    ]


def test_recall_of_planted_spans():
    """Every planted secret and account is found to its boundaries, and prose without any has no span."""
    rng, missed, false = random.Random(9), 0, 0
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    for _ in range(500):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9))) for _ in range(40)]
        false += len(pii.find_spans(" ".join(words)))
        value = hexed(39) + "7"
        lead, mark = rng.choice([("token = \"", "\""), ("Password: ", ""), ("API_KEY=", ""), ("account no. ", ""), ("client_secret='", "'")])
        words.insert(rng.randrange(40), lead + value + mark)
        text = " ".join(words)
        missed += (text.index(value), text.index(value) + len(value)) not in {(a, b) for k, a, b in pii.find_spans(text) if k == "account"}
    assert missed == 0 and false == 0


def test_private_data_rows(spark):
    df, rows = frame(spark, [*TEXTS, "a@b.c " * 2000, "1.2.3.4 999.1.1.1", "0" * 30 + "1.1.1.1 " + "0" * 9000 + "255.0.0.0 1.1.1.00256", "9" * 9000 + ".1.1.1"])
    got = pii.find_private(df).collect()
    want = Counter()
    for i, t, *_ in rows:
        spans = base_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[(i, *(sum(s[0] == k for s in spans) for k in BASE), hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in got) == want


def brute_features(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    twice = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)


def test_features():
    random.seed(2)
    for _ in range(2000):
        t = "".join(random.choice("aé b\n\t#|") for _ in range(random.randint(0, 60)))
        assert perplexity.features(t) == brute_features(t), repr(t)


def test_judge(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "stone", "river", "light", "green", "under", "walks", "slowly", "often", "north", "wind", "paper", "table"]
    good = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(120)]
    junk = ["".join(rng.choice("qzxjkvw") for _ in range(6)) for _ in range(900)]
    texts = [*good, " ".join(junk[:300]), "short", None, "", "same words here " * 60]
    df, rows = frame(spark, texts)
    got = [r for r in perplexity.judge(df).collect()]
    assert len(got) == len(rows)
    kept = Counter(r.kept for r in got if r.doc_id is not None and r.doc_id < 120)
    assert kept[True] >= 118 and not [r for r in got if r.doc_id in (120, 121, 122, 123, 124) and r.kept]
    assert all(r.n_words == brute_features(r.text or "")[0] for r in got)
    assert perplexity.judge(df.where("false")).count() == 0


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tok = Tokenizer.from_str(spec)
    random.seed(2)
    letters = "aBcdsStTmMlLrReEvV'''.,-_ <|>\n\t éÉßµªΣσ0198!?$€中éİıſKÅ½²\x1c\x85 "
    for i in range(5000):
        t = "".join(random.choice(letters) for _ in range(random.randint(0, 25))) + ("<|endoftext|>" if i % 50 == 0 else "")
        assert np.frombuffer(packing.token_ids([t], spec, 1)[0], dtype="<u2").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], repr(t)


def test_other_vocabularies_are_refused():
    import json

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    packing.check_vocabulary(json.dumps(spec))
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 70_000, "content": "x"}]}, {"model": {**spec["model"], "end_of_word_suffix": None}}):
        with pytest.raises(ValueError):
            packing.check_vocabulary(json.dumps(spec | change))


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_to_neighbours(n, bits):
    import itertools

    points = list(itertools.product(range(1 << bits), repeat=n))
    order = sorted(zip(packing.hilbert(np.array(points), bits).tolist(), points, strict=True))
    assert [k for k, _ in order] == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(order, order[1:]))


def test_curve_keys_do_not_depend_on_neighbours(monkeypatch):
    rng = random.Random(3)
    texts = [np.array([rng.randrange(49_000) for _ in range(rng.choice([0, 1, 5, 300]))] + [1], dtype="<u2").tobytes() for _ in range(60)]
    keys = packing.curve_keys(texts).tolist()
    monkeypatch.setattr(packing, "PROJECTED", 7)
    assert keys == packing.curve_keys(texts).tolist() == [packing.curve_keys([t])[0] for t in texts]
    assert all(k == 0 for k, t in zip(keys, texts, strict=True) if len(t) == 2) and len(set(keys)) > 20 and packing.curve_keys([]).tolist() == []


def test_pack(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    df, rows = frame(spark)
    pieces = packing.pack_curve(df, tokenizer_path=path, length=64).collect()
    want, got, seqs = Counter(), defaultdict(list), defaultdict(list)
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[(i, len(ids), int(ids.sum()))] += 1
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<u2").astype("<u4")
        assert len(ids) == p.length and p.ids_crc32 == zlib.crc32(ids.tobytes())
        got[p.doc_id].append((p.start, p.length, p.doc_tokens, int(ids.sum())))
        seqs[p.sequence_id].append((p.offset, p.length))
    assert sum(n * k for (_, n, _), k in want.items()) == sum(p.length for p in pieces)
    for s, parts in seqs.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == max(seqs)
    single = [i for i in got if sum(k for (j, *_), k in want.items() if j == i) == 1]
    assert {(i, max(x[2] for x in got[i]), sum(x[3] for x in got[i])) for i in single} == {w for w in want if w[0] in single}
    assert packing.pack_curve(df.where("false"), tokenizer_path=path).count() == 0
