"""Definitions and passages by hand and against plain models."""

import random

import pytest

from quillstone.operators import passages
from quillstone.operators.modules import Definitions

SOURCE = {
    "app/__init__.py": "VERSION = 1\nfrom .core import run as start\n",
    "app/core.py": (
        "import os\nfrom . import VERSION\nfrom .util import helper, LIMIT as top\nif os.name:\n    FLAG = 1\nelse:\n    FLAG, OTHER = 2, 3\n\n"
        "@helper\ndef run(n=FLAG, *, m=top):\n    def inner():\n        return VERSION\n    return inner() + local(n)\n\n\ndef local(x):\n    y = x\n    return y\n\n"
        "class Base:\n    size = OTHER\n\n    def __init__(self):\n        self.a = local(1)\n\n    def go(self, k=size):\n        return self.step() + self.a\n\n    @staticmethod\n    def free(self):\n        return self.step()\n\n"
        "    def step(me):\n        return me.go\n"
    ),
    "app/util.py": "LIMIT = 5\n\ndef helper(f):\n    return f\n",
    "app/broken.py": "def (:\n",
    "notes.txt": "def x(): pass\n",
}


@pytest.fixture(scope="module")
def made(spark):
    return Definitions(spark.createDataFrame(list(SOURCE.items()), "path string, text string"))


def test_units_and_links(made):
    units = {r.unit: (r.scope, r.name, r.kind) for r in made.units.collect()}
    assert units["app/core.py:9-13:FunctionDef"] == ("", "run", "FunctionDef") and units["app/core.py:26-27:FunctionDef"] == ("Base", "go", "FunctionDef")
    assert [r.path for r in made.failures.collect()] == ["app/broken.py"]
    links = {}
    for r in made.links.collect():
        links.setdefault(r.src, set()).add(r.dst)
    core = lambda *xs: {f"app/core.py:{x}" for x in xs}
    assert links["app/core.py:9-13:FunctionDef"] == core("2-2:ImportFrom", "3-3:ImportFrom", "4-7:If", "16-18:FunctionDef")
    assert links["app/core.py:2-2:ImportFrom"] == {"app/__init__.py:1-1:Assign"}
    assert links["app/core.py:3-3:ImportFrom"] == {"app/util.py:1-1:Assign", "app/util.py:3-4:FunctionDef"}
    assert links["app/core.py:26-27:FunctionDef"] == core("21-21:Assign", "33-34:FunctionDef", "23-24:FunctionDef")  # a default, a member, and what __init__ sets
    assert "app/core.py:29-31:FunctionDef" not in links  # a static method has no receiver
    assert links["app/core.py:33-34:FunctionDef"] == core("26-27:FunctionDef")
    assert links["app/core.py:21-21:Assign"] == core("4-7:If")
    assert links["app/__init__.py:2-2:ImportFrom"] == core("9-13:FunctionDef")


def test_owners_closures_and_options(spark, made):
    spans = spark.createDataFrame([(1, 0, "app/core.py", 12, 12), (1, 1, "app/core.py", 1, 3), (2, 0, "app/util.py", 3, 4)], "query_id long, rank int, path string, start_line int, end_line int")
    owners = {(r.query_id, r["rank"]): r.owner for r in made.owners(spans).collect()}
    assert owners == {(1, 0): "app/core.py:9-13:FunctionDef", (1, 1): None, (2, 0): "app/util.py:3-4:FunctionDef"}
    for mode, options in (("raw", {2}), ("unit", {1, 2}), ("links2", {0, 1, 2})):
        rows = made.options(spans, mode).collect()
        assert {r.option for r in rows if (r.query_id, r["rank"]) == (1, 0)} == options
        assert {r.option for r in rows if (r.query_id, r["rank"]) == (1, 1)} == {2}
    wide = {(r.path, r.start_line, r.end_line) for r in rows if (r.query_id, r["rank"], r.option) == (1, 0, 0)}
    assert wide == {("app/core.py", 1, 7), ("app/core.py", 9, 13), ("app/core.py", 16, 18), ("app/__init__.py", 1, 1), ("app/util.py", 1, 1), ("app/util.py", 3, 4)}
    with pytest.raises(ValueError):
        made.options(spans, "links3")


def plain_assembly(options, texts, budget):
    """The same with sets of lines."""
    shown = {}

    def pieces(lines):
        out = []
        for path in sorted(lines):
            for n in sorted(lines[path]):
                if out and out[-1][0] == path and out[-1][2] == n - 1:
                    out[-1][2] = n
                else:
                    out.append([path, n, n])
        return out

    def render(lines):
        return "\n\n".join(f"[Source: {p}:{a}-{b}]\n" + "\n".join(texts[p].split("\n")[a - 1 : b]) for p, a, b in pieces(lines))

    taken = []
    for rank in sorted(options):
        for option in sorted(options[rank]):
            wider = {p: set(n) for p, n in shown.items()}
            for p, a, b in options[rank][option]:
                wider.setdefault(p, set()).update(range(a, b + 1))
            if max(1, len(render(wider)) // 4) <= budget:
                shown = wider
                taken.append((rank, option))
                break
    unmet = [r for r, _ in taken if not all(set(range(a, b + 1)) <= shown.get(p, set()) for p, a, b in options[r][min(options[r])])]
    return [tuple(x) for x in pieces(shown)], max(1, len(render(shown)) // 4) if shown else 0, taken, unmet


@pytest.mark.parametrize("seed", range(3))
def test_assembly_against_sets_of_lines(spark, seed):
    rng = random.Random(seed)
    texts = {f"f{i}": "\n".join("x" * rng.randrange(0, 60) for _ in range(80)) for i in range(4)}
    rows, want = [], {}
    for q in range(6):
        options = {}
        for rank in range(12):
            for option in rng.sample([0, 1, 2], rng.randrange(1, 4)):
                spans = []
                for _ in range(rng.randrange(1, 4)):
                    a = rng.randrange(1, 81)
                    spans.append((f"f{rng.randrange(4)}", a, rng.randrange(a, 81)))
                options.setdefault(rank, {})[option] = spans
                rows += [(q, rank, option, *s) for s in spans]
        want[q] = plain_assembly(options, texts, 800)
    df = spark.createDataFrame(rows, "query_id long, rank int, option int, path string, start_line int, end_line int")
    queries = spark.createDataFrame([(q,) for q in range(7)], "query_id long")
    out = {r.query_id: r for r in passages.assemble(df, spark.createDataFrame(list(texts.items()), "path string, text string"), queries, budget=800).collect()}
    for q, (pieces, tokens, taken, unmet) in want.items():
        r = out[q]
        assert ([tuple(p) for p in r.pieces], r.tokens, r.n_taken, r.unmet) == (pieces, tokens, len(taken), unmet)
    assert out[6].status == "fallback_required" and out[6].tokens == 0 and out[6].pieces is None


def test_passages_end_at_blank_lines_and_unseen_ones(spark):
    lines = [f"l{i}" for i in range(1, 31)]
    lines[4] = lines[19] = " "  # lines 5 and 20
    files = spark.createDataFrame([("a", "\n".join(lines))], "path string, text string")
    blocks = spark.createDataFrame([("a", i, 3 * i + 1, 3 * i + 3) for i in range(10)], "path string, ordinal int, start_line int, end_line int")
    seed = spark.createDataFrame([(1, 0, "a", 3), (2, 0, "a", 9)], "query_id long, rank int, path string, ordinal int")
    got = lambda mode: sorted((r.query_id, r.start_line, r.end_line) for r in passages.passage_options(seed, blocks, files, mode).where("option = 0").collect())
    assert got("seed") == [] and got("neighbor1") == [(1, 7, 15), (2, 25, 30)] and got("neighbor2") == [(1, 4, 18), (2, 22, 30)]
    assert got("paragraph") == [(1, 6, 19), (2, 21, 30)]
    assert passages.tokens_of(passages.united([("a", 1, 2, 0, 5), ("a", 3, 3, 6, 8)])) == len("[Source: a:1-3]\n12345678") // 4
