"""Views of a query that propose seeds: expanded terms, spelled-out identifiers, its questions, its operations, and when its
wording asks for a relation."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import STOPWORDS

#: Runs of capitals before a capitalised word or the end, capitalised or small words, digits (fixed forms).
_EXPANDED = r"[A-Z]+(?=[A-Z][a-z]|$)|[A-Z]?[a-z]+|\d+"
_COMPONENTS = r"[A-Z]+(?=[A-Z][a-z]|[0-9]|_|$)|[A-Z]?[a-z]+|[0-9]+"
#: Words that name the action of raising, and those that make its mention ambiguous (fixed values).
ACTION_WORDS = frozenset(("raise", "raises", "raised", "raising", "throw", "throws", "thrown"))
ABSTAIN_WORDS = frozenset((
    "not", "no", "never", "neither", "nor", "without", "cannot", "avoid", "avoids", "avoided", "avoiding", "prevent", "prevents", "prevented",
    "preventing", "catch", "catches", "caught", "catching", "handle", "handles", "handled", "handling", "suppress", "suppresses", "suppressed",
    "suppressing", "mention", "mentions", "mentioned", "mentioning", "literal", "literals", "string", "strings",
))
_SURFACE = r"(?U)(?<!\w)([^\W\d]\w*(?:\.[^\W\d]\w*)*)(?!\w)"
#: Calls whose target is only known when they run (fixed values).
DYNAMIC = frozenset(("getattr", "setattr", "eval", "exec", "globals", "locals", "__import__", "import_module"))
#: Characters of code that is parsed at most.
PARSE_CHARS = 65536


def _list(values) -> Column:
    return F.array(*map(F.lit, sorted(values)))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _useful(terms: Column) -> Column:
    return F.filter(terms, lambda t: (F.length(t) > 2) & ~F.array_contains(_list(STOPWORDS), t))


def expanded_terms(query: Column) -> Column:
    """Words in lower case, then the parts of those written with capitals or underscores: each once, no stop words, three
    letters at least."""
    words = _all(query, r"(?U)\w+")
    parts = F.flatten(F.transform(words, lambda w: F.flatten(F.transform(F.split(w, "_"), lambda p: _all(p, _EXPANDED)))))
    return F.array_distinct(_useful(F.transform(F.concat(words, parts), F.lower)))


def spelled_parts(word: Column) -> Column:
    """The parts of an identifier that its lower-case form does not give; empty where it has one part only."""
    parts = F.transform(_all(word, _COMPONENTS), F.lower)
    extra = F.array_distinct(F.filter(_useful(parts), lambda p: p != F.lower(word)))
    return F.when(F.size(parts) > 1, extra).otherwise(F.array().cast("array<string>"))


def spelling_additions(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, word, part) for query words (query_id, word) that the vocabulary (term) lacks in lower case: what they spell."""
    missing = words.withColumn("term", F.lower("word")).join(vocabulary.select("term").distinct(), "term", "left_anti")
    return missing.select("query_id", "word", F.explode(spelled_parts(F.col("word"))).alias("part")).distinct()


def questions(query: Column) -> Column:
    """The sentences of a query that end in a question mark, by lines; the whole query where there is none."""
    asked = F.filter(F.transform(F.split(query, r"(?<=[.!?;])\s+"), F.trim), lambda s: s.endswith("?"))
    return F.when(F.size(asked) > 0, F.array_join(asked, "\n")).otherwise(query)


def intent_relations(query: Column, names: Column, mode: str) -> Column:
    """The names of raises relations that a query's wording supports.

    ``original`` keeps all and ``disabled`` none; ``action`` keeps them if a whole word names the action; ``conservative`` does
    unless a word or contraction makes that ambiguous, and then those only that the query names.
    """
    if mode in ("original", "disabled"):
        return names if mode == "original" else F.filter(names, lambda n: F.lit(False))
    hits = F.transform(_all(query, _SURFACE, 1), F.lower)
    acts = F.arrays_overlap(hits, _list(ACTION_WORDS))
    none = F.filter(names, lambda n: F.lit(False))
    if mode == "action":
        return F.when(acts, names).otherwise(none)
    if mode != "conservative":
        raise ValueError(f"unknown mode {mode}")
    unclear = F.arrays_overlap(hits, _list(ABSTAIN_WORDS)) | query.rlike(r"(?iU)\b\w+n['’]t\b")
    said = F.array_union(hits, F.flatten(F.transform(hits, lambda h: F.split(h, r"\."))))
    return F.when(acts & ~unclear, F.filter(names, lambda n: F.array_contains(said, n))).otherwise(none)


class _Operations(ast.NodeVisitor):
    """What a module does, as events of place and name, and what only a run would tell."""

    def __init__(self, first_line: int):
        self.first_line, self.events, self.unknown = first_line, [], set()

    def _event(self, node: ast.AST, name: str) -> None:
        self.events.append((self.first_line + node.lineno, node.col_offset, name))

    def visit_Call(self, node: ast.Call) -> None:
        match node.func:
            case ast.Name(id=name) | ast.Attribute(attr=name):
                self._event(node.func, name)
                if name in DYNAMIC:
                    self.unknown.add(f"what {name} reaches")
            case _:
                self.unknown.add("a computed call target")
        for passed in node.keywords:
            if passed.arg is None:
                self.unknown.add("unpacked keywords")
            else:
                self._event(passed, f"{passed.arg}={ast.unparse(passed.value)}")
        self.generic_visit(node)

    def visit_withitem(self, node: ast.withitem) -> None:
        if isinstance(node.context_expr, ast.Attribute):
            self._event(node.context_expr, node.context_expr.attr)
        self.generic_visit(node)


_FENCE, _DEFINES = re.compile(r"```(python|py)?[ \t\r]*"), re.compile(r"(async[ \t]+)?(def|class)[ \t]")


def _fenced(lines: list[str]) -> list[tuple[int, str]]:
    """(line, code) of closed fences, of Python or of no named language."""
    out, begin = [], None
    for i, line in enumerate(lines):
        if begin is None:
            if _FENCE.fullmatch(line):
                begin = i + 1
        elif line.rstrip(" \t\r") == "```":
            out.append((begin, "\n".join(lines[begin:i]) + "\n"))
            begin = None
    return out


def operation_names(query: str) -> tuple[list[str], list[str]]:
    """(operations, uncertainty) of the Python code in a query: the names that it calls, the keywords that it passes with what they are
    given, and the attributes that it enters as contexts, each once, in the order of the text.

    Code is what closed fences hold; without any, the query as a whole or else its rest from the first definition on from which it
    parses. Code that does not parse has no operations. uncertainty names what only a run would tell, and code of over
    PARSE_CHARS characters, which is not parsed."""
    lines = query.split("\n")
    parts, found, unknown = _fenced(lines), [], set()
    whole = not parts
    if whole:
        starts = [0, *(i for i, line in enumerate(lines) if i and _DEFINES.match(line))]
        parts = [(i, "\n".join(lines[i:])) for i in starts]
    for first_line, code in parts:
        if len(code) > PARSE_CHARS:
            unknown.add("code too long to parse")
            continue
        try:
            tree = ast.parse(code)
            seen = _Operations(first_line)
            seen.visit(tree)
        except (SyntaxError, ValueError, RecursionError):
            continue
        found += seen.events
        unknown |= seen.unknown
        if whole:
            break
    return list(dict.fromkeys(name for *_, name in sorted(found))), sorted(unknown)


def operations(queries: DataFrame) -> DataFrame:
    """(query_id, operations, uncertainty) for a table (query_id, query): Python parses, as only a parser tells a call."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            both = [operation_names(q or "") for q in f["query"]]
            yield pd.DataFrame({"query_id": f["query_id"], "operations": [list(a) for a, _ in both], "uncertainty": [list(b) for _, b in both]})

    kind = dict(queries.dtypes)["query_id"]
    return queries.select("query_id", "query").mapInPandas(parsed, f"query_id {kind}, operations array<string>, uncertainty array<string>")
