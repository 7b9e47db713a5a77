"""Full-text search: a token index and its query language.

Words in a row must all occur, in any columns; OR, NOT and parentheses, "phrases", word*, column:term,
NEAR(a b, n) and ^first narrow it down. A query reads the index once: the words of all its phrases are picked by
token, shifted to their phrase's start and counted there; what phrases a file has is then one small set, on which
AND, OR and NOT are decided. NEAR looks ahead from each occurrence by a window over its field's hits.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import INDEXED


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


class QuerySyntaxError(ValueError):
    """A query that the language doesn't have."""


#: Accents that NFD leaves as marks, taken off letter by letter; ø, ß, œ and others stay.
MARKED = "àáâãäåāăąèéêëēĕėęěìíîïĩīĭįòóôõöōŏőùúûüũūŭůűųçćĉċčñńņňýÿŷśŝşšźżžĝğġģťţřŕŗ"
PLAIN = "aaaaaaaaaeeeeeeeeeiiiiiiiioooooooouuuuuuuuuucccccnnnnyyysssszzzggggttrrr"


def folded(c: Column) -> Column:
    return F.translate(F.lower(c), MARKED, PLAIN)


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(MARKED, PLAIN))


def words_of(text: Column) -> Column:
    """The words of a text in lower case, accents as they are, perhaps with empty ones at its ends; null for none."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}\p{Co}]+")


def token_index(videos: DataFrame, columns: list[str] = INDEXED, keep: list[str] | None = None) -> DataFrame:
    """(file_id, field, pos, token): the words of all indexed columns; keep: the columns that come along instead of file_id."""
    keep = keep or ["file_id"]
    texts = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns if c in videos.columns))
    rows = videos.select(*keep, F.explode(texts).alias("t")).where(F.col("t.text").isNotNull() & (F.col("t.text") != ""))
    words = F.filter(F.split(folded(F.col("t.text")), r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")
    return rows.select(*keep, "t.field", F.posexplode(words).alias("pos", "token"))


def refresh(index: DataFrame, changed: DataFrame) -> DataFrame:
    """index with the tokens of the changed rows (merged ones, so edits stay) in place of their old ones."""
    return index.join(changed.select("file_id"), "file_id", "left_anti").unionByName(token_index(changed))


def backfill(index: DataFrame, videos: DataFrame) -> DataFrame:
    """index with the tokens of the files that it has none of."""
    return index.unionByName(token_index(videos.join(index.select("file_id"), "file_id", "left_anti")))


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False
    first: bool = False
    column: str = ""
    near: int | None = None
    parts: list[Phrase] = field(default_factory=list)


LEX = re.compile(r'\s*(?:(?P<quote>"(?:[^"]|"")*")|(?P<mark>[():,*^])|(?P<word>[\w\x80-￿]+))')


def lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while query[at:].strip():
        m = LEX.match(query, at)
        if not m:
            raise QuerySyntaxError(f"unexpected {query[at:].strip()[0]!r}")
        kind = m.lastgroup or ""
        out.append((kind, m[kind]))
        at = m.end()
    return out


class Parser:
    """Recursive descent; binding: NOT, then AND (also by mere juxtaposition), then OR."""

    def __init__(self, query: str):
        self.tokens, self.at = lex(query), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, value: str) -> bool:
        if self.peek() == (("mark" if not value.isalpha() else "word"), value):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise QuerySyntaxError(f"{value!r} is missing")

    def parse(self):
        out = self.either()
        if self.peek()[0] != "end":
            raise QuerySyntaxError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("OR"):
            out = ("or", out, self.both())
        return out

    def both(self):
        out = self.but()
        while True:
            if self.take("AND") or (self.peek()[0] in ("quote", "word") and self.peek()[1] not in ("OR", "NOT")) or self.peek()[1] in ("(", "^"):
                out = ("and", out, self.but())
            else:
                return out

    def but(self):
        out = self.atom("")
        while self.take("NOT"):
            out = ("not", out, self.atom(""))
        return out

    def atom(self, column: str):
        kind, value = self.peek()
        if kind == "word" and self.peek(1) == ("mark", ":") and not column:
            self.at += 2
            if value.lower() not in INDEXED:
                raise QuerySyntaxError(f"no such column: {value}")
            return self.atom(value.lower())
        if self.take("("):
            if column:
                raise QuerySyntaxError("a column takes a word or phrase")
            out = self.either()
            self.need(")")
            return out
        if kind == "word" and value == "NEAR" and self.peek(1) == ("mark", "("):
            self.at += 2
            parts, near = [], 10
            while self.peek()[0] in ("word", "quote"):
                parts.append(self.phrase(column))
            if self.take(","):
                near = int(self.peek()[1]) if self.peek()[1].isdigit() else None
                if near is None:
                    raise QuerySyntaxError("NEAR takes a number")
                self.at += 1
            self.need(")")
            if not parts:
                raise QuerySyntaxError("NEAR takes words")
            return Phrase([], column=column, near=near, parts=parts)
        return self.phrase(column, self.take("^"))

    def phrase(self, column: str, first: bool = False) -> Phrase:
        kind, value = self.peek()
        if kind not in ("word", "quote") or (kind == "word" and value in ("AND", "OR", "NOT")):
            raise QuerySyntaxError(f"a word is missing at {value!r}")
        self.at += 1
        text = value[1:-1].replace('""', '"') if kind == "quote" else value
        words = [w for w in re.split(r"[\W_]+", fold_text(text)) if w]
        return Phrase(words, prefix=self.take("*"), first=first, column=column)


def phrases_of(node, out: list[Phrase]) -> list[Phrase]:
    """All phrases of a query that occurrences are looked for, NEAR's parts too."""
    if isinstance(node, Phrase):
        if node.near is None:
            out.append(node)
        else:
            for part in node.parts:
                part.column = part.column or node.column
                out.append(part)
    else:
        phrases_of(node[1], out)
        phrases_of(node[2], out)
    return out


def _nears(node, out: list[Phrase]) -> list[Phrase]:
    if isinstance(node, Phrase):
        return out + [node] if node.near is not None else out
    return _nears(node[2], _nears(node[1], out))


def occurrences(index: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """(file_id, field, phrase, start) of all occurrences of all phrases, from one pass over the index."""
    tests, wanted = [], F.lit(False)
    for n, p in enumerate(phrases):
        here = F.col("field") == p.column if p.column else F.lit(True)
        for k, w in enumerate(p.words):
            hit = F.col("token").startswith(w) if p.prefix and k == len(p.words) - 1 else F.col("token") == w
            wanted = wanted | hit
            start = F.col("pos") - k
            hit = hit & here & (start == 0) if p.first else hit & here
            tests.append(F.when(hit, F.struct(F.lit(n).alias("phrase"), F.lit(k).alias("k"), start.alias("start"))))
    if not tests:
        return index.where("false").select("file_id", "field", F.lit(0).alias("phrase"), F.col("pos").alias("start"))
    hits = index.where(wanted).select("file_id", "field", F.explode(F.array_compact(F.array(*tests))).alias("h")).select("file_id", "field", "h.*")
    if all(len(p.words) < 2 for p in phrases):
        return hits.select("file_id", "field", "phrase", "start")
    sizes = F.element_at(F.array(*(F.lit(len(p.words)) for p in phrases)), F.col("phrase") + 1)
    whole = hits.groupBy("file_id", "field", "phrase", "start").agg(F.count_distinct("k").alias("n"))
    return whole.where(F.col("n") == sizes).select("file_id", "field", "phrase", "start")


def near_files(found: DataFrame, near: Phrase, numbers: list[int], sizes: list[int]) -> DataFrame:
    """(file_id) in which every part occurs in one field with at most ``near.near`` words between its first and last:
    from every occurrence, the nearest one of each part at or after it."""
    rows = found.where(F.col("phrase").isin(numbers))
    ahead = Window.partitionBy("file_id", "field").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    nearest = [F.min(F.when(F.col("phrase") == n, F.col("start"))).over(ahead).alias(f"at{n}") for n in numbers]
    end = F.col("start") + F.element_at(F.array(*(F.lit(x) for x in sizes)), F.col("phrase") + 1)
    rows = rows.select("file_id", end.alias("end"), *nearest)
    fits = F.greatest(*(F.col(f"at{n}") for n in numbers), F.lit(-1)) - F.col("end") <= near.near
    for n in numbers:
        fits = fits & F.col(f"at{n}").isNotNull()
    return rows.where(fits).select("file_id").distinct()


def search_index(index: DataFrame, query: str) -> DataFrame:
    """The distinct file_ids that a query finds; QuerySyntaxError for one that can't be read."""
    if not query.strip():
        raise QuerySyntaxError("an empty query")
    tree = Parser(query).parse()
    phrases, nears = phrases_of(tree, []), _nears(tree, [])
    found = occurrences(index, phrases)
    sizes = [len(p.words) for p in phrases]
    number = {id(p): n for n, p in enumerate(phrases)}
    held = found.select("file_id", "phrase")
    for k, near in enumerate(nears):
        numbers = [number[id(p)] for p in near.parts]
        number[id(near)] = len(phrases) + k
        held = held.unionByName(near_files(found, near, numbers, sizes).select("file_id", F.lit(len(phrases) + k).alias("phrase")))
    sets = held.groupBy("file_id").agg(F.collect_set("phrase").alias("has"))  # as many as the query has phrases, at most

    def holds(node) -> Column:
        if isinstance(node, Phrase):
            return F.array_contains("has", number[id(node)])
        kind, a, b = node
        left, right = holds(a), holds(b)
        return left | right if kind == "or" else left & right if kind == "and" else left & ~right

    return sets.where(holds(tree)).select("file_id")
