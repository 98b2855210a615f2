"""The SQL front end: SELECT goes to Spark over views of the tables it names; other statements are parsed here."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from docquill.errors import InvalidQuery

_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^']|'')*')|(?P<quoted>"[^"]*"|`[^`]*`)|(?P<number>[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+)|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<sign><>|!=|>=|<=|\|\||[-+*/%(),.;=<>]))""")


def tokenize(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, position) of each token."""
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise InvalidQuery(f"can't read the statement at: {text[at:at + 20]}")
        out.append((m.lastgroup, m.group(m.lastgroup), m.start(m.lastgroup)))
        at = m.end()
    return out


def tables_in(text: str) -> list[str]:
    """Names after FROM and JOIN, and after commas of a FROM list, that aren't subqueries."""
    tokens, out, listing, depth = tokenize(text), [], None, 0
    for k, (kind, word, _) in enumerate(tokens):
        upper = word.upper() if kind == "word" else word
        if upper == "(":
            depth += 1
        elif upper == ")":
            depth -= 1
            listing = None if listing is not None and depth < listing else listing
        elif kind == "word" and upper in ("FROM", "JOIN"):
            listing = depth
        elif kind == "word" and upper in ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "ON", "SELECT", "UNION", "EXCEPT", "INTERSECT"):
            listing = None
        before = tokens[k - 1][1].upper() if k else ""
        if kind in ("word", "quoted") and (before in ("FROM", "JOIN") or (before == "," and listing == depth and listing is not None)) and upper not in ("SELECT", "LATERAL"):
            out.append(word.strip('"`'))
    return list(dict.fromkeys(out))


def select(spark: SparkSession, text: str, tables: Callable[[str], DataFrame]) -> DataFrame:
    """A query over tables looked up by name. Names bound by WITH are left alone.

    The views live in the session under names of their own, so queries of several databases don't meet.
    """
    bound = {w.lower() for w in re.findall(r"(?i)(?:\bWITH\b|,)\s*([A-Za-z_]\w*)\s+AS\s*\(", text)}
    names = [n for n in tables_in(text) if n.lower() not in bound]
    suffix = uuid.uuid4().hex[:12]
    out, last = [], 0
    tokens = tokenize(text)
    for name in names:
        tables(name).createOrReplaceTempView(f"{name}_{suffix}")
    for k, (kind, word, at) in enumerate(tokens):
        bare = word.strip('"`')
        before = tokens[k - 1][1].upper() if k else ""
        if kind in ("word", "quoted") and bare in names and before in ("FROM", "JOIN", ","):
            after = tokens[k + 1] if k + 1 < len(tokens) else ("", "", 0)
            if before == "," and after[1] in (".", "("):
                continue
            keywords = ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "ON", "UNION", "EXCEPT", "INTERSECT", "USING", "NATURAL", "SEMI", "ANTI", "LATERAL")
            named = after[0] == "quoted" or (after[0] == "word" and after[1].upper() not in keywords)
            out += [text[last:at], f"`{bare}_{suffix}`" + ("" if named else f" AS `{bare}`")]
            last = at + len(word)
    try:
        return spark.sql("".join([*out, text[last:]]).strip().rstrip(";"))
    finally:  # the query holds what the views stood for
        for name in names:
            spark.catalog.dropTempView(f"{name}_{suffix}")


@dataclass
class Statement:
    kind: str
    table: str = ""
    columns: list[str] = field(default_factory=list)
    rows: list[list[Any]] = field(default_factory=list)
    assignments: list[tuple[str, str]] = field(default_factory=list)
    where: str | None = None


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, [t for t in tokenize(text) if t[1] != ";"], 0

    def peek(self) -> str:
        return self.tokens[self.at][1].upper() if self.at < len(self.tokens) else ""

    def take(self, *words: str) -> str:
        if words and self.peek() not in words:
            raise InvalidQuery(f"expected {' or '.join(words)} at: {self.peek() or 'the end'}")
        if self.at >= len(self.tokens):
            raise InvalidQuery("the statement ends too early")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        kind, word, _ = self.tokens[self.at] if self.at < len(self.tokens) else ("", "", 0)
        if kind not in ("word", "quoted"):
            raise InvalidQuery(f"expected a name at: {word or 'the end'}")
        self.at += 1
        return word.strip('"`')

    def names(self) -> list[str]:
        self.take("(")
        out = [self.name()]
        while self.take(",", ")") == ",":
            out.append(self.name())
        return out

    def value(self) -> Any:
        sign = 1
        while self.peek() in ("-", "+"):
            sign *= -1 if self.take() == "-" else 1
        kind, word, _ = self.tokens[self.at] if self.at < len(self.tokens) else ("", "", 0)
        self.at += 1
        if kind == "number":
            return sign * (int(word) if word.isdigit() else float(word))
        if kind == "text":
            return word[1:-1].replace("''", "'")
        if kind in ("word", "quoted"):
            return {"NULL": None, "TRUE": True, "FALSE": False}.get(word.upper(), word.strip('"`')) if kind == "word" else word[1:-1]
        raise InvalidQuery(f"expected a value at: {word or 'the end'}")

    def until(self, *words: str) -> str:
        """The text up to a word outside parentheses, or the end."""
        start, depth = self.at, 0
        while self.at < len(self.tokens) and not (depth == 0 and self.peek() in words):
            depth += {"(": 1, ")": -1}.get(self.peek(), 0)
            self.at += 1
        if start == self.at:
            raise InvalidQuery("an expression is missing")
        stop = self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.text)
        return self.text[self.tokens[start][2] : stop].strip().rstrip(";").strip()


def parse(text: str) -> Statement:
    """One statement; SELECT and WITH are left to Spark."""
    r = _Reader(text)
    verb = r.peek()
    if verb in ("SELECT", "WITH", "VALUES", "("):
        return Statement("select")
    r.take("INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "SHOW")
    if verb == "INSERT":
        r.take("INTO")
        out = Statement("insert", r.name(), r.names())
        r.take("VALUES")
        while True:
            r.take("(")
            row = [r.value()]
            while r.take(",", ")") == ",":
                row.append(r.value())
            if len(row) != len(out.columns):
                raise InvalidQuery(f"{len(out.columns)} columns but {len(row)} values")
            out.rows.append(row)
            if r.peek() != ",":
                break
            r.take(",")
    elif verb == "UPDATE":
        out = Statement("update", r.name())
        r.take("SET")
        while True:
            column = r.name()
            r.take("=")
            out.assignments.append((column, r.until(",", "WHERE")))
            if r.peek() != ",":
                break
            r.take(",")
    elif verb == "DELETE":
        r.take("FROM")
        out = Statement("delete", r.name())
    elif verb == "CREATE" and r.peek() == "TABLE":
        r.take()
        for word in ("IF", "NOT", "EXISTS"):
            if r.peek() == word:
                r.take()
        out = Statement("create_table", r.name())
        r.at = len(r.tokens)  # columns are those of the rows
    elif verb == "CREATE":
        kind = "create_unique_index" if r.peek() == "UNIQUE" and r.take() else "create_index"
        r.take("INDEX")
        if r.peek() != "ON":
            r.name()
        r.take("ON")
        out = Statement(kind, r.name(), r.names())
    elif verb == "DROP":
        r.take("TABLE")
        for word in ("IF", "EXISTS"):
            if r.peek() == word:
                r.take()
        out = Statement("drop_table", r.name())
    else:
        r.take("TABLES")
        out = Statement("show_tables")
    if verb in ("UPDATE", "DELETE") and r.peek() == "WHERE":
        r.take()
        out.where = r.until()
    if r.at < len(r.tokens):
        raise InvalidQuery(f"unexpected: {r.peek()}")
    return out
