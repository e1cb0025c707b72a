"""Changes of fields and names told by MySQL table statements.

``actions`` reads one statement as sources send it (any case, quoting,
comments, several changes at once) and returns what it does to columns and
table names; everything else (indexes, defaults, options, comments) is no
action.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(r"""/\*.*?\*/|--[^\n]*|\#[^\n]*|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|[\w$]+|[^\s]""", re.S)

# Words of MySQL that begin a part of a table statement which is no column.
NO_COLUMN = {"primary", "key", "index", "unique", "constraint", "fulltext", "spatial", "foreign", "check", "partition"}


class Action(NamedTuple):
    """kind: create, add, drop, change, modify, rename_table, drop_table.  For
    create, ``columns`` lists (name, type word), None if unknown."""

    kind: str
    field: str = ""
    new_name: str = ""
    type_word: str = ""
    new_db: str = ""
    columns: tuple | None = None


class _Tokens(list):
    def word(self, i: int = 0) -> str:
        return self[i].lower() if i < len(self) else ""


def _tokens(sql: str) -> _Tokens:
    found = (m.group() for m in _TOKEN.finditer(sql))
    return _Tokens(t for t in found if not t.startswith(("/*", "--", "#")))


def _name(token: str) -> str:
    return (token[1:-1].replace("``", "`") if token.startswith("`") else token).strip().lower()


def _commas(tokens: list[str]) -> list[_Tokens]:
    """Splits at commas outside brackets."""
    parts, depth = [_Tokens()], 0
    for t in tokens:
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        if t == "," and depth == 0:
            parts.append(_Tokens())
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def _table(tokens: _Tokens) -> tuple[str, str, _Tokens]:
    """(db, table, rest)."""
    if len(tokens) > 2 and tokens[1] == ".":
        return _name(tokens[0]), _name(tokens[2]), _Tokens(tokens[3:])
    return "", _name(tokens[0]) if tokens else "", _Tokens(tokens[1:])


def _skip(tokens: _Tokens, *words: str) -> _Tokens:
    """Drops the words if the tokens begin with all of them."""
    if all(tokens.word(i) == w for i, w in enumerate(words)):
        return _Tokens(tokens[len(words) :])
    return tokens


def _column(tokens: _Tokens) -> tuple[str, str] | None:
    if len(tokens) < 2 or tokens.word() in NO_COLUMN:
        return None
    return _name(tokens[0]), tokens.word(1)


def _inside(tokens: _Tokens) -> _Tokens:
    """Tokens within the first pair of brackets."""
    depth, out = 0, _Tokens()
    for t in tokens:
        if t == ")":
            depth -= 1
            if depth == 0:
                break
        if depth:
            out.append(t)
        if t == "(":
            depth += 1
    return out


def _spec(s: _Tokens) -> list[Action]:
    first, s = s.word(), _Tokens(s[1:])
    if first == "add":
        if s.word() in NO_COLUMN:
            return []
        s = _skip(_skip(s, "column"), "if", "not", "exists")
        defs = _commas(_inside(s)) if s.word() == "(" else [s]
        return [Action("add", c[0], type_word=c[1]) for c in map(_column, defs) if c]
    if first == "drop":
        if s.word() in NO_COLUMN and s.word() != "column":
            return []
        s = _skip(_skip(s, "column"), "if", "exists")
        return [Action("drop", _name(s[0]))] if s else []
    if first == "change":
        s = _skip(_skip(s, "column"), "if", "exists")
        return [Action("change", _name(s[0]), _name(s[1]), s.word(2))] if len(s) > 2 else []
    if first == "modify":
        s = _skip(_skip(s, "column"), "if", "exists")
        return [Action("modify", _name(s[0]), type_word=s.word(1))] if len(s) > 1 else []
    if first == "rename":
        if s.word() == "column":
            return [Action("change", _name(s[1]), _name(s[3]))] if len(s) > 3 and s.word(2) == "to" else []
        if s.word() in ("index", "key"):
            return []
        if s.word() in ("to", "as", "="):
            s = _Tokens(s[1:])
        db, t, _ = _table(s)
        return [Action("rename_table", new_name=t, new_db=db)] if t else []
    return []


def actions(sql: str | None) -> list[tuple[str, str, Action]]:
    """(db, table, action) of one statement; db is empty where it names none."""
    t = _tokens(sql or "")
    while t and t[-1] == ";":
        t.pop()
    if t.word() == "rename" and t.word(1) in ("table", "tables"):
        out = []
        for pair in _commas(t[2:]):
            db, name, rest = _table(pair)
            if rest.word() == "to":
                new_db, new, _ = _table(_Tokens(rest[1:]))
                out.append((db, name, Action("rename_table", new_name=new, new_db=new_db)))
        return out
    if t.word() == "create":
        t = _Tokens(t[1:])
        t = _skip(_skip(t, "or", "replace"), "temporary")
        if t.word() != "table":
            return []
        t = _skip(_Tokens(t[1:]), "if", "not", "exists")
        db, name, rest = _table(t)
        cols = None
        if rest.word() == "(" and rest.word(1) != "like":
            cols = tuple(c for c in map(_column, _commas(_inside(rest))) if c)
        return [(db, name, Action("create", columns=cols))]
    if t.word() == "drop" and t.word(1) == "table":
        t = _skip(_Tokens(t[2:]), "if", "exists")
        return [(_table(p)[0], _table(p)[1], Action("drop_table")) for p in _commas(t)]
    if t.word() == "alter":
        t = _Tokens(t[1:])
        while t.word() in ("online", "offline", "ignore"):
            t = _Tokens(t[1:])
        if t.word() != "table":
            return []
        db, name, rest = _table(_skip(_Tokens(t[1:]), "if", "exists"))
        return [(db, name, a) for spec in _commas(rest) for a in _spec(spec)]
    return []
