"""Statements on tables, rewritten for the table they are routed to."""

from __future__ import annotations

from collections.abc import Callable

from driftline.functions.ddl import _name, _table, _Tokens, _tokens

Route = Callable[[str, str], tuple[str, str] | None]


def _quoted(db: str, tbl: str) -> str:
    return ".".join("`" + n.replace("`", "``") + "`" for n in (db, tbl) if n)


def _text(tokens: list[str]) -> str:
    out = ""
    for t in tokens:
        glue = not out or t in (",", ")", ".", ";") or out[-1] in "(." or (t == "(" and not out.endswith(" "))
        out += t if glue else " " + t
    return out


def retarget(sql: str, db: str, route: Route) -> list[str]:
    """The statements to run at the target, none for tables without a route
    and for statements that aren't carried over (truncate, indexes, views).
    ``db`` is the schema the statement ran in; CREATE and DROP become IF [NOT]
    EXISTS so that they may run again."""
    t = _tokens(sql)
    while t and t[-1] == ";":
        t.pop()
    word, kind = t.word(), t.word(1)

    def to(d: str, name: str) -> str | None:
        hit = route(d or db, name)
        return None if hit is None else _quoted(*hit)

    if word in ("create", "drop") and kind in ("database", "schema"):
        rest = _Tokens(t[2:])
        while rest.word() in ("if", "not", "exists"):
            rest = _Tokens(rest[1:])
        hit = route(_name(rest[0]), "*") if rest else None
        return [] if hit is None else [f"{word.upper()} DATABASE IF {'NOT ' if word == 'create' else ''}EXISTS {_quoted(hit[0], '')}"]
    if word == "create" and kind in ("table", "temporary"):
        rest = _Tokens(t[3:] if kind == "temporary" else t[2:])
        while rest.word() in ("if", "not", "exists"):
            rest = _Tokens(rest[1:])
        d, name, body = _table(rest)
        target = to(d, name)
        if target is None:
            return []
        if body.word() == "like" or (body.word() == "(" and body.word(1) == "like"):
            like = _table(_Tokens([x for x in body if x not in "()"][1:]))
            source = to(like[0], like[1])
            return [] if source is None else [f"CREATE TABLE IF NOT EXISTS {target} LIKE {source}"]
        return [f"CREATE TABLE IF NOT EXISTS {target} {_text(body)}"]
    if word == "drop" and kind == "table":
        rest, out = _Tokens(t[2:]), []
        while rest.word() in ("if", "exists"):
            rest = _Tokens(rest[1:])
        while rest:
            d, name, rest = _table(rest)
            if (target := to(d, name)) is not None:
                out.append(f"DROP TABLE IF EXISTS {target}")
            rest = _Tokens(rest[1:])
        return out
    if word == "alter" and kind == "table":
        d, name, body = _table(_Tokens(t[2:]))
        target = to(d, name)
        return [] if target is None else [f"ALTER TABLE {target} {_text(body)}"]
    if word == "rename" and kind in ("table", "tables"):
        rest, out = _Tokens(t[2:]), []
        while rest:
            d, name, rest = _table(rest)
            d2, name2, rest = _table(_Tokens(rest[1:]))
            rest = _Tokens(rest[1:])
            a, b = to(d, name), to(d2, name2)
            if a is not None and b is not None:
                out.append(f"RENAME TABLE {a} TO {b}")
        return out
    return []


def annotated(sql: str, note: str) -> str:
    """The statement with a comment before it that tells who wrote it; the
    note can't end the comment."""
    return f"/*{note.replace('*/', '* /')}*/{sql}" if note else sql
