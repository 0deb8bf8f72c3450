"""Composing checker SQL: named CTE bodies, pulled in by the names a query mentions."""

from __future__ import annotations

import re


class Ctes:
    def __init__(self):
        self.bodies: dict[str, str] = {}

    def add(self, name: str, body: str, materialize: bool = True) -> None:
        mark = " AS MATERIALIZED " if materialize else " AS "
        self.bodies[name] = f"{name}{mark}({body.strip()})"

    def raw(self, name: str, text: str) -> None:
        """A chunk that already defines `name` (and its helpers)."""
        self.bodies[name] = text.strip()

    def compose(self, select: str) -> str:
        needed, queue = set(), [select]
        while queue:
            text = queue.pop()
            for name in self.bodies:
                if name not in needed and re.search(rf"\b{name}\b", text):
                    needed.add(name)
                    queue.append(self.bodies[name])
        used = [b for n, b in self.bodies.items() if n in needed]
        recursive = "RECURSIVE " if any("UNION ALL" in b and "/*recursive*/" in b for b in used) else ""
        select = select.strip()
        if not used:
            return select
        head = f"WITH {recursive}" + ",\n".join(used)
        return f"{head},\n{select[5:]}" if select.startswith("WITH ") else f"{head}\n{select}"


def r(expr: str, digits: int, name: str) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"
