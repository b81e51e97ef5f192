"""Oracle SQL built from named steps; each step lists the steps it reads."""

from __future__ import annotations

STEPS: dict[str, tuple[list[str], str]] = {}


def q(s: str) -> str:
    """SQL text literal."""
    return "'" + s.replace("'", "''") + "'"


def step(name: str, deps: str, body: str) -> None:
    STEPS[name] = (deps.split(), body)


def query(select: str, deps: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in STEPS[n][0]:
            visit(d)
        order.append(n)

    for d in deps.split():
        visit(d)
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{STEPS[n][1].strip()}\n)" for n in order)
    return f"WITH {ctes}\n{select.strip()}" if ctes else select.strip()


def rep(expr: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"
    return expr


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def norm(e: str) -> str:
    return f"lower({strip(f'coalesce({e}, {q(str())})')})"
