"""Small helpers to write the check SQL."""

from __future__ import annotations

from collections.abc import Sequence

from contract.derived import duckdb_ctes


def rnd(x: str, digits: int = 6) -> str:
    """Half-up rounding of the decimal form, binary noise dropped first."""
    return f"cast(round(cast({x} as decimal(38, 10)), {digits}) as double)"


def pct(part: str, whole: str, digits: int = 6) -> str:
    return rnd(f"(({part}) * 100.0::double / nullif({whole}, 0))", digits)


def big(x: str) -> str:
    return f"cast({x} as bigint)"


def quant(x: str, q: float) -> str:
    return f"quantile_cont({x}, {q})"


def ladder(x: str, edges: Sequence, labels: Sequence) -> str:
    """CASE over rising edges; text labels are quoted."""

    def show(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    steps = " ".join(f"when {x} < {e} then {show(v)}" for e, v in zip(edges, labels))
    return f"case {steps} else {show(labels[-1])} end"


def over(tables: str, body: str) -> str:
    """Query with the derived tables it names in front."""
    ctes = duckdb_ctes(tables.split())
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
