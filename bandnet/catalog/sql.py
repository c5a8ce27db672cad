"""SQL text for checking the library's results with DuckDB.

The network statements spell forward and backward passes out as joins and sums over long tables
``(id, f, v)``, with weights generated from their position, so they share no code with the
library.
"""

from __future__ import annotations

from collections.abc import Sequence

from bandnet.functions.counter import PRIME, round_keys

EMBEDDING_ROWS = (
    "x AS MATERIALIZED (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS f, "
    "unnest(embedding)::double AS v FROM embeddings)"
)
LABEL_ROWS = "y AS MATERIALIZED (SELECT vec_id AS id, label FROM embeddings)"
SCALED_ROWS = (
    "raw AS MATERIALIZED (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS f, "
    "unnest(embedding)::double AS v FROM embeddings), "
    "bounds AS MATERIALIZED (SELECT f, min(v) AS lo, max(v) AS hi FROM raw GROUP BY f), "
    "x AS MATERIALIZED (SELECT id, raw.f, (v - lo) / (hi - lo) AS v FROM raw JOIN bounds ON raw.f = bounds.f)"
)
# A target vector for every row: its features from last to first
REVERSED_ROWS = "t AS MATERIALIZED (SELECT id, 63 - f AS f, v FROM x)"
ROWS = "(SELECT count(*) FROM embeddings)"


def r(expr: str, digits: int = 6) -> str:
    """Round and turn a negative zero into zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def formula(position: str) -> str:
    """The repeatable weight at a flat position."""
    return f"((({position}) * 7919 + 13) % 1000)::double / 1000 - 0.5"


def with_(ctes: Sequence[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def weight_ctes(sizes: Sequence[int], tag: str = "") -> list[str]:
    """Formula weights ``w<l>(f, h, v)`` and biases ``b<l>(h, v)``, output index fastest."""
    out, at = [], 0
    for layer, (inputs, outputs) in enumerate(zip(sizes, sizes[1:]), 1):
        cells = inputs * outputs
        out.append(
            f"w{layer}{tag} AS MATERIALIZED (SELECT i // {outputs} AS f, i % {outputs} AS h, "
            f"{formula(f'i + {at}')} AS v FROM range({cells}) t(i))"
        )
        out.append(
            f"b{layer}{tag} AS MATERIALIZED (SELECT i AS h, {formula(f'i + {at + cells}')} AS v FROM range({outputs}) t(i))"
        )
        at += cells + outputs
    return out


ACTIVATE = {"relu": "greatest({0}, 0.0)", "sigmoid": "1.0 / (1.0 + exp(-({0})))", "identity": "{0}"}
SLOPE = {"relu": "CASE WHEN {0} > 0 THEN 1.0 ELSE 0.0 END", "sigmoid": "(1.0 - {0}) * {0}"}


def forward_ctes(sizes: Sequence[int], tag: str = "", hidden: str = "relu", top: str = "softmax") -> list[str]:
    """Layer outputs ``a<l>(id, f, v)``; the last one is the network's output."""
    out, count = [], len(sizes) - 1
    for layer in range(1, count + 1):
        source = "x" if layer == 1 else f"a{layer - 1}{tag}"
        total = "sum(s.v * w.v) + any_value(b.v)"
        body = (
            f"FROM {source} s JOIN w{layer}{tag} w ON s.f = w.f JOIN b{layer}{tag} b ON b.h = w.h GROUP BY s.id, w.h"
        )
        if layer < count or top in ACTIVATE:
            kind = hidden if layer < count else top
            out.append(f"a{layer}{tag} AS MATERIALIZED (SELECT s.id, w.h AS f, {ACTIVATE[kind].format(total)} AS v {body})")
        else:
            out.append(f"z{tag} AS MATERIALIZED (SELECT s.id, w.h AS f, {total} AS v {body})")
            out.append(
                f"e{tag} AS MATERIALIZED (SELECT id, f, v, v - max(v) OVER (PARTITION BY id) AS c FROM z{tag})"
            )
            out.append(
                f"a{layer}{tag} AS MATERIALIZED (SELECT id, f, exp(c) / sum(exp(c)) OVER (PARTITION BY id) AS v, "
                f"c - ln(sum(exp(c)) OVER (PARTITION BY id)) AS logp FROM e{tag})"
            )
    return out


def error_cte(sizes: Sequence[int], tag: str = "", target: str = "label") -> str:
    """The output's error ``err(id, f, v)`` against the label, the input or a target column ``t``."""
    top = f"a{len(sizes) - 1}{tag}"
    if target == "label":
        return (
            f"err{tag} AS MATERIALIZED (SELECT a.id, a.f, a.v - (CASE WHEN y.label = a.f THEN 1.0 ELSE 0.0 END) AS v, "
            f"a.v AS o FROM {top} a JOIN y ON a.id = y.id)"
        )
    sought = {"input": "x", "column": "t"}[target]
    return (
        f"err{tag} AS MATERIALIZED (SELECT a.id, a.f, a.v - s.v AS v, a.v AS o "
        f"FROM {top} a JOIN {sought} s ON a.id = s.id AND a.f = s.f)"
    )


def gradient_ctes(
    sizes: Sequence[int], tag: str = "", hidden: str = "relu", top: str = "softmax", rows: str = ROWS
) -> list[str]:
    """Mean gradients ``gw<l>(f, h, v)`` and ``gb<l>(h, v)`` from the error by back-propagation."""
    count = len(sizes) - 1
    scale = "v * (o - o * o)" if top == "sigmoid" else "v"
    out = [f"d{count}{tag} AS MATERIALIZED (SELECT id, f, {scale} AS v FROM err{tag})"]
    for layer in range(count, 0, -1):
        source = "x" if layer == 1 else f"a{layer - 1}{tag}"
        out.append(
            f"gw{layer}{tag} AS MATERIALIZED (SELECT s.f, d.f AS h, sum(d.v * s.v) / {rows} AS v "
            f"FROM d{layer}{tag} d JOIN {source} s ON d.id = s.id GROUP BY s.f, d.f)"
        )
        out.append(
            f"gb{layer}{tag} AS MATERIALIZED (SELECT f AS h, sum(v) / {rows} AS v FROM d{layer}{tag} GROUP BY f)"
        )
        if layer > 1:
            slope = SLOPE[hidden].format("any_value(a.v)")
            out.append(
                f"d{layer - 1}{tag} AS MATERIALIZED (SELECT d.id, w.f, sum(d.v * w.v) * ({slope}) AS v "
                f"FROM d{layer}{tag} d JOIN w{layer}{tag} w ON d.f = w.h "
                f"JOIN a{layer - 1}{tag} a ON a.id = d.id AND a.f = w.f GROUP BY d.id, w.f)"
            )
    return out


def step_ctes(sizes: Sequence[int], tag: str, after: str, step: float) -> list[str]:
    """Weights after one constant step down the gradient."""
    out = []
    for layer in range(1, len(sizes)):
        out.append(
            f"w{layer}{after} AS MATERIALIZED (SELECT w.f, w.h, w.v - {step}::double * g.v AS v "
            f"FROM w{layer}{tag} w JOIN gw{layer}{tag} g ON w.f = g.f AND w.h = g.h)"
        )
        out.append(
            f"b{layer}{after} AS MATERIALIZED (SELECT b.h, b.v - {step}::double * g.v AS v "
            f"FROM b{layer}{tag} b JOIN gb{layer}{tag} g ON b.h = g.h)"
        )
    return out


def layered_select(sizes: Sequence[int], matrix: str, bias: str, value: str, digits: int = 9, tag: str = "") -> str:
    """Weights or gradients of all layers as ``(layer, input, output, <value>)``."""
    parts = []
    for layer in range(1, len(sizes)):
        parts.append(
            f"SELECT {layer - 1}::int AS layer, f::int AS input, h::int AS output, {r('v', digits)} AS {value} FROM {matrix}{layer}{tag}"
        )
        parts.append(
            f"SELECT {layer - 1}::int AS layer, -1::int AS input, h::int AS output, {r('v', digits)} AS {value} FROM {bias}{layer}{tag}"
        )
    return "\nUNION ALL ".join(parts)


def eliminate_ctes(source: str, size: int, tag: str = "") -> list[str]:
    """Solve the positive definite system ``a<i><j>, b<i>`` of one row by elimination.

    The last table, ``solved<tag>``, holds the unknowns as ``w0, w1, …``.
    """
    out, previous = [], source
    for k in range(size):
        cells = []
        for i in range(size):
            for j in list(range(k, size)) + [None]:
                name = f"b{i}" if j is None else f"a{i}{j}"
                pivot_row = f"b{k}" if j is None else f"a{k}{j}"
                if i == k:
                    cells.append(f"{pivot_row} / a{k}{k} AS {name}")
                else:
                    cells.append(f"{name} - a{i}{k} * {pivot_row} / a{k}{k} AS {name}")
        out.append(f"step{k}{tag} AS MATERIALIZED (SELECT {', '.join(cells)} FROM {previous})")
        previous = f"step{k}{tag}"
    out.append(f"solved{tag} AS (SELECT {', '.join(f'b{i} AS w{i}' for i in range(size))} FROM {previous})")
    return out


def permuted(counter: str, seed: int, table: str, columns: str) -> str:
    """A statement that replaces ``counter`` of a table by the generator's number ``p``, round by round."""
    inner = f"SELECT {columns}, ({counter}) % {PRIME} AS p FROM {table}"
    for key in round_keys(seed):
        inner = f"SELECT {columns}, (p + {key}) % {PRIME} AS p FROM ({inner})"
        inner = f"SELECT {columns}, p, p * p % {PRIME} AS s FROM ({inner})"
        inner = f"SELECT {columns}, s * s % {PRIME} * p % {PRIME} AS p FROM ({inner})"
    return inner


def row_counter(key: str) -> str:
    """The counter of a row by its key."""
    return f"('0x' || substr(md5('sample:' || {key}::varchar), 1, 15))::bigint % {PRIME}"
