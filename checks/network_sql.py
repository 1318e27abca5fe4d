"""The travel-time network as SQL: layers forward and in reverse over lists, weights from their rule."""

from __future__ import annotations

from checks.sql import num

WIDTH, BLOCKS, SCALE = 128, 5, 400.0


def weights(width: int = WIDTH, blocks: int = BLOCKS) -> str:
    """CTE ``net``: one row with the rows ``w<k>``, columns ``c<k>`` and biases ``b<k>`` of each layer."""
    sizes = [(width, 4)] + [(width, width)] * (2 * blocks) + [(1, width)]
    parts = []
    for k, (n_out, n_in) in enumerate(sizes):
        at = lambda i: f"sin(1e0 + 0.7e0 * ({i}) + {num(3.0 * k)}) / sqrt({num(n_in)})"
        rows = f"list_transform(range({n_out}), lambda r: list_transform(range({n_in}), lambda c: {at(f'r * {n_in} + c')}))"
        columns = f"list_transform(range({n_in}), lambda c: list_transform(range({n_out}), lambda r: {at(f'r * {n_in} + c')}))"
        parts += [f"{rows} AS w{k}", f"{columns} AS c{k}"]
        parts.append(f"list_transform(range({n_out}), lambda r: 0.1e0 * cos(r + {k})) AS b{k}")
    return f"net AS MATERIALIZED (SELECT {', '.join(parts)})"


def _through(k: str, a: str, bias: bool = True) -> str:
    rows = f"list_transform({k}, lambda v: list_dot_product(v, {a}))"
    return _by(rows, f"b{k[1:]}", "+") if bias else rows


def _elu(z: str) -> str:
    return f"list_transform({z}, lambda v: CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END)"


def _slope(z: str) -> str:
    return f"list_transform({z}, lambda v: CASE WHEN v > 0 THEN 1e0 ELSE exp(v) END)"


def _by(a: str, b: str, op: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda t: t[1] {op} t[2])"


def network(name: str, source: str, key: str, features: list[str], gradient: bool = False, blocks: int = BLOCKS) -> list[str]:
    """CTEs that end in ``name``: ``key``, ``c`` and, on request, the gradient list ``g`` of ``source``.

    ``features`` are the four inputs, expressions over ``source``.
    """
    last = 2 * blocks + 1
    kept = [key]
    ctes = [f"{name}_in AS (SELECT {key}, [{', '.join(features)}] AS f FROM {source})"]

    def stage(label: str, columns: dict[str, str], before: str, weighted: bool = True) -> str:
        made = ", ".join([*kept, *[f"{text} AS {c}" for c, text in columns.items()]])
        ctes.append(f"{label} AS MATERIALIZED (SELECT {made} FROM {before}{', net' if weighted else ''})")
        return label

    at = stage(f"{name}_z0", {"z": _through("w0", "f")}, f"{name}_in")
    slopes = {"s0": _slope("z")} if gradient else {}
    at = stage(f"{name}_a0", {"a": _elu("z"), **slopes}, at, False)
    kept += list(slopes)
    for k in range(1, last, 2):
        at = stage(f"{name}_z{k}", {"a": "a", "z": _through(f"w{k}", "a")}, at)
        slopes = {f"s{k}": _slope("z")} if gradient else {}
        at = stage(f"{name}_a{k}", {"a": "a", "h": _elu("z"), **slopes}, at, False)
        kept += list(slopes)
        at = stage(f"{name}_z{k + 1}", {"a": "a", "z": _through(f"w{k + 1}", "h")}, at)
        slopes = {f"s{k + 1}": _slope("z")} if gradient else {}
        at = stage(f"{name}_a{k + 1}", {"a": _by(_elu("z"), "a", "+"), **slopes}, at, False)
        kept += list(slopes)
    raw = f"list_dot_product(w{last}[1], a) + b{last}[1]"
    if not gradient:
        stage(name, {"c": f"abs({raw})"}, at)
        return ctes
    at = stage(f"{name}_raw", {"c": raw}, at)
    at = stage(f"{name}_g", {"c": "abs(c)", "g": f"list_transform(w{last}[1], lambda v: v * sign(c))"}, at)
    # a lambda computes what it holds once per element, so products have stages of their own
    for k in range(last - 2, 0, -2):
        at = stage(f"{name}_p{k + 1}", {"c": "c", "g": "g", "t": _by("g", f"s{k + 1}", "*")}, at, False)
        at = stage(f"{name}_t{k + 1}", {"c": "c", "g": "g", "t": _through(f"c{k + 1}", "t", False)}, at)
        at = stage(f"{name}_p{k}", {"c": "c", "g": "g", "t": _by("t", f"s{k}", "*")}, at, False)
        at = stage(f"{name}_t{k}", {"c": "c", "g": "g", "t": _through(f"c{k}", "t", False)}, at)
        kept = [c for c in kept if c not in (f"s{k}", f"s{k + 1}")]
        at = stage(f"{name}_r{k}", {"c": "c", "g": _by("g", "t", "+")}, at, False)
    at = stage(f"{name}_p0", {"c": "c", "g": _by("g", "s0", "*")}, at, False)
    kept = [key]
    stage(name, {"c": "c", "g": _through("c0", "g", False)}, at)
    return ctes
