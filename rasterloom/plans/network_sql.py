"""Networks as SQL: one table expression for each layer, for holding a forward pass against another engine.

A layer is a table (t, axes..., c, v): tile, place, channel and value.  Convolutions join places with the taps of a kernel
and sum; weights come from the rule of Network.rule_weights, so the text grows with the layers and not with the weights.
"""

from __future__ import annotations

import math

from rasterloom.operators.nn import Network


def _own(name: str, step: int, c: str) -> str:
    """The weight of channel c by the rule."""
    return {
        "bias": f"(({c} * 17 + {step * 31}) % 7 / 50.0E0 - 0.06E0)", "gamma": f"(1 + ({c} + {step}) % 3 / 10.0E0)", "beta": f"(({c} + {step}) % 5 / 20.0E0 - 0.1E0)",
        "mean": f"(({c} * 3 + {step}) % 4 / 10.0E0)", "variance": f"(1 + ({c} + {step}) % 2 / 2.0E0)",
    }[name]


def _activated(v: str, kind: str | None) -> str:
    return {None: v, "relu": f"greatest({v}, 0.0E0)", "sigmoid": f"1 / (1 + exp(-({v})))"}[kind]


def network_sql(net: Network, size: int, source: str) -> tuple[str, str]:
    """(table expressions, name of the last one) for the network over a table `source` (t, axes..., c, v)."""
    axes = "zyx"[-net.space :]
    places, tables, sizes = ", ".join(axes), [], [size]
    names = [source]

    def add(step: int, body: str, extent: int) -> None:
        tables.append(f"a{step} AS MATERIALIZED ({body})")
        names.append(f"a{step}")
        sizes.append(extent)

    for k, step in enumerate(net.steps):
        if not k:
            continue
        a, n = names[step.reads[0]], sizes[step.reads[0]]
        if step.op in ("conv", "deconv"):
            shape = step.shapes["kernel"]
            side, cin, cout = shape[0], shape[-2], shape[-1]
            spread = repr(math.sqrt(6 / math.prod(shape[:-1])))
            digits = [f"i // {cout * cin * side**e} % {side} AS d{x}" for e, x in enumerate(reversed(axes))]
            tables.append(f"w{k} AS MATERIALIZED (SELECT {', '.join(digits)}, i // {cout} % {cin} AS ci, i % {cout} AS co, (((i * 7919 + {k * 104729 + 12345}) % 10007) / 5003.5E0 - 1.0E0) * {spread}E0 AS w FROM (SELECT unnest(range({math.prod(shape)})) AS i))")
            if step.op == "conv":
                pad = (side - 1) // 2 if step.options["padding"] == "same" else 0
                extent = n if step.options["padding"] == "same" else n - side + 1
                at = [f"{x} - d{x} + {pad}" for x in axes]
            else:
                extent, at = 2 * n, [f"2 * {x} + d{x}" for x in axes]
            inside = " AND ".join(f"{p} BETWEEN 0 AND {extent - 1}" for p in at)
            listed = ", ".join(f"{p} AS {x}" for p, x in zip(at, axes, strict=True))
            bias = f" + {_own('bias', k, 'c')}" if "bias" in step.shapes else ""
            summed = f"SELECT t, {listed}, co AS c, sum(v * w) AS v FROM {a} JOIN w{k} ON c = ci WHERE {inside} GROUP BY ALL"
            add(k, f"SELECT t, {places}, c, {_activated(f'v{bias}', step.options['activation'])} AS v FROM ({summed})", extent)
        elif step.op == "norm":
            own = lambda name, k=k: _own(name, k, "c")
            add(k, f"SELECT t, {places}, c, (v - {own('mean')}) / sqrt({own('variance')} + 1e-3) * {own('gamma')} + {own('beta')} AS v FROM {a}", n)
        elif step.op == "pool":
            halves = ", ".join(f"{x} // 2 AS {x}" for x in axes)
            add(k, f"SELECT t, {halves}, c, max(v) AS v FROM {a} WHERE {' AND '.join(f'{x} < {n // 2 * 2}' for x in axes)} GROUP BY ALL", n // 2)
        elif step.op == "repeat":
            twice = ", ".join(f"2 * {x} + d{x} AS {x}" for x in axes)
            add(k, f"SELECT t, {twice}, c, v FROM {a}, {', '.join(f'(SELECT unnest([0, 1]) AS d{x})' for x in axes)}", 2 * n)
        elif step.op == "crop":
            extent = sizes[step.reads[1]]
            low = (n - extent) // 2
            add(k, f"SELECT t, {', '.join(f'{x} - {low} AS {x}' for x in axes)}, c, v FROM {a} WHERE {' AND '.join(f'{x} BETWEEN {low} AND {low + extent - 1}' for x in axes)}", extent)
        elif step.op == "concat":
            starts = [sum(net.channels[r] for r in step.reads[:j]) for j in range(len(step.reads))]
            add(k, " UNION ALL ".join(f"SELECT t, {places}, c + {s} AS c, v FROM {names[r]}" for s, r in zip(starts, step.reads, strict=True)), n)
        elif step.op == "add_relu":
            add(k, f"SELECT t, {places}, c, greatest(p.v + q.v, 0.0E0) AS v FROM {a} p JOIN {names[step.reads[1]]} q USING (t, {places}, c)", n)
        elif step.op == "times":  # a map of one channel times all channels
            add(k, f"SELECT t, {places}, p.c, p.v * q.v AS v FROM {a} p JOIN (SELECT t, {places}, v FROM {names[step.reads[1]]} WHERE c = 0) q USING (t, {places})", n)
        else:
            raise ValueError(f"no SQL for {step.op}")
    return ", ".join(tables), names[-1]
