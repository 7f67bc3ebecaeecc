"""Edit distance and script of ordered labelled trees (Zhang and Shasha), one pair of trees a row."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCRIPT = "cost int, ops array<struct<op:string,label:string,to:string>>"


def postorder(nodes: list[tuple[int, int | None, int, str]]) -> tuple[list[str], list[int], list[int]]:
    """labels, leftmost leaf of each (1-based) and key roots; nodes: (node, parent, pos, label) with one root."""
    children: dict[int | None, list[tuple[int, int]]] = {}
    label = {}
    for node, up, pos, text in nodes:
        children.setdefault(up, []).append((pos, node))
        label[node] = text
    labels, left, number = [""], [0], {}
    for _, root in sorted(children.get(None, [])):
        work = [(root, False)]
        while work:
            v, done = work.pop()
            below = [c for _, c in sorted(children.get(v, []))]
            if not done and below:
                work.append((v, True))
                work += [(c, False) for c in reversed(below)]
                continue
            labels.append(label[v])
            number[v] = len(labels) - 1
            left.append(left[number[below[0]]] if below else number[v])
    last = {}
    for i in range(1, len(labels)):
        last[left[i]] = i
    return labels, left, sorted(last.values())


def edit_script(a, b) -> tuple[int, list[tuple[str, str, str | None]]]:
    """Cost and operations (match, relabel, delete, insert) that turn tree a into tree b; unit costs. Ties prefer a deletion,
    then an insertion, then keeping."""
    (la, lefta, roota), (lb, leftb, rootb) = a, b
    n, m = len(la) - 1, len(lb) - 1
    tree = [[0] * (m + 1) for _ in range(n + 1)]

    def forest(i: int, j: int, fill: bool) -> list[list[int]]:
        i0, j0 = lefta[i] - 1, leftb[j] - 1
        d = [[0] * (j - j0 + 1) for _ in range(i - i0 + 1)]
        for x in range(1, i - i0 + 1):
            d[x][0] = x
        for y in range(1, j - j0 + 1):
            d[0][y] = y
        for x in range(1, i - i0 + 1):
            for y in range(1, j - j0 + 1):
                p, q = i0 + x, j0 + y
                best = min(d[x - 1][y], d[x][y - 1]) + 1
                if lefta[p] == lefta[i] and leftb[q] == leftb[j]:
                    d[x][y] = min(best, d[x - 1][y - 1] + (la[p] != lb[q]))
                    if fill:
                        tree[p][q] = d[x][y]
                else:
                    d[x][y] = min(best, d[lefta[p] - 1 - i0][leftb[q] - 1 - j0] + tree[p][q])
        return d

    for i in roota:
        for j in rootb:
            forest(i, j, True)
    if not n or not m:
        ops = [("delete", x, None) for x in la[1:]] + [("insert", x, None) for x in lb[1:]]
        return n + m, ops
    ops, work = [], [(n, m)]
    while work:
        i, j = work.pop()
        d = forest(i, j, False)
        i0, j0 = lefta[i] - 1, leftb[j] - 1
        x, y = i - i0, j - j0
        while x or y:
            p, q = i0 + x, j0 + y
            if x and d[x][y] == d[x - 1][y] + 1:
                ops.append(("delete", la[p], None))
                x -= 1
            elif y and d[x][y] == d[x][y - 1] + 1:
                ops.append(("insert", lb[q], None))
                y -= 1
            elif lefta[p] == lefta[i] and leftb[q] == leftb[j]:
                ops.append(("match", la[p], None) if la[p] == lb[q] else ("relabel", la[p], lb[q]))
                x, y = x - 1, y - 1
            else:
                work.append((p, q))
                x, y = lefta[p] - 1 - i0, leftb[q] - 1 - j0
    return tree[n][m], ops[::-1]


def with_moves(ops: list[tuple[str, str, str | None]]) -> list[tuple[str, str, str | None]]:
    """Deletions and insertions of one label become moves, as many as the lesser count, from the left; the cost stays."""
    gone, come = Counter(o[1] for o in ops if o[0] == "delete"), Counter(o[1] for o in ops if o[0] == "insert")
    pairs = {k: min(gone[k], come[k]) for k in gone}
    drop, out = dict(pairs), []
    for op, label, to in ops:
        if op == "delete" and pairs.get(label, 0):
            pairs[label] -= 1
            out.append(("moved", label, None))
        elif op == "insert" and drop.get(label, 0):
            drop[label] -= 1
        else:
            out.append((op, label, to))
    return out


def tree_diff(trees: DataFrame, moves: bool = True) -> DataFrame:
    """pair_id, cost, ops. trees: pair_id, side (base or head), node, parent (null: root), pos, label."""
    row = F.struct(*(F.col(c).cast("long").alias(c) for c in ("node", "parent", "pos")), "label")
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, row))).alias(s)

    @F.pandas_udf(SCRIPT)
    def script(base: pd.Series, head: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(base, head, strict=True):
            rows = [[(int(r["node"]), None if pd.isna(r["parent"]) else int(r["parent"]), int(r["pos"]), r["label"]) for r in x] for x in (a, b)]
            cost, ops = edit_script(*map(postorder, rows))
            out.append((cost, [dict(zip(("op", "label", "to"), o, strict=True)) for o in (with_moves(ops) if moves else ops)]))
        return pd.DataFrame(out, columns=["cost", "ops"])

    both = trees.groupBy("pair_id").agg(of("base"), of("head"))
    return both.select("pair_id", script("base", "head").alias("s")).select("pair_id", "s.cost", "s.ops")
