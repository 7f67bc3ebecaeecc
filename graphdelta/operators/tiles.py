"""Nodes in files that tasks meet by name: a pair of nodes is two numbers wherever it goes, and a task that scores pairs holds the two
tiles of nodes that they are of. Nothing of a node is sent along with its pairs.

A node's number is the number of its tile and its row there. Tokens are 64-bit hashes; two nodes of one pair and kind share a token if
they share its hash.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from graphdelta.functions.similarity import Weights

#: Nodes and tokens of a tile, bits of a row in a node's number, tokens that are matched at once.
TILE_NODES, TILE_TOKENS, ROW_BITS, TILE_BITS, AT_ONCE = 4096, 1 << 21, 16, 16, 1 << 21
LISTS = ("km", "kt", "tn", "kn")


def _place(folder: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(folder) if re.match(r"\w[\w+.-]+:", folder) else (pafs.LocalFileSystem(), folder)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


@dataclass
class Tile:
    """Per node the sorted tokens of members (km), of types (kt) with their counts (tn), of neighbours (kn); mo, to, no: where they start.
    doc: a hash of the documentation, known: whether there is any."""

    km: np.ndarray
    kt: np.ndarray
    tn: np.ndarray
    kn: np.ndarray
    mo: np.ndarray
    to: np.ndarray
    no: np.ndarray
    doc: np.ndarray
    known: np.ndarray

    def write(self, folder: str, name: str) -> None:
        fs, path = _place(folder)
        fs.create_dir(path, recursive=True)
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        with fs.open_output_stream(f"{path}/{name}") as f:
            f.write(out.getbuffer())

    @staticmethod
    def read(folder: str, name: str) -> Tile:
        fs, path = _place(folder)
        with fs.open_input_file(f"{path}/{name}") as f:
            return Tile(**np.load(io.BytesIO(f.read())))


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return own.flatten().to_numpy(zero_copy_only=False), sizes


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most TILE_NODES nodes and about TILE_TOKENS tokens."""
    weight = sum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in LISTS)
    ends, lo = _offsets(weight), 0
    while lo < batch.num_rows:
        hi = min(lo + TILE_NODES, max(lo + 1, int(np.searchsorted(ends, ends[lo] + TILE_TOKENS, side="right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def tile_of(batch: pa.RecordBatch) -> Tile:
    out = {}
    for keys, at in (("km", "mo"), ("kt", "to"), ("kn", "no")):
        flat, sizes = _flat(batch.column(keys))
        order = np.lexsort((flat, np.repeat(np.arange(len(sizes)), sizes)))
        out[keys], out[at] = flat[order], _offsets(sizes)
        if keys == "kt":
            out["tn"] = _flat(batch.column("tn"))[0][order]
    return Tile(**out, doc=batch.column("doc").to_numpy(zero_copy_only=False), known=batch.column("known").to_numpy(zero_copy_only=False))


def prefix(tile: Tile, often: tuple[np.ndarray, np.ndarray], c: float, share: float, w: Weights) -> list[tuple[np.ndarray, ...]]:
    """Per side (members, types): (nodes, tokens, weight before each) of the rarest tokens that a partner must share one of, in the order
    of how many pairs a token makes, as far as `often` (tokens in order, pairs of each) knows, and of the token."""
    m, t = np.diff(tile.mo), np.diff(_offsets(tile.tn)[tile.to])
    alone = lambda own, other: max((c - other) / own, 0.0) if own > 0 else 0.0
    out = []
    for keys, at, weight, own, other, mine, rest in ((tile.km, tile.mo, np.ones(len(tile.km), np.int64), m, t, w.members, w.field_types), (tile.kt, tile.to, tile.tn.astype(np.int64), t, m, w.field_types, w.members)):
        if mine <= 0 or not len(keys):
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        node = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.minimum(np.searchsorted(often[0], keys), max(len(often[0]) - 1, 0))
        df = np.where(often[0][place] == keys, often[1][place], 0) if len(often[0]) else np.zeros(len(keys), np.int64)
        order = np.lexsort((keys, df, node))
        keys, node, weight = keys[order], node[order], weight[order]
        run = _offsets(weight)
        before = run[:-1] - run[at[node]]
        least = np.where(other == 0, alone(mine, rest), share)[node]
        need = np.maximum(own[node] - np.ceil(own[node] * (least - 1e-9)) + 1, 1)
        keep = (before < need) | (least <= 0)
        out.append((node[keep], keys[keep], before[keep]))
    return out


def _common(a: np.ndarray, ao: np.ndarray, b: np.ndarray, bo: np.ndarray, i: int, js: np.ndarray, an: np.ndarray | None = None, bn: np.ndarray | None = None) -> np.ndarray:
    """Of node i of one tile with nodes js of another: how many tokens they share, or the sums of the lesser counts."""
    own = a[ao[i] : ao[i + 1]]
    lo, sizes = bo[js], bo[js + 1] - bo[js]
    at = _offsets(sizes)
    if not len(own) or not at[-1]:
        return np.zeros(len(js), np.int64)
    take = np.arange(at[-1]) + np.repeat(lo - at[:-1], sizes)
    keys = b[take]
    place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    hit = (own[place] == keys).astype(np.int64)
    if an is not None:
        hit *= np.minimum(an[ao[i] : ao[i + 1]][place], bn[take])
    return np.diff(_offsets(hit)[at])


def _ratio(common: np.ndarray, every: np.ndarray) -> np.ndarray:
    common = common.astype(np.float64)
    return np.where(every == 0, 1.0, common / np.maximum(every - common, 1))


def scores(r: Tile, a: Tile, rows: np.ndarray, others: np.ndarray, w: Weights) -> np.ndarray:
    """similarity() of pairs (row of r, row of a), rows in order."""
    out = np.zeros(len(rows))
    rt, at = np.diff(_offsets(r.tn)[r.to]), np.diff(_offsets(a.tn)[a.to])
    rm, am, rn, an = (np.diff(x) for x in (r.mo, a.mo, r.no, a.no))
    bare = not len(r.kn) and not len(a.kn)
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    room = max(1, AT_ONCE // max(1, int(np.max(am, initial=1)), int(np.max(np.diff(a.to), initial=1))))
    for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True):
        i = rows[lo]
        for x in range(lo, hi, room):
            js = others[x : min(x + room, hi)]
            j = _ratio(_common(r.km, r.mo, a.km, a.mo, i, js), rm[i] + am[js])
            mj = _ratio(_common(r.kt, r.to, a.kt, a.to, i, js, r.tn, a.tn), rt[i] + at[js])
            nj = 1.0 if bare else _ratio(_common(r.kn, r.no, a.kn, a.no, i, js), rn[i] + an[js])
            same = ((r.doc[i] == a.doc[js]) & r.known[i] & a.known[js]).astype(np.float64)
            out[x : x + len(js)] = (j * w.members + mj * w.field_types + nj * w.neighbors + same * w.doc) / w.total
    return out
