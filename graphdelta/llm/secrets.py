"""Secret scans: three fixed patterns, and probabilistic automata learned from labelled credentials.

Base patterns find assignments, access keys and long hex strings (leftmost, non-overlapping per kind). Beyond them:

1. One pass over all texts gathers labelled credentials, the values that the base patterns find (per kind all distinct ones of at most
   LONGEST characters; Spark counts their characters and their sequences of symbols, see 2), and the background: counts of each credential character after another in
   everything else. Labelled pairs (format, value) may be given besides; FORMATS makes some of public formats.
2. Each format gets an automaton: its examples' prefix tree, whose states are merged where their counts, and those of all that
   follows, are statistically compatible (Hoeffding's bound, as in the ALERGIA algorithm). Symbols of the tree are the characters of the
   examples' common prefix, and behind it marks and one class of letters and digits, so that trees stay narrow enough to learn
   lengths; the class hands out its probability by the format's own counts of characters.
3. Every candidate is scored: the log-likelihood under each format's automaton, the end included, less that under the background, a
   bigram model of characters. A candidate is a run of credential characters, or a part of it between separators (= / .), of
   LEAST characters at least and PIECES parts at most; among overlapping ones those of the greatest sum count. One beyond CUT becomes a span of kind ``auto``,
   whether or not a base span covers it.

Cases: a null text counts as empty and has no spans; repeated rows each get their row; an empty table gives no rows;
columns beyond doc_id and text, of any type, pass through redact() and are ignored else; whole texts are scanned, whatever their
length; without any labelled credential there are no spans but the base ones.
"""

from __future__ import annotations

import math
import os
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdelta.llm._common import extended, materialize, ship, table

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "auto")
KEYWORDS = ("passw", "secret", "token", "api")
#: CUT: nats of evidence; a candidate has to be e^25 times likelier as a credential (there are many candidates).
LEAST, PIECES, LONGEST, ALPHA, CUT = 8, 8, 128, 0.05, 25.0
#: Share of characters that follow by chance in the background, so that marks which a corpus lacks are no evidence.
RARE = 0.01
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST)
PIECE = re.compile(r"[^=/.]+")

_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Public formats: (literal prefix, alphabet of the rest, lengths of the rest).
FORMATS = {
    "upper_hex": ("", _DIG + "ABCDEF", (32, 40, 64)),
    "code_host": ("ghp_", _UP + _LOW + _DIG, (36,)),
    "code_host_app": ("ghs_", _UP + _LOW + _DIG, (36,)),
    "payment": ("sk_live_", _UP + _LOW + _DIG, (24, 32)),
    "chat": ("xoxb-", _DIG + "-" + _UP + _LOW, (40, 50)),
    "maps": ("AIza", _UP + _LOW + _DIG + "_-", (35,)),
    "web_token": ("eyJ", _UP + _LOW + _DIG + "_-", (60, 90)),
    "base64": ("", _UP + _LOW + _DIG + "+/", (40, 44)),
}


def examples(per_format: int = 120, seed: int = 20) -> list[tuple[str, str]]:
    """Labelled credentials of the public formats, the same on every machine."""
    rng = random.Random(seed)
    return [(name, prefix + "".join(rng.choice(rest) for _ in range(rng.choice(lengths)))) for name, (prefix, rest, lengths) in FORMATS.items() for _ in range(per_format)]


CHARS = _UP + _LOW + _DIG + "+/_=.-"
ANY, SMOOTH = "any", 0.001
#: Symbols behind a prefix, for smoothing.
KINDS_OF_SYMBOLS = 1 + sum(not c.isalnum() for c in CHARS)


@dataclass
class Automaton:
    """States after merging: per state the counts of each symbol taken and of ends, and the state that a symbol leads to. A symbol
    that a state never took leaves the state as it is."""

    taken: list[dict[str, int]]
    ends: list[int]
    next: list[dict[str, int]]

    def log(self, state: int, s: str | None) -> float:
        """Log-probability of a symbol, or of the end."""
        total = sum(self.taken[state].values()) + self.ends[state] + SMOOTH * (KINDS_OF_SYMBOLS + 1)
        return math.log(((self.ends[state] if s is None else self.taken[state].get(s, 0)) + SMOOTH) / total)


def common_prefix(first: str, last: str, shortest: int) -> str:
    """That of all values between the first and the last in order; it leaves a character of the shortest."""
    prefix = os.path.commonprefix([first, last])
    return prefix if shortest > len(prefix) else prefix[:-1]


class Grammar:
    """A format: the automaton of its examples, their common prefix, and the counts of letters and digits behind it. shapes: how many
    examples have each rest behind the prefix, with "a" for any letter or digit."""

    def __init__(self, prefix: str, rest: Counter, shapes: Counter):
        self.prefix = prefix
        total = sum(rest.values()) + 0.5 * 62
        self.share = {c: math.log((rest[c] + 0.5) / total) for c in CHARS if c.isalnum()}
        self.automaton = infer([[*prefix, *(ANY if c == "a" else c for c in s)] for s in shapes], times=list(shapes.values()))

    @classmethod
    def of(cls, values: list[str]) -> Grammar:
        prefix = common_prefix(min(values), max(values), min(map(len, values)))
        rests = [v[len(prefix) :] for v in values]
        return cls(prefix, Counter(c for r in rests for c in r if c.isalnum()), Counter("".join("a" if c.isalnum() else c for c in r) for r in rests))

    def log(self, state: int, c: str) -> tuple[float, int]:
        """Log-probability of a character in a state, and the next state. In states of the prefix it stands for itself first."""
        a = self.automaton
        s = c if c in a.next[state] or not c.isalnum() else ANY
        return a.log(state, s) + (self.share[c] if s == ANY else 0.0), a.next[state].get(s, state)

    def log_likelihood(self, value: str) -> float:
        state, out = 0, 0.0
        for c in value:
            own, state = self.log(state, c)
            out += own
        return out + self.automaton.log(state, None)


def infer(values: list[Sequence[str]], alpha: float = ALPHA, times: Sequence[int] | None = None) -> Automaton:
    """Merge the prefix tree of the values (each so many times): states in breadth-first order join the first earlier one that is compatible."""
    children: list[dict[str, int]] = [{}]
    visits, ends = [0], [0]
    taken: list[dict[str, int]] = [defaultdict(int)]
    for v, n in zip(values, times or [1] * len(values), strict=True):
        at = 0
        visits[0] += n
        for s in v:
            taken[at][s] += n
            if s not in children[at]:
                children[at][s] = len(children)
                children.append({})
                visits.append(0)
                ends.append(0)
                taken.append(defaultdict(int))
            at = children[at][s]
            visits[at] += n
        ends[at] += n
    bound_at = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return abs(a / max(n, 1) - b / max(m, 1)) > bound_at * (1 / math.sqrt(max(n, 1)) + 1 / math.sqrt(max(m, 1)))

    def compatible(p: int, q: int) -> bool:
        """q's subtree is a tree still, so the walk along both ends."""
        stack = [(p, q)]
        while stack:
            a, b = stack.pop()
            if differ(ends[a], visits[a], ends[b], visits[b]) or any(differ(taken[a].get(s, 0), visits[a], taken[b].get(s, 0), visits[b]) for s in {*taken[a], *taken[b]}):
                return False
            stack += [(children[a][s], children[b][s]) for s in {*children[a]} & {*children[b]} if children[a][s] != children[b][s]]
        return True

    def fold(p: int, q: int) -> None:
        """Add q's subtree to p."""
        stack = [(p, q)]
        while stack:
            a, b = stack.pop()
            if a == b:
                continue
            visits[a] += visits[b]
            ends[a] += ends[b]
            for s, n in taken[b].items():
                taken[a][s] += n
            for s, child in children[b].items():
                if s in children[a]:
                    stack.append((children[a][s], child))
                else:
                    children[a][s] = child

    red, kept = [0], {0}
    while True:
        # the first child of a kept state that is not yet kept or merged, in breadth-first order
        parent, s = next(((r, x) for r in red for x in sorted(children[r]) if children[r][x] not in kept), (None, None))
        if parent is None:
            break
        state = children[parent][s]
        into = next((r for r in red if compatible(r, state)), None)
        if into is None:
            red.append(state)
            kept.add(state)
        else:
            children[parent][s] = into
            fold(into, state)
    number = {r: i for i, r in enumerate(red)}
    return Automaton([dict(taken[r]) for r in red], [ends[r] for r in red], [{s: number[c] for s, c in children[r].items()} for r in red])


#: Background: of each character (0: none, at the start or after another one) how often each follows.
_CODE = np.zeros(256, np.uint8)
_CODE[np.frombuffer(CHARS.encode(), np.uint8)] = np.arange(1, len(CHARS) + 1)
SIDE = len(CHARS) + 1


def transitions(text: str) -> np.ndarray:
    """SIDE x SIDE counts: a row per preceding character, in column 0 the ends of runs."""
    code = np.concatenate([[0], _CODE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], [0]]).astype(np.int64)
    counts = np.bincount(code[:-1] * SIDE + code[1:], minlength=SIDE * SIDE).reshape(SIDE, SIDE)
    counts[0, 0] = 0
    return counts


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of the base patterns."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]


class Scanner:
    """All automata, as tables, with the background. background: SIDE x SIDE counts; learned: grammars of further formats."""

    def __init__(self, labelled: list[tuple[str, str]], background: np.ndarray, cut: float = CUT, learned: dict[str, Grammar] | None = None):
        by = defaultdict(list)
        for name, value in labelled:
            if value:
                by[name].append(value[:LONGEST])
        self.grammars = dict(sorted(({name: Grammar.of(values) for name, values in by.items()} | (learned or {})).items()))
        self.cut = cut
        counts = np.asarray(background, np.float64) + 0.5
        self.background = np.log((1 - RARE) * counts / counts.sum(axis=1, keepdims=True) + RARE / SIDE)
        states = max((len(g.automaton.ends) for g in self.grammars.values()), default=1)
        shape = (len(self.grammars), states, SIDE)
        self.next, self.logs, self.end = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape[:2])
        for f, g in enumerate(self.grammars.values()):
            for state in range(len(g.automaton.ends)):
                self.end[f, state] = g.automaton.log(state, None)
                for c in CHARS:
                    self.logs[f, state, _CODE[ord(c)]], self.next[f, state, _CODE[ord(c)]] = g.log(state, c)
        self.known: dict[str, list[tuple[int, int]]] = {}

    def likely(self, values: list[str]) -> np.ndarray:
        """Of each value (of credential characters) the best format's log-likelihood less the background's."""
        if not values or not self.grammars:
            return np.full(len(values), -np.inf)
        order = sorted(range(len(values)), key=lambda i: -len(values[i]))
        n = np.array([len(values[i]) for i in order])
        flat = _CODE[np.frombuffer("".join([values[i] for i in order]).encode(), np.uint8)].astype(np.int64)
        starts = np.cumsum(n) - n
        formats = np.arange(len(self.grammars))[:, None]
        state = np.zeros((len(self.grammars), len(values)), np.int64)
        own, other, before = np.zeros(state.shape), np.zeros(len(values)), np.zeros(len(values), np.int64)
        for j in range(int(n[0])):
            k = int(np.searchsorted(-n, -j, side="left"))  # how many are longer than j
            c = flat[starts[:k] + j]
            own[:, :k] += self.logs[formats, state[:, :k], c]
            state[:, :k] = self.next[formats, state[:, :k], c]
            other[:k] += self.background[before[:k], c]
            before[:k] = c
        own += self.end[formats, state]
        out = np.empty(len(values))
        out[order] = own.max(axis=0) - other - self.background[before, 0]
        return out

    def best_parts(self, runs: list[str]) -> list[list[tuple[int, int]]]:
        """Of each run the parts (start, end) that are credentials: of all choices without overlaps the one of the greatest sum of
        evidence beyond the cut."""
        parts, of, values = [], [], []
        for i, run in enumerate(runs):
            pieces = [m.span() for m in PIECE.finditer(run)] if any(c in run for c in "=/.") else [(0, len(run))]
            if len(pieces) > 1 or pieces and pieces[0] != (0, len(run)):
                spans = {(pieces[a][0], pieces[b][1]) for a in range(len(pieces)) for b in range(a, min(a + PIECES, len(pieces)))} | {(0, len(run))} | {(a, len(run)) for a, _ in pieces[-PIECES:]}
                spans = sorted(s for s in spans if s[1] - s[0] >= LEAST)
            else:
                spans = [(0, len(run))]
            parts += spans
            of += [i] * len(spans)
            values += [run[a:b] for a, b in spans]
        score = self.likely(values)
        found: list[list[tuple[int, int, float]]] = [[] for _ in runs]
        for k in np.flatnonzero(score > self.cut):
            found[of[k]].append((*parts[k], float(score[k]) - self.cut))
        return [_best_apart(x) if len(x) > 1 else [p[:2] for p in x] for x in found]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text (start, number of the kind, end), in order."""
        runs = [[(m.start(), m.group()) for m in CANDIDATE.finditer(t)] for t in texts]
        new = list({r for own in runs for _, r in own if r not in self.known})
        if len(self.known) + len(new) > 200_000:
            self.known.clear()
            new = list({r for own in runs for _, r in own})
        self.known.update(zip(new, self.best_parts(new), strict=True))
        known = self.known
        return [sorted([(a, k, b) for a, k, b, _ in base_spans(t)] + [(at + a, 3, at + b) for at, r in own if known[r] for a, b in known[r]]) for t, own in zip(texts, runs, strict=True)]


def _best_apart(parts: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The choice of parts (start, end, value) without overlaps that has the greatest sum, in order; of equal ones the first found."""
    parts = sorted(parts, key=lambda p: (p[1], p[0]))
    ends = [p[1] for p in parts]
    sums, back = [0.0], []  # the greatest sum of the first k parts, and whether the k-th is in it
    for k, (start, _, value) in enumerate(parts):
        before = bisect_right(ends, start, 0, k)
        back.append((before, sums[before] + value > sums[-1]))
        sums.append(max(sums[-1], sums[before] + value))
    out, k = [], len(parts)
    while k:
        before, taken = back[k - 1]
        if taken:
            out.append(parts[k - 1][:2])
        k = before if taken else k - 1
    return out[::-1]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def grammars(values: DataFrame) -> dict[str, Grammar]:
    """Of each kind the grammar of all its values (kind, value). The driver gets a row per kind, per character and per shape."""
    ends = values.groupBy("kind").agg(F.min("value").alias("first"), F.max("value").alias("last"), F.min(F.length("value")).alias("shortest")).collect()
    prefixes = {r["kind"]: common_prefix(r["first"], r["last"], r["shortest"]) for r in ends}
    if not prefixes:
        return {}
    behind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(len(p) + 1)) for k, p in prefixes.items()))
    rests = values.select("kind", F.col("value").substr(behind, F.lit(LONGEST)).alias("rest"))
    shapes = rests.select("kind", F.regexp_replace("rest", "[A-Za-z0-9]", "a").alias("s"))
    chars = rests.select("kind", F.explode(F.split("rest", "")).alias("s")).where(F.col("s").rlike("^[A-Za-z0-9]$"))
    counted = {}
    for name, df in (("shapes", shapes), ("chars", chars)):
        for r in df.groupBy("kind", "s").agg(F.count("*").alias("n")).collect():
            counted.setdefault((name, r["kind"]), Counter())[r["s"]] = r["n"]
    return {k: Grammar(p, counted.get(("chars", k), Counter()), counted["shapes", k]) for k, p in prefixes.items()}


def fit(docs: DataFrame, labelled: list[tuple[str, str]] | None = None, cut: float = CUT) -> Scanner:
    """Labelled credentials and background of docs (text), with the given labelled pairs (None: those of examples())."""
    ship(docs.sparkSession)

    def run(batches):
        counts = np.zeros((SIDE, SIDE), np.int64)
        for batch in batches:
            kinds, values = [], []
            for t in batch.column(0).to_pylist():
                found = base_spans(t) if t else []
                kinds += [KINDS[k] for _, k, _, v in found if len(v) <= LONGEST]
                values += [v for *_, v in found if len(v) <= LONGEST]
                if found:  # what the base patterns take is no background
                    chars = list(t)
                    for a, _, b, _ in found:
                        chars[a:b] = " " * (b - a)
                    t = "".join(chars)
                counts += transitions(t or "")
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.nulls(len(kinds), pa.int32()), pa.nulls(len(kinds), pa.int64())], names=["kind", "value", "at", "n"])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts.ravel()[at])], names=["kind", "value", "at", "n"])

    seen = materialize(docs.select("text").mapInArrow(run, "kind string, value string, at int, n long"), "credentials")
    background = np.zeros(SIDE * SIDE, np.int64)
    for r in seen.where("at IS NOT NULL").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most SIDE * SIDE rows
        background[r["at"]] = r.n
    pairs = list(labelled if labelled is not None else examples())
    values = seen.where("kind IS NOT NULL").select("kind", "value").distinct()
    if given := [(k, v[:LONGEST]) for k, v in pairs if k in KINDS[:3] and v]:
        values = values.unionByName(docs.sparkSession.createDataFrame(given, "kind string, value string"))
    return Scanner([p for p in pairs if p[0] not in KINDS[:3]], background.reshape(SIDE, SIDE), cut, grammars(values))


def _mapped(df: DataFrame, added: str, make, scanner: Scanner) -> DataFrame:
    """The last column is the text; make(text, spans) gives the columns that take its place."""
    schema = extended(df, df.columns[:-1], added)
    kinds = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() for f in schema.fields[len(df.columns) - 1 :]]
    names = [f.name for f in schema]
    shared = df.sparkSession.sparkContext.broadcast(scanner)

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            rows = [make(t, s) for t, s in zip(texts, own.spans(texts), strict=True)]
            columns = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    return df.mapInArrow(run, schema)


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_auto, base (spans of the base kinds) and spans (all), as kind:start:end."""

    def make(text: str, spans: list):
        n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
        return (*n, joined(x for x in spans if x[1] < 3), joined(spans))

    own = docs.select("doc_id", "text")
    ship(docs.sparkSession)
    return _mapped(own, "n_assign long, n_access long, n_hex long, n_auto long, base string, spans string", make, scanner or fit(own))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every run of spans that touch or overlap replaced by the mark."""
    out, at = [], 0
    end = -1
    for a, _, b in spans:
        if a > end:
            out += [text[at:a], mark]
        end = at = max(b, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """docs, all columns, with the secrets in text replaced; n_chars, where there is one, counts anew. A null text stays."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    names = {c: f"_{i}" for i, c in enumerate(rest)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(names[c]) for c in rest), F.col("text").isNull().alias("_null"), "text")
    done = _mapped(renamed, "_text string", lambda text, spans: (redacted(text, spans),), scanner or fit(docs.select("text")))
    text = F.when(~F.col("_null"), F.col("_text"))
    kinds = dict(docs.dtypes)
    value = {c: F.col(names[c]) for c in rest} | {"text": text}
    if "n_chars" in value:
        value["n_chars"] = F.coalesce(F.length(text).cast(kinds["n_chars"]), value["n_chars"])
    return done.select(*(value[c].alias(c) for c in docs.columns))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_auto")
