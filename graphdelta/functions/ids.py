"""Column functions over path ids such as ``crate::a::B``. They differ only in what an id without ``::`` gives."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "::"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_name(c: Column | str) -> Column:
    """Last segment; the whole id without a separator."""
    return F.substring_index(col(c), SEP, -1)


def _head(c: Column) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - F.length(short_name(c)) - 2)


def has_parent(c: Column | str) -> Column:
    return F.contains(col(c), F.lit(SEP))


def parent(c: Column | str) -> Column:
    """All but the last segment; empty without a separator."""
    return F.when(has_parent(c), _head(col(c))).otherwise("")


def owner(c: Column | str) -> Column:
    """All but the last segment; the whole id without a separator (call owner, enum of a variant)."""
    return F.when(has_parent(c), _head(col(c))).otherwise(col(c))


def owning_module(c: Column | str) -> Column:
    """All but the last segment; null without a separator (lints)."""
    return F.when(has_parent(c), _head(col(c)))


def report_module(c: Column | str) -> Column:
    """All but the last segment; ``(crate root)`` without a separator (changelog)."""
    return F.when(has_parent(c), _head(col(c))).otherwise("(crate root)")


def crate_of(c: Column | str) -> Column:
    return F.substring_index(col(c), SEP, 1)


def is_containment(a: Column | str, b: Column | str) -> Column:
    """One id is nested in the other; equal ids are not."""
    a, b = col(a), col(b)
    return F.startswith(a, F.concat(b, F.lit(SEP))) | F.startswith(b, F.concat(a, F.lit(SEP)))


def normalize_path(path: Column | str, module: Column | str) -> Column:
    """``crate::``, ``self::`` and any number of ``super::`` made absolute against a module; null for other paths and for
    ``super`` above the root."""
    path, module = col(path), col(module)
    segments, base = F.split(path, SEP), F.split(module, SEP)
    ups = F.when(segments[0] == "super", F.size(segments) - F.size(F.filter(segments, lambda s, i: F.exists(F.slice(segments, 1, i + 1), lambda x: x != "super")))).otherwise(0)
    rest = F.slice(segments, F.greatest(ups, F.lit(1)) + 1, F.size(segments))
    up = F.when(segments[0] == "self", base).when((segments[0] == "super") & (ups < F.size(base)), F.slice(base, 1, F.greatest(F.size(base) - ups, F.lit(0)))).when(segments[0] == "crate", F.slice(base, 1, 1))
    return F.when(up.isNotNull(), F.array_join(F.concat(up, rest), SEP))


# ---- globs ---------------------------------------------------------------------------------------------------------------


class GlobError(ValueError):
    """A glob that the dialect does not have."""


def glob_to_regex(glob: str) -> str:
    """``*`` and ``?`` cross slashes, ``**`` stands as a whole path component, ``[a-z]`` and ``[!a]`` are classes. The
    result is anchored and reads the same in Java and Python."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            j = i
            while j < len(glob) and glob[j] == "*":
                j += 1
            if j - i > 2:
                raise GlobError(f"{glob}: more than two stars")
            if j - i == 2:
                if (i and glob[i - 1] != "/") or (j < len(glob) and glob[j] != "/"):
                    raise GlobError(f"{glob}: ** is not a whole component")
                if j < len(glob):
                    out.append("(?:.*/)?")
                    j += 1
                else:
                    out.append(".*")
            else:
                out.append(".*")
            i = j
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 3 if glob[i + 1 : i + 2] == "!" else i + 2)
            if end < 0:
                raise GlobError(f"{glob}: open class")
            body = glob[i + 1 : end]
            negated = body.startswith("!")
            body = body[1:] if negated else body
            out.append("[" + ("^" if negated else "") + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.escape(c) if c in r"\.^$+{}()|#&~" else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_any(c: Column | str, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | F.rlike(col(c), F.lit(glob_to_regex(g)))
    return out


def layer_of(path: Column | str, layers: list[tuple[str, str]]) -> Column:
    """Name of the first layer, in the given order of (glob, layer), whose glob fits; else null."""
    out = None
    for glob, layer in layers:
        fits = F.rlike(col(path), F.lit(glob_to_regex(glob)))
        out = F.when(fits, layer) if out is None else out.when(fits, layer)
    return F.lit(None).cast("string") if out is None else out
