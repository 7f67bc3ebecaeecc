import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphdelta.functions import ids
from graphdelta.plans.config import DEFAULT, ConfigError, parse


def test_no_separator_cases_differ(spark):
    row = spark.createDataFrame([("crate",), ("crate::a::B",)], "id string").select(ids.parent("id"), ids.owner("id"), ids.owning_module("id"), ids.report_module("id"), ids.short_name("id"), ids.crate_of("id")).collect()
    assert list(row[0]) == ["", "crate", None, "(crate root)", "crate", "crate"]
    assert list(row[1]) == ["crate::a", "crate::a", "crate::a", "crate::a", "B", "crate"]


def test_containment(spark):
    rows = [("crate", "crate::a"), ("crate::a", "crate::ab"), ("crate::a", "crate::a"), ("crate::a::b", "crate::a")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(ids.is_containment("a", "b")).collect()]
    assert got == [True, False, False, True]


GLOBS = [
    ("src/*", "src/a/b.rs", True), ("src/**/x.rs", "src/x.rs", True), ("src/**/x.rs", "src/a/b/x.rs", True), ("src/**", "src/a/b", True), ("**/x", "x", True), ("a?c", "abc", True),
    ("a?c", "a/c", True), ("a[bc]d", "acd", True), ("a[!bc]d", "acd", False), ("a[!bc]d", "aed", True), ("A*", "abc", False), ("a.b", "axb", False), ("*.rs", "src/a.rs", True), ("src/*", "lib/src/a", False),
]


@pytest.mark.parametrize(("glob", "path", "fits"), GLOBS)
def test_globs(glob, path, fits):
    assert bool(re.match(ids.glob_to_regex(glob), path)) is fits


@pytest.mark.parametrize("bad", ["a/***/b", "a**", "**b/c", "a[b"])
def test_bad_globs(bad):
    with pytest.raises(ids.GlobError):
        ids.glob_to_regex(bad)


@settings(max_examples=100, deadline=None)
@given(st.text("ab/.", max_size=8))
def test_a_literal_glob_fits_itself_alone(path):
    regex = ids.glob_to_regex(path)
    assert re.match(regex, path)
    assert not re.match(regex, path + "x")


def test_first_layer_wins(spark):
    layers = [("src/api/*", "api"), ("src/**", "infra")]
    got = [r[0] for r in spark.createDataFrame([("src/api/a.rs",), ("src/x.rs",), ("lib/x.rs",)], "f string").select(ids.layer_of("f", layers)).collect()]
    assert got == ["api", "infra", None]


def test_config():
    c = parse('[layers]\norder = ["app", "infra"]\n[[layers.map]]\nglob = "src/app/*"\nlayer = "app"\n[[layers.forbid]]\nfrom = "app"\nto = "infra"\n[lint]\ndeny = ["layering"]\n[ratchet]\nmode = "all"\n')
    assert c.layers == [("src/app/*", "app")]
    assert c.forbid == [("app", "infra")]
    assert not c.new_only
    assert c.severity("layering") == "deny"
    assert c.severity("cycles") is None
    assert DEFAULT.severity("cycles") == "warn"


@pytest.mark.parametrize("bad", ['x = 1', '[lint]\nx = []', '[layers]\norder = ["a"]\n[[layers.map]]\nglob = "*"\nlayer = "b"', '[calls]\nhot = ["a/***/b"]', '[ratchet]\nmode = "some"', "[", '[lint]\ndeny = "x"', '[[layers.map]]\nglob = "*"'])
def test_config_errors(bad):
    with pytest.raises(ConfigError):
        parse(bad)
