import math

import pytest

from cloudfork.operators import information as info
from cloudfork.operators import selection
from cloudfork.operators.contingency import f_upper_tail


def value(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def xy(spark):
    return spark.createDataFrame(list(zip([1, 0, 1, 1, 0], [1, 1, 1, 0, 0], [2.0, 1.0, 1.0, 3.0, 1.0])), "x int, y int, w double")


def test_worked_example(xy):
    assert round(value(info.mutual_information(xy, "x", "y")), 4) == 0.0200
    assert round(value(info.entropy(xy, "x")), 4) == 0.9710
    assert round(value(info.conditional_entropy(xy, "x", "y")), 4) == 0.9510
    assert round(value(info.entropy(xy, "x", "y")), 4) == 1.9219


def test_four_vectors(spark):
    df = spark.createDataFrame(list(zip("0011", "0101", "0111", "0110")), "a string, b string, c string, t string")
    assert [round(value(info.entropy(df, c)), 6) for c in "abct"] == [1, 1, 0.811278, 1]
    assert [round(value(info.mutual_information(df, c, "t")), 6) for c in "abc"] == [0, 0, 0.311278]


def test_identities(spark):
    df = spark.range(10_000).selectExpr("id % 2 as a", "id % 4 as b", "id % 3 as c", "id % 10 as d", "1.0D as one")
    assert value(info.mutual_information(df, "a", "b")) == pytest.approx(1)
    assert value(info.mutual_information(df, "d", "d")) == pytest.approx(math.log2(10))
    assert value(info.conditional_mutual_information(df, "a", "b", "c")) == pytest.approx(1, abs=1e-3)
    for f in (info.entropy, info.conditional_entropy, info.mutual_information):
        assert value(f(df, "b", "d", weight="one")) == pytest.approx(value(f(df, "b", "d")))
    assert value(info.entropy(df, "b", "d")) == pytest.approx(value(info.entropy(df, "d")) + value(info.conditional_entropy(df, "b", "d")))
    assert value(info.renyi_entropy(df, 1.0001, "d")) == pytest.approx(math.log2(10), abs=1e-3)
    assert 0 <= value(info.normalised_information(df, "b", "d")) <= 1


def test_degenerate_inputs(spark, xy):
    empty = xy.limit(0)
    for df in (info.entropy(empty, "x"), info.mutual_information(empty, "x", "y"), info.normalised_information(empty, "x", "y"), info.renyi_entropy(empty, 2, "x")):
        assert value(df) == 0
    assert value(info.conditional_entropy(xy, "x")) == pytest.approx(value(info.entropy(xy, "x")))
    assert value(info.conditional_mutual_information(xy, "x", "y")) == pytest.approx(value(info.mutual_information(xy, "x", "y")))
    nulls = spark.createDataFrame([(None, 1), (None, 2), (3, 1), (3, 2)], "x int, y int")
    assert value(info.entropy(nulls, "x")) == pytest.approx(1)
    with pytest.raises(ValueError):
        info.entropy(xy, "nothing")
    with pytest.raises(ValueError):
        info.renyi_entropy(xy, 1, "x")


def test_selectors_find_the_informative_features(spark):
    df = spark.range(4000).selectExpr("id % 2 as a", "(id div 2) % 2 as b", "(id div 7) % 3 as noise", "id % 2 as copy", "(id % 2) * 2 + (id div 2) % 2 as cls")
    features = ["noise", "a", "b", "copy"]
    assert selection.select_mrmr(df, 2, features, "cls") == ["a", "b"]
    assert selection.select_cmim(df, 2, features, "cls") == ["a", "b"]
    assert selection.select_disr(df, 2, features, "cls") == ["a", "b"]
    assert set(selection.select_iamb(df, features, "cls")) == {"a", "b"}


def test_f_tail():
    assert f_upper_tail(4.0, 2, 12) == pytest.approx(0.046656, abs=1e-5)
    assert f_upper_tail(1.0, 5, 5) == pytest.approx(0.5, abs=1e-9)
    assert f_upper_tail(None, 2, 2) is None
