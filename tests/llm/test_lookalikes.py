import pytest

from quernel.llm import lookalikes as lk


@pytest.mark.parametrize("a, b", [
    ("Ｖａｎｔｉｑ　ＶＭ－６００", "Vantiq VM-600"), ("su​pply", "supply"), ("é", "é"), ("ﬁrst", "first"), ("Τһе ѕсоре", "The scope"), ("a b c", "a b c"),
    ("co­op", "coop"), ("non‑stop", "non-stop"), ("⼈⽤", "人用"), ("⻛", "风"), ("K", "K"), ("x︎", "x"), ("a\r\nb ", "a\nb"), ("ё", "ë"),
])
def test_same_look(a, b):
    assert lk.skeleton(a) == lk.skeleton(b)


@pytest.mark.parametrize("a, b", [("a", "A"), ("e", "é"), ("m²", "m2"), ("①", "1"), ("0", "O"), ("l", "1"), ("a b", "ab"), ("–", "-"), ("𝔫", "n"), ("٤", "4"), ("👩‍🔧", "👩🔧")])
def test_other_look(a, b):
    assert lk.skeleton(a) != lk.skeleton(b)


def test_skeleton_is_stable():
    for t in ("Ｖé́ ｋ ﬁ", "Τһе‍ x", "", " \n "):
        assert lk.skeleton(lk.skeleton(t)) == lk.skeleton(t)


def pairs(df):
    return {(r.id_a, r.id_b) for r in lk.alike(lk.looks(df, "k", "t").selectExpr("'x' AS tbl", "id", "look", "stored")).collect()}


def test_pairs_and_edges(spark):
    rows = [(1, "first"), (2, "ﬁrst"), (3, "first"), (4, "First"), (5, ""), (6, None), (None, "ﬁrst"), (7, "​"), (8, " "), (9, "fi​rst"), (1, "first")]
    df = spark.createDataFrame(rows, "k bigint, t string").selectExpr("*", "'a' AS id", "'b' AS look", "'c' AS tbl")
    # strings: first (1, 3), ﬁrst (2), fi​rst (9)
    assert pairs(df) == {(1, 2), (2, 3), (1, 9), (3, 9), (2, 9)}
    assert pairs(df.limit(0)) == set()


def test_copies_are_not_multiplied(spark):
    df = spark.range(400).selectExpr("id AS k", "CASE WHEN id % 2 = 0 THEN 'first' ELSE 'ﬁrst' END AS t")
    assert len(pairs(df)) == 399  # each row with the representative of the other string
    forms = lk.one_form(df, "k", "t").select("form").distinct().collect()
    assert [r.form for r in forms] == ["first"]
