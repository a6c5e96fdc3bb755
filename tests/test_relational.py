import pytest
from pyspark.sql import functions as F

from quarry.operators import conditions as C
from quarry.operators import relational as R
from tests.conftest import rows


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "Alice", 25), (2, "Bob", None), (3, "Carol", 28), (4, None, 25)], "id long, name string, age long")


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([(10, 1, 5.0), (11, 1, 7.0), (12, 9, 1.0), (13, None, 2.0)], "order_id long, user_id long, amount double")


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_engine_conditions_treat_null_as_a_value(users):
    assert ids(R.select(users, C.eq("age", None))) == [2]
    assert ids(R.select(users, C.ne("age", 25))) == [2, 3]
    assert ids(R.select(users, C.lt("age", 26))) == [1, 4]
    assert ids(R.select(users, ~C.lt("age", 26))) == [2, 3]
    assert ids(R.select(users, C.ne("age", 25), mode="sql")) == [3]


def test_missing_fields_fail_meta_filters_and_pass_graph_inequality(users):
    assert ids(users.where(C.compile_condition(C.ne("age", 25), "meta"))) == [3]
    assert ids(users.where(C.compile_condition(C.ne("age", 25), "graph"))) == [2, 3]
    assert ids(users.where(C.compile_condition(C.exists("age") & C.starts_with("name", "A"), "meta"))) == [1]
    assert ids(users.where(C.compile_condition(C.contains("name", "o") | C.is_in("age", [25]), "meta"))) == [1, 2, 3, 4]


def test_depth_is_limited():
    c = C.TRUE
    for _ in range(70):
        c = ~c
    with pytest.raises(C.ConditionTooDeepError):
        C.compile_condition(c)


def test_unknown_columns_are_left_out(users):
    assert R.select(users, columns=["id", "nope"]).columns == ["id"]


def test_row_cap(users):
    with pytest.raises(R.ResultTooLargeError):
        R.select(users, limit=3)
    assert R.select(users, limit=4).count() == 4


@pytest.mark.parametrize(("how", "n"), [("inner", 2), ("left", 5), ("right", 4), ("full", 7)])
def test_join_kinds(users, orders, how, n):
    assert R.join(users, orders, [("id", "user_id")], how).count() == n


def test_null_keys_join(spark, orders):
    a = spark.createDataFrame([(None,)], "k long")
    assert R.join(a, orders, [("k", "user_id")]).count() == 1


def test_cross_is_refused_when_too_large(users, orders):
    assert R.join(users, orders, how="cross").count() == 16
    with pytest.raises(R.ResultTooLargeError):
        R.join(users, orders, how="cross", most_cross_rows=15)


def test_natural_join_and_its_fallback(spark, users):
    other = spark.createDataFrame([(1, "x"), (3, "y")], "id long, tag string")
    assert rows(R.join(users, other, how="natural").select("id", "tag")) == [(1, "x"), (3, "y")]
    assert R.join(users, other.select("tag"), how="natural").count() == 8


def test_group_by_having_and_empty_groups(users):
    out = R.group_by(users, ["age"], [("count_all", None), ("sum", "id")], having=C.ge("count_all", 2))
    assert rows(out) == [(25, 2, 5.0)]
    assert R.group_by(users, [], [("count_all", None)], C.eq("id", 99)).count() == 0
    assert rows(R.aggregate(users, [("sum", "age"), ("avg", "age")], C.eq("id", 2))) == [(0.0, None)]


def test_distinct_keeps_the_first_whole_row(users):
    assert ids(R.distinct_first(users, ["age"], ["id"])) == [1, 2, 3]


def test_pages(users):
    page, more = R.page(users, ["id"], 1, 2)
    assert [r["id"] for r in page.collect()] == [2, 3] and more
    assert R.page(users, ["id"], 3, 2)[1] is False
    assert [r["id"] for r in R.after_key(users, "id", 2, 5).collect()] == [3, 4]
    assert [r["id"] for r in R.cursor(users, ["id"], 1, 2)] == [2, 3]


def test_changes_are_copies(users):
    changed = R.update(users, C.eq("age", None), {"age": F.lit(1)})
    assert rows(changed.select("id", "age"))[1] == (2, 1)
    assert ids(R.delete(users, C.gt("age", 26))) == [1, 2, 4]


def test_constraints(users, orders):
    assert rows(R.violates_unique(users, ["age"])) == [(25, 2)]
    assert ids(R.violates_not_null(users, ["name", "age"])) == [2, 4]
    assert [r["order_id"] for r in R.violates_foreign_key(orders, users, [("user_id", "id")]).collect()] == [12]


@pytest.mark.parametrize(("action", "left"), [("cascade", [12, 13]), ("set_null", [10, 11, 12, 13])])
def test_referential_actions(users, orders, action, left):
    parent, child = R.delete_referenced(users, orders, [("user_id", "id")], C.eq("id", 1), action)
    assert ids(parent) == [2, 3, 4]
    assert sorted(r[0] for r in child.select("order_id").collect()) == left
    with pytest.raises(ValueError, match="referenced"):
        R.delete_referenced(users, orders, [("user_id", "id")], C.eq("id", 1))
