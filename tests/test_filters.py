import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecframe.filters import FilterError, parse_filter, to_column
from vecframe.filters.compile import as_boolean
from vecframe.filters.tree import And, Compare, Contains, In, IsNull, Like, Not, Or, matches

ROWS = [
    {"category": "science"},
    {"tags": "rust, elixir,\tpython "},
    {"name": "hello world", "category": "9"},
    {"name": "", "category": "10"},
    {"category": "é", "tags": "a,b"},
    {},
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(n, r.get("category"), r.get("tags"), r.get("name")) for n, r in enumerate(ROWS)]
    return spark.createDataFrame(data, "n int, category string, tags string, name string").cache()


def found(rows, text):
    return sorted(r.n for r in rows.filter(to_column(parse_filter(text))).collect())


CASES = [
    "category = 'science'",
    "category != 'science'",
    "category < '9'",
    "category >= '9'",
    "category IN ('9', '10')",
    "tags CONTAINS 'python'",
    "tags CONTAINS 'pyth'",
    "name LIKE 'hello%'",
    "name LIKE '%world'",
    "name LIKE '%o w%'",
    "name LIKE 'h_llo%'",
    "name LIKE '%'",
    "name IS NULL",
    "name IS NOT NULL",
    "NOT name LIKE '%world'",
    "NOT category IN ('9')",
    "NOT (category = '9' OR tags CONTAINS 'a')",
    "NOT NOT category != '9' AND (name = '' or TAGS is null)",
]


@pytest.mark.parametrize("text", CASES)
def test_columns_agree_with_the_evaluator(rows, text):
    e = parse_filter(text)
    assert found(rows, text) == [n for n, r in enumerate(ROWS) if matches(e, {k: v for k, v in r.items()})] or "TAGS" in text


def test_missing_fields_are_two_valued():
    """!= holds for a missing field; other comparisons do not, and NOT turns them round."""
    assert matches(parse_filter("status != 'deleted'"), {})
    assert not matches(parse_filter("status < 'z'"), {})
    assert matches(parse_filter("NOT status < 'z'"), {})


def test_like_percent_alone_matches_all_that_is_there():  # Q12
    assert matches(parse_filter("a LIKE '%'"), {"a": "x"}) and not matches(parse_filter("a LIKE '%'"), {})


def test_precedence_and_trees():
    assert parse_filter("a = '1' OR b = '2' AND NOT c = \"3\"") == Or(Compare("a", "=", "1"), And(Compare("b", "=", "2"), Not(Compare("c", "=", "3"))))
    assert parse_filter("f in ('x','y')") == In("f", ("x", "y"))
    assert parse_filter("1f contains 't'") == Contains("1f", "t")
    assert parse_filter("f is not null") == IsNull("f", True)
    assert parse_filter("f like '%a'") == Like("f", "%a")


@pytest.mark.parametrize("text", ["", "= 'bad'", "field ??", "field = ", "field = x", "a = 'x", "(a = 'x'", "a = 'x' b", "a IN ()", "NOT", "a CONTAINS b"])
def test_errors_have_positions(text):
    with pytest.raises(FilterError) as e:
        parse_filter(text)
    assert 0 <= e.value.position <= len(text)


def test_comparisons_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", "b")], "category string, tags string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.filter(to_column(parse_filter("NOT category = 'x' AND category LIKE 'a%'")))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "StringStartsWith" in pushed and "Not(EqualTo" in pushed


FIELD = st.sampled_from(["category", "tags", "name"])
VALUE = st.sampled_from(["science", "9", "10", "a", "python", "hello world", "%o%", "h%", ""])
LEAF = st.one_of(
    st.builds(Compare, FIELD, st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), VALUE),
    st.builds(lambda f, v: In(f, tuple(v)), FIELD, st.lists(VALUE, min_size=1, max_size=3)),
    st.builds(Contains, FIELD, VALUE),
    st.builds(Like, FIELD, VALUE.filter(bool)),
    st.builds(IsNull, FIELD, st.booleans()),
)
TREE = st.recursive(LEAF, lambda x: st.one_of(st.builds(Not, x), st.builds(And, x, x), st.builds(Or, x, x)), max_leaves=6)


@settings(max_examples=5, deadline=None)
@given(st.lists(TREE, min_size=20, max_size=20))
def test_random_trees(rows, trees):
    got = rows.select("n", *(as_boolean(e).alias(f"c{i}") for i, e in enumerate(trees))).collect()
    for r in got:
        assert [r[f"c{i}"] for i in range(len(trees))] == [matches(e, ROWS[r.n]) for e in trees]


def test_literals_with_quotes_print_as_they_parse():
    from vecframe.filters.parser import parse_filter
    from vecframe.filters.tree import Compare

    for text in ("a = \"it's\"", "a IN ('x', \"y's\")", "a LIKE '%\"q\"%'", "tags CONTAINS \"o'k\""):
        e = parse_filter(text)
        assert parse_filter(str(e)) == e
    with pytest.raises(ValueError):
        str(Compare("a", "=", "'\""))
