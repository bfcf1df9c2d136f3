"""Kinds, formulas, dates, specs and sources on tiny frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from tabscout.errors import TabularError
from tabscout.functions.formula import add_calculated_column
from tabscout.functions.scalars import coerce_numeric, parse_dates, sanitize_numeric
from tabscout.operators import features as FS
from tabscout.operators.associate import association_matrix, correlation_ratio, cramers_v, pearson
from tabscout.operators.explore import explore, highlights
from tabscout.operators.profile import column_facts, column_profiles, profile, profile_warnings
from tabscout.sources import tables as IO


def kinds(df):
    return {p.name: p.kind for p in column_facts(df)}


def test_kinds(spark):
    n = 60
    rows = [
        (i, 1_000_003 * i, i * 0.37, i % 4, i % 2 == 0, f"name {i}", ["a", "b"][i % 2], f"2024-01-{i % 28 + 1:02d}",
         str(20240000 + i % 5), None, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i))
        for i in range(n)
    ]
    df = spark.createDataFrame(
        rows, "dense bigint, sparse bigint, real double, few int, flag boolean, name string, label string, day string, "
              "digits string, nothing string, at timestamp")
    assert kinds(df) == {
        "dense": "id_like", "sparse": "numeric", "real": "numeric", "few": "categorical", "flag": "categorical", "name": "id_like",
        "label": "categorical", "day": "datetime", "digits": "categorical", "nothing": "unsupported", "at": "datetime",
    }
    codes = {r["column"]: r["code"] for r in profile_warnings(profile(df)).collect()}
    assert codes["nothing"] == "ALL_NULL_COLUMN" and codes["day"] == "DATETIME_COLUMN" and codes["dense"] == "ID_LIKE_COLUMN"


def test_nan_and_infinity_are_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (2.0,), (None,)], "x double")
    p = column_profiles(df)[0]
    assert (p.missing, p.unique) == (3, 2)
    clean = sanitize_numeric(df)
    assert sanitize_numeric(clean) is clean


def test_empty_table(spark):
    assert column_profiles(spark.createDataFrame([], "x double, s string"))[0].kind == "unsupported"


def test_dates_in_many_layouts(spark):
    texts = ["2024-03-05", "2024-03-05 10:11:12", "03/05/2024", "31/12/2024", "Mar 5, 2024", "5 March 2024", "2024/03/05", "soon", "12:30", "2024", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_dates("t").cast("date")).collect()]
    day = datetime.date(2024, 3, 5)
    assert got == [day, day, day, datetime.date(2024, 12, 31), day, day, day, None, None, None, None]


def test_coerce_numeric(spark):
    got = [r[0] for r in spark.createDataFrame([("1",), ("2.5",), ("x",), ("inf",), (None,)], "t string").select(coerce_numeric("t")).collect()]
    assert got == [1.0, 2.5, None, None, None]


@pytest.fixture(scope="module")
def fares(spark):
    return spark.createDataFrame([(10.0, 1, 0, "m"), (20.0, 0, 2, "f"), (None, 3, 1, "m"), (8.0, 0, 0, None)],
                                 "fare double, sibsp int, parch int, sex string")


def values(df, formula):
    return [r["new"] for r in add_calculated_column(df, "new", formula).collect()]


def test_formulas(fares):
    assert values(fares, "fare / (sibsp + parch)") == [10.0, 10.0, None, None]
    assert values(fares, "fare > 9") == [True, True, False, False]
    assert values(fares, "sex == 'm'") == [True, False, True, False]
    assert values(fares, "sex != 'm'") == [False, True, False, True]
    assert values(fares, "-7 % (sibsp + 2)") == [2.0, 1.0, 3.0, 1.0]
    assert values(fares, "not (fare > 9) or parch == 2") == [False, True, True, True]
    assert values(fares, "2 ** sibsp") == [2.0, 1.0, 8.0, 1.0]


@pytest.mark.parametrize("formula", ["", "1 + 2", "fare.mean()", "sqrt(fare)", "__import__('os')", "x = fare", "fare; fare", "fare[0]", "nope + 1",
                                     "sex + 1", "sex > 3", "fare +", "@fare", "lambda: fare", "a" * 501, "fare if fare else 1"])
def test_bad_formulas(fares, formula):
    with pytest.raises(TabularError):
        add_calculated_column(fares, "new", formula)


@pytest.mark.parametrize("name", ["1st", "a b", "", "a" * 65, "fare"])
def test_bad_names(fares, name):
    with pytest.raises(TabularError):
        add_calculated_column(fares, name, "fare + 1")


def test_associations(spark):
    rows = [(float(i), 2.0 * i, "a" if i < 10 else "b", "x" if i < 10 else "y", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "u double, v double, c string, d string, k double")
    assert pearson(df, "u", "v").first()["value"] == pytest.approx(1.0)
    assert pearson(df, "u", "k").first()["value"] is None
    assert pearson(df.limit(2), "u", "v").first()["value"] is None
    assert cramers_v(df, "c", "d").first()["value"] == pytest.approx(1.0)
    assert cramers_v(df.filter("c = 'a'"), "c", "d").first()["value"] is None
    assert 0.8 < correlation_ratio(df, "c", "u").first()["value"] < 0.9
    assert correlation_ratio(df, "c", "k").first()["value"] is None
    cells = {(r["a"], r["b"]): r["value"] for r in association_matrix(df, ["u", "v", "c", "d", "k"]).collect()}
    assert len(cells) == 25 and cells["u", "c"] == cells["c", "u"] and cells["u", "k"] is None and cells["c", "d"] == 1.0


def test_explore_counts_add_up(spark):
    df = spark.range(500).select(
        F.when(F.col("id") % 10 != 0, F.exp(F.col("id") / 60.0)).alias("amount"), (F.col("id") % 3).cast("string").alias("city"),
        F.date_format(F.date_add(F.lit("2024-01-01"), (F.col("id") % 40).cast("int")), "MM/dd/yyyy").alias("day"))
    found = explore(df)
    sums = {r["column"]: r["n"] for r in found.bins.groupBy("column").agg(F.sum("count").alias("n")).collect()}
    assert sums == {"amount": 450, "city": 500, "day": 500}
    assert "SKEWED" in [r["code"] for r in found.highlights.collect()]


def test_quiet_data_has_no_highlights(spark):
    df = spark.range(300).select((F.col("id") * 7919 % 1000 / 10.0).alias("a"), (F.col("id") * 104729 % 997 / 7.0).alias("b"))
    assert highlights(df).count() == 0


def test_spec_rules(spark):
    rows = [(i * 0.5, ["m", "f"][i % 2], i, 1.0 if i % 5 == 0 else None, f"c{i % 60}", f"2024-{i % 12 + 1:02d}-15", i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "age double, sex string, record bigint, sparse double, city string, joined string, outcome int")
    spec = FS.build_feature_spec(df, "outcome", user_excluded=("sex",))
    assert spec.task == "classification" and spec.classes == ("0", "1")
    assert dict(spec.excluded) == {"sex": "user_excluded", "record": "id_like", "sparse": "high_missing"}
    city = spec.feature("city")
    assert len(city.categories) == 51 and city.categories[-1] == "Other"
    assert "joined_year" not in spec.names and "joined_month" in spec.names
    assert FS.FeatureSpec.from_json(spec.to_json()) == spec
    applied = FS.apply_feature_spec(spark.createDataFrame([("c999", 3.0)], "city string, joined_month double"), spec)
    row = applied.first()
    assert applied.columns == spec.names and row["city"] == "Other" and row["joined_month"] == 3.0 and row["age"] is None


def test_spec_and_target_errors(spark):
    df = spark.createDataFrame([(1.5, "a", None)] * 5, "x double, c string, e string")
    for target, code in (("zz", "UNKNOWN_COLUMN"), ("e", "EMPTY_TARGET"), ("c", "SINGLE_CLASS_TARGET")):
        with pytest.raises(TabularError) as err:
            FS.build_feature_spec(df, target)
        assert err.value.code == code
    with pytest.raises(TabularError):
        FS.exclude_columns(df, ["x"], "x")
    sparse = spark.createDataFrame([(1.0,)] * 6 + [(None,)] * 4, "x double")
    with pytest.raises(TabularError):
        FS.drop_missing_target(sparse, "x")


def test_scenarios(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2], i % 2) for i in range(100)], "x double, c string, y int").withColumn("x", F.col("x") * 1.5)
    spec = FS.build_feature_spec(df, "y")
    filled = FS.fill_defaults(spark.createDataFrame([("7",), (None,)], "x string"), spec).collect()
    assert [r["x"] for r in filled] == [7.0, 74.25] and filled[0]["c"] == "a"
    for bad in (spark.createDataFrame([("abc",)], "x string"), spark.createDataFrame([(1,)], "nope int")):
        with pytest.raises(TabularError):
            FS.fill_defaults(bad, spec)
    flags = FS.flag_out_of_range(spark.createDataFrame([(0.0,), (148.5,), (149.0,), (None,)], "x double"), spec).collect()
    assert [r["out_of_range"] for r in flags] == [[], [], ["x"], []]


def test_csv_encodings_and_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name;size\ncafé;1\nthé;2\n".encode("latin-1"))
    df = IO.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(r["name"] for r in df.collect()) == ["café", "thé"] and df.schema["size"].dataType.typeName() == "integer"
    (tmp_path / "b.csv").write_text('a\tb\n"x, y"\t2\n"p, q, r"\t3\n')
    assert IO.sniff_delimiter(spark, str(tmp_path / "b.csv")) == "\t"
    (tmp_path / "c.csv").write_text("only\n1\n2\n")
    assert IO.sniff_delimiter(spark, str(tmp_path / "c.csv")) == ","
    (tmp_path / "d.csv").write_text("a,b\n")
    with pytest.raises(TabularError):
        IO.read_csv(spark, str(tmp_path / "d.csv"))


def test_preview_limit(spark):
    with pytest.raises(TabularError):
        IO.preview(spark.range(5), ["id"], 201)
