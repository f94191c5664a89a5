import pytest
from pyspark.sql import functions as F

from headcount.operators.derive import add_codebook_levels, recode_from_codebook
from headcount.plans.clean import clean
from headcount.sources import (
    CODEBOOK_SCHEMA,
    LOOKUP_SCHEMA,
    SURVEY_SCHEMA,
    TooManyRejects,
    codebook_levels,
    read_codebook,
    read_lookup,
    read_survey,
    read_with_rejects,
    reject_counts,
    survey,
    write_result,
)
from headcount.sources.files import WHOLE_RECORD


def test_survey_from_parquet_and_csv(spark, sf_dir, tmp_path):
    raw = survey(spark, sf_dir).filter("respondent_id < 50")
    typed = raw.select(
        *[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SURVEY_SCHEMA]
    )
    typed.write.parquet(str(tmp_path / "survey"))
    typed.coalesce(1).write.option("header", True).csv(str(tmp_path / "survey.csv"))
    a = read_survey(spark, str(tmp_path / "survey")).collect()
    b = read_survey(spark, str(tmp_path / "survey.csv")).collect()
    assert sorted(a) == sorted(b) and len(a) == 50
    some = read_survey(spark, str(tmp_path / "survey"), columns=["respondent_id", "sex"])
    assert some.columns == ["respondent_id", "sex"]


def test_stand_in_has_the_survey_types(spark, sf_dir, tmp_path):
    raw = survey(spark, sf_dir)
    assert all(raw.schema[c].dataType == SURVEY_SCHEMA[c].dataType for c in raw.columns)
    raw.write.parquet(str(tmp_path / "plain"))
    back = read_survey(spark, str(tmp_path / "plain"), columns=raw.columns)
    assert clean(back).agg(F.sum("total_contacts")).first() == clean(raw).agg(F.sum("total_contacts")).first()


def test_a_missing_column_stops_the_read(spark, sf_dir, tmp_path):
    survey(spark, sf_dir).limit(5).withColumnRenamed("f2f_18_69", "renamed").write.parquet(str(tmp_path / "renamed"))
    with pytest.raises(ValueError, match="f2f_18_69"):
        read_survey(spark, str(tmp_path / "renamed"), columns=["respondent_id", "f2f_18_69"])


def test_each_column_has_its_own_missing_codes(spark, tmp_path):
    spark.createDataFrame([(1, 2, -9999), (2, -9, -9), (3, -9999, 1)], "respondent_id bigint, sex int, isolation int").write.parquet(
        str(tmp_path / "s")
    )
    codebook = spark.createDataFrame(
        [("sex", -9, None, True, 1), ("isolation", -9999, "UNK", True, 1), ("isolation", 1, "No", False, 2), ("sex", None, None, True, 3)],
        CODEBOOK_SCHEMA,
    )
    got = read_survey(spark, str(tmp_path / "s"), columns=["respondent_id", "sex", "isolation"], codebook=codebook)
    assert sorted(map(tuple, got.collect())) == [(1, 2, None), (2, None, -9), (3, -9999, 1)]


def test_malformed_csv_stops_the_read(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("column,code,label,is_missing,ord\nsex,one,Male,false,1\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_codebook(spark, str(path)).collect()


def test_lookup_codes_stay_text(spark, tmp_path):
    path = tmp_path / "soc.csv"
    path.write_text("SOC2010Major,SOC2010SubMajor,SOC2010Minor,soc_code,soc_title\n0,01,012,0123,Clerk\n")
    assert read_lookup(spark, str(path)).first().soc_code == "0123"


def test_codebook_labels(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("column,code,label,is_missing,ord\nsex,1,Male,false,1\nsex,2,Female,false,2\nhcw,1,No,false,1\n")
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "sex int")
    got = recode_from_codebook(df, "sex", read_codebook(spark, str(path)), "label").collect()
    assert sorted((r.sex or 0, r.label) for r in got) == [(0, None), (1, "Male"), (2, "Female"), (3, None)]


def test_results_are_stored_as_parquet(spark, tmp_path):
    write_result(spark.range(3), str(tmp_path / "r"))
    write_result(spark.range(2), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_rows_that_do_not_parse_are_set_aside(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text(
        "column,code,label,is_missing,ord\nsex,1,Male,false,1\nsex,one,Female,maybe,2\nsex,2,Female\nhcw,,No,true,\nhcw,3,a,true,4,5\nhcw,4,\"x,y\",true,5\n"
    )
    with pytest.raises(TooManyRejects, match="3 of 6 rows") as caught:
        read_with_rejects(spark, str(path), CODEBOOK_SCHEMA)
    assert caught.value.counts == {"code": 1, "is_missing": 1, WHOLE_RECORD: 2}
    good, rejects = read_with_rejects(spark, str(path), CODEBOOK_SCHEMA, limit=0.5)
    assert good.schema == CODEBOOK_SCHEMA and rejects.columns == ["record", "reasons"]
    assert {(r["column"], r["code"], r["label"]) for r in good.collect()} == {("hcw", 4, "x,y"), ("hcw", None, "No"), ("sex", 1, "Male")}
    found = {r["record"]: r["reasons"] for r in rejects.collect()}
    assert found["sex,2,Female"] == [WHOLE_RECORD] == found["hcw,3,a,true,4,5"] and ["code", "is_missing"] in found.values()
    assert {r["column"]: r["n"] for r in reject_counts(rejects).collect()} == {"code": 1, "is_missing": 1, WHOLE_RECORD: 2}
    some, _ = read_with_rejects(spark, str(path), CODEBOOK_SCHEMA, limit=0.5, columns=["label"])
    assert some.columns == ["label"] and some.count() == 3


def test_cells_of_parquet_files_are_converted_one_by_one(spark, tmp_path):
    rows = [(str(i), "7" if i % 4 else "seven") for i in range(12)]
    spark.createDataFrame(rows, "column string, code string").selectExpr(
        "column", "code", "column AS label", "true AS is_missing", "1 AS ord"
    ).write.parquet(str(tmp_path / "p"))
    good, rejects = read_with_rejects(spark, str(tmp_path / "p"), CODEBOOK_SCHEMA, limit=0.3)
    assert (good.count(), rejects.count(), good.agg(F.sum("code")).first()[0]) == (9, 3, 63)
    with pytest.raises(ValueError, match="no column"):
        read_with_rejects(spark, str(tmp_path / "p"), LOOKUP_SCHEMA)


def test_a_failing_write_leaves_the_old_result(spark, tmp_path):
    path = str(tmp_path / "r")
    write_result(spark.range(3), path)
    with pytest.raises(Exception, match="stop here"):
        write_result(spark.range(5).selectExpr("CASE WHEN id = 4 THEN raise_error('stop here') ELSE id END AS id"), path)
    assert spark.read.parquet(path).count() == 3
    # Reading and writing one path.
    write_result(spark.read.parquet(path).selectExpr("id + 10 AS id"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    assert [f.name for f in tmp_path.iterdir()] == ["r"]
    write_result(spark.range(1), path, "append")
    assert spark.read.parquet(path).count() == 4


def test_levels_in_the_codebook_order(spark):
    codebook = spark.createDataFrame(
        [("q", 1, "No", False, 2), ("q", 2, "Yes", False, 1), ("q", 3, "Yes", False, 3), ("q", -9, "Gone", True, 0), ("q", 4, None, False, 4), ("q", 5, "Late", False, None)],
        CODEBOOK_SCHEMA,
    )
    assert codebook_levels(codebook, ["q", "other"]) == {"q": ["Yes", "No", "Late"], "other": []}
    df = spark.createDataFrame([("No",), ("Yes",), ("Gone",), ("Late",), (None,)], "q string")
    got = {(r["q"], r["q_ord"]) for r in add_codebook_levels(df, "q", codebook).collect()}
    assert got == {("Yes", 1), ("No", 2), ("Late", 3), (None, None)}
