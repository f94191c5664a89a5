"""Queries against their SQL in DuckDB. ``python tests/crosscheck.py`` runs all of them at sf0.01."""

import crosscheck
import pytest

import __spark_entry__ as entry
from headcount.functions.codes import MODEL_FACTORS
from headcount.plans import registry

# The training-data queries have tests of their own.
ORACLE = {k: sql for k, sql in entry.oracle_sql().items() if k in registry.queries()}
LARGER = "/root/testdata/sf0.01"

# Fits on all factors need the larger table: at sf0.001 some levels hold no zeros at all.
ALL_FACTORS = ("mdl_nb_coef", "mdl_lrt", "mdl_zinb_coef", "mdl_zinb_limit", "mdl_lrt_allzero", "dist_nb_allzero", "dist_zero_allzero")
FITTED = {k for k in ORACLE if "multi" in k} | {
    "mdl_nb_coef", "mdl_nb_fit", "mdl_ols_coef", "mdl_lrt", "mdl_irr", "mdl_irr_zinb", "mdl_zinb_coef", "mdl_aic",
    "dist_nb", "dist_zinb", "dist_zero", "mdl_nb_uni", "mdl_lrt_pvalue", "mdl_lrt_allzero", "dist_nb_allzero",
    "dist_zero_allzero", "mdl_zinb_limit", "dist_zero_limit",
}
# The seven one-factor models share their code; two of them stand for the rest.
SAME_CODE = {f"mdl_{kind}_{f}" for kind in ("nb_uni", "irr", "lrt") for f in list(MODEL_FACTORS)[1:]} - {
    "mdl_irr_household_size2"
}
SMALL = [k for k in ORACLE if k not in FITTED | SAME_CODE]


@pytest.fixture(scope="module")
def duck(sf_dir):
    return crosscheck.connect(sf_dir)


@pytest.mark.parametrize("key", SMALL)
def test_query_equals_sql(spark, sf_dir, duck, key):
    assert crosscheck.compare(spark, duck, sf_dir, entry.queries()[key], ORACLE[key]) == []


@pytest.mark.parametrize("key", ALL_FACTORS)
def test_full_model_equals_sql(spark, key):
    assert crosscheck.compare(spark, crosscheck.connect(LARGER), LARGER, entry.queries()[key], ORACLE[key]) == []


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "age3" and df.count() > 0
