import pytest
from lafzspark.plans import catalog, corpora, models, texts
from tests.compare import both

MODULES = (catalog, texts, corpora, models)
SF = "/root/testdata/sf0.001"
WITH_SQL = sorted((name, m) for m in MODULES for name in m.ORACLE_SQL)
WITHOUT = sorted((name, m) for m in MODULES for name in m.QUERIES if name not in m.ORACLE_SQL)


@pytest.mark.parametrize(("name", "module"), WITH_SQL, ids=[n for n, _ in WITH_SQL])
def test_query_equals_its_sql(spark, name, module):
    ours, held = both(spark, module.QUERIES[name], module.ORACLE_SQL[name], SF)
    assert ours == held


@pytest.mark.parametrize(("name", "module"), WITHOUT, ids=[n for n, _ in WITHOUT])
def test_query_without_sql_gives_rows(spark, name, module):
    assert module.QUERIES[name](spark, SF).count() > 0


def test_names_are_unique_and_queries_need_no_session():
    names = [n for m in MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))
