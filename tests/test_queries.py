"""Every query of the engine gives what its SQL gives."""

import pytest

from helpers import SMALL, norm
from tracewright.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    rows = [dict(zip(columns, r)) for r in want.fetchall()]
    assert norm([r.asDict() for r in df.collect()], columns) == norm(rows, columns)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_prune_and_stay_in_the_jvm(spark):
    plan = QUERIES["distribution_of_filtered_view"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "TakeOrderedAndProject" in plan
    scan = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "event_type" in scan and "props" in scan and "value" not in scan


def test_modules_define_names_once():
    """A function defined twice hides the first; each module's own names are checked."""
    import ast
    from collections import Counter
    from pathlib import Path

    for path in sorted(Path(__file__).resolve().parents[1].glob("**/*.py")):
        for scope in [t for t in ast.walk(ast.parse(path.read_text())) if isinstance(t, (ast.Module, ast.ClassDef))]:
            names = Counter(x.name for x in scope.body if isinstance(x, (ast.FunctionDef, ast.ClassDef)))
            assert not [n for n, k in names.items() if k > 1], path
