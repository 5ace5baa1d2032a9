"""Every SURVEY section 2 operator has its functions in retailops and at least one query."""

import importlib.util
import os

import retailops
import __spark_entry__ as E

_PATH = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts", "coverage.py")
_spec = importlib.util.spec_from_file_location("retailops_coverage_map", _PATH)
cov = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(cov)


def test_every_operator_has_functions_and_queries():
    names = set(E.queries())
    missing = []
    for op_id, funcs in cov.FUNCS.items():
        if funcs != cov.PLAIN:
            missing += [f"{op_id}:{f}" for f in funcs.split() if not hasattr(retailops, f)]
        if not cov.queries_for(op_id, names):
            missing.append(f"{op_id}: no query")
    assert not missing, missing
    assert len(cov.FUNCS) == 148
