"""Every registered query of the engine against its SQL, over the smallest tables."""

import math

import numpy as np
import pytest

from tallybrook import plans
from tallybrook.sources import fixtures as S

from .conftest import SF
from .oracle import connect, same_rows


def same_sizes(rows):
    """Ratios of predicted to actual totals near one: no model of these features is far off in sum."""
    return all(r["n"] > 1000 and r["mae"] > 0 and 0.5 < r["ratio"] < 2 for r in rows)


def best_by_type(rows):
    """The optimality conditions of a non-negative fit, on products that another engine made."""
    con = connect(SF)
    log = "SELECT page_idx, resource_type AS t, count(*)::DOUBLE AS k, coalesce(sum(transfer_bytes), 0)::DOUBLE AS y FROM requests GROUP BY 1, 2"
    cells = con.sql(f"WITH {S.WITH_REQUESTS} {log}").fetchall()
    names = sorted({c[1] for c in cells})
    pages = {p: i for i, p in enumerate(sorted({c[0] for c in cells}))}
    x, y = np.zeros((len(pages), len(names))), np.zeros(len(pages))
    for p, t, k, v in cells:
        x[pages[p], names.index(t)] = k
        y[pages[p]] += v
    coef = np.array([{r["t"]: r["coef"] for r in rows}[t] for t in names])
    slope = x.T @ (x @ coef - y) / np.linalg.norm(x, axis=0) / np.linalg.norm(y)
    return (coef >= 0).all() and (slope >= -1e-5).all() and (np.abs(slope[coef > 0]) < 1e-5).all()


#: What the rows of queries without SQL must hold besides being there and finite.
HOLDS = {
    "quantile_models": lambda rows: 0.7 < rows[0]["coverage"] < 0.9 and rows[0]["median_width"] > 0,
    "tweedie_sweep": lambda rows: len(rows) == 12 and same_sizes(rows) and {r["model"] for r in rows} == {"trees", "log_linear"},
    "regressors": lambda rows: {r["model"] for r in rows} == {"ridge", "tweedie", "two_stage"} and same_sizes(rows),
    "nnls_by_type": best_by_type,
    "hashed_tokens": lambda rows: all(len(r["features"]) == 64 and min(abs(math.hypot(*r["features"]) - x) for x in (0, 1)) < 1e-9 for r in rows),
    "url_embeddings": lambda rows: all(0 < math.hypot(*r["embedding"]) <= 1 + 1e-9 for r in rows),
    "shift_classifier": lambda rows: all(0 <= rows[0][c] <= 1 for c in ("auc", "type_accuracy")),
    "forest_importances": lambda rows: [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and all(a["importance"] >= b["importance"] for a, b in zip(rows, rows[1:], strict=False)) and sum(r["importance"] for r in rows) <= 1 + 1e-9,
    "tuned_trees": lambda rows: rows[0]["max_depth"] in (2, 4) and rows[0]["step_size"] in (0.1, 0.3) and rows[0]["cv_mae"] > 0 and same_sizes(rows),
    "type_probabilities": lambda rows: len(rows) == 2 and all(-1 <= r["error_correlation"] <= 1 for r in rows),
    "feature_ablation": same_sizes,
    "halving_search": lambda rows: [sum(r["rung"] == k for r in rows) for k in range(3)] == [6, 3, 1] and [sum(r["rung"] == k and r["kept"] for r in rows) for k in range(3)] == [3, 1, 1],
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLE:
        same_rows(df, con, plans.ORACLE[name])
    else:
        rows = df.collect()
        assert rows and all(any(r[c] is not None for r in rows) for c in df.columns)
        assert all(math.isfinite(v) for r in rows for v in r if isinstance(v, float))
        assert HOLDS.get(name, bool)(rows)
