"""Random plans over random rows against DuckDB, for five seeds."""

import duckdb
import numpy as np
import pytest

from tessera import Catalog, avg, col, collect, count, desc, max_, min_, scan, sum_


def _data(seed):
    """Books and loans: shelves are often unknown, some loans are of books that are gone, fines may be missing."""
    pick = np.random.default_rng(seed)
    n_books, n_loans = int(pick.integers(3, 24)), int(pick.integers(30, 90))
    shelf = pick.integers(0, 4, n_books)
    books = [{"isbn": 50 + 3 * b, "shelf": "ABC"[shelf[b]] if shelf[b] < 3 else None, "pages": int(pick.integers(20, 900))} for b in range(n_books)]
    isbn, state = 50 + 3 * pick.integers(-2, n_books + 2, n_loans), pick.integers(0, 3, n_loans)
    fine, lost = pick.exponential(30.0, n_loans).round(2), pick.random((n_loans, 2)) < (0.2, 0.15)
    loans = [
        {"no": i, "isbn": None if lost[i, 0] else int(isbn[i]), "fine": None if lost[i, 1] else float(fine[i]), "state": ("out", "back", "late")[state[i]]} for i in range(n_loans)
    ]
    return books, loans


_ON = col("b.isbn").eq(col("l.isbn"))


def _pair(how, strategy):
    return scan("books", "b").join(scan("loans", "l"), _ON, how, strategy).select("b.pages", "l.no"), f"select b.pages, l.no from books b {how} join loans l on b.isbn = l.isbn"


_SUMS = [count(), count(col("fine")), sum_(col("fine")), avg(col("fine")), min_(col("fine")), max_(col("state"))]
SHAPES = {
    **{f"{how}-{s}": (lambda how=how, s=s: _pair(how, s)) for how in ("inner", "left", "right", "full") for s in ("hash", None)},
    "filter": lambda: (scan("loans").where((col("fine") > 12) & ~col("state").eq("late") | col("isbn").is_null()).select("no"), "select no from loans where fine > 12 and not state = 'late' or isbn is null"),
    "not-in-null": lambda: (scan("loans").where(col("isbn").isin(53, None, 59, negated=True)).select("no"), "select no from loans where isbn not in (53, null, 59)"),
    "between-null": lambda: (scan("loans").where(col("fine").between(25, None, negated=True)).select("no"), "select no from loans where fine not between 25 and null"),
    "group": lambda: (scan("loans").group("isbn").agg(*_SUMS), "select isbn, count(*), count(fine), sum(fine), avg(fine), min(fine), max(state) from loans group by 1"),
    "global": lambda: (scan("loans").group().agg(*_SUMS), "select count(*), count(fine), sum(fine), avg(fine), min(fine), max(state) from loans"),
    "group-expr": lambda: (scan("loans").group(col("no") % 6, col("state")).agg(count(col("isbn"), distinct=True)), "select no % 6, state, count(distinct isbn) from loans group by 1, 2"),
    "having": lambda: (scan("loans").group("state").agg(count()).where(count() > 12), "select state, count(*) from loans group by 1 having count(*) > 12"),
    "distinct": lambda: (scan("loans").select("isbn", "state").distinct(), "select distinct isbn, state from loans"),
    "sort": lambda: (scan("loans").sort(desc("fine"), "no").limit(9, 4).select("no"), "select no from loans order by fine desc nulls last, no limit 9 offset 4"),
    "theta-full": lambda: (
        scan("books", "b").join(scan("loans", "l"), (col("b.isbn") < col("l.isbn")) & (col("l.fine") > 40), "full").select("b.pages", col("l.no").alias("loan")),
        "select b.pages, l.no from books b full join loans l on b.isbn < l.isbn and l.fine > 40",
    ),
    "join-group": lambda: (
        scan("books", "b").join(scan("loans", "l"), _ON, "left").group("b.shelf").agg(sum_(col("l.fine")), count()).sort("b.shelf"),
        "select shelf, sum(fine), count(*) from books b left join loans l on b.isbn = l.isbn group by 1",
    ),
}


@pytest.fixture(scope="module", params=(3, 14, 159, 2653, 58979))
def world(spark, request):
    books, loans = _data(request.param)
    c = Catalog(spark).add_rows("books", {"isbn": "INTEGER", "shelf": "STRING", "pages": "INTEGER"}, books)
    c.add_rows("loans", {"no": "INTEGER", "isbn": "INTEGER", "fine": "FLOAT", "state": "STRING"}, loans)
    db = duckdb.connect()
    for name in ("books", "loans"):
        table = c.table(name).toArrow()
        db.register("given", table)
        db.execute(f"create table {name} as select * from given")
    return c, db


def _norm(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("shape", SHAPES)
def test_same_rows(world, shape):
    c, db = world
    plan, sql = SHAPES[shape]()
    assert _norm(tuple(r.values()) for r in collect(plan, c).to_pylist()) == _norm(db.execute(sql).fetchall())
