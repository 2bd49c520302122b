"""Line dedup against plain code and its SQL on odd rows."""

from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from tablemill.llm import linededup

ROWS = [
    (1, "Menu\nalpha\n menu ", "s"), (2, "Menu\t\nbeta", "s"), (3, " Menu\ngamma\ngamma", "s"), (4, "delta\n\nMenu", "s"),
    (5, "Menu", None), (6, "Menu", None), (7, None, "s"), (8, "", "s"), (9, None, None), (3, " Menu\ngamma\ngamma", "s"),
    (10, "Menu\ntail\n", "="), (None, "Menu", "s"), (11, "x\r\nMenu\r\n", "s"),
]


def plain(rows, ratio, least):
    strip = " \t\r\f\v"
    total, pages = Counter(r[2] for r in rows), defaultdict(int)
    for _, text, source in rows:
        for line in {x.strip(strip) for x in (text or "").split("\n")} - {""}:
            pages[source, line] += 1
    bad = {k for k, n in pages.items() if n >= least and n > ratio * total[k[0]]}
    out = []
    for doc_id, text, source in rows:
        kept = None if text is None else [x for x in text.split("\n") if (source, x.strip(strip)) not in bad]
        out.append((doc_id, None if kept is None else "\n".join(kept), 0 if kept is None else len(text.split("\n")) - len(kept)))
    return sorted(out, key=repr)


def test_against_plain_code_and_sql(docs_of, spark):
    for ratio, least in ((0.3, 2), (0.05, 5), (0.0, 1), (0.9, 1)):
        got = sorted((tuple(r) for r in linededup.dedup_lines(docs_of(ROWS), ratio, least).select("doc_id", "text", "n_dropped").collect()), key=repr)
        assert got == plain(ROWS, ratio, least)
        con = duckdb.connect()
        con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
        con.executemany("insert into documents values (?, ?, ?)", ROWS)
        assert sorted(con.execute(linededup.dedup_sql(ratio=ratio, least=least)).fetchall(), key=repr) == got


def test_other_columns_stay_and_empty_tables(docs_of):
    docs = docs_of(ROWS).withColumns({"host": F.lit(1), "lines": F.lit("x"), "n_dropped": F.lit("old"), "pages": F.lit(2)})
    out = linededup.dedup_lines(docs)
    assert set(out.columns) == set(docs.columns) and out.count() == len(ROWS)
    assert linededup.dedup_lines(docs.limit(0)).collect() == []


def test_small_hosts_lose_their_lines_too(docs_of, spark):
    """Hosts of two to five pages: a line on two pages is above the ratio, a line on one never is."""
    rows = [(10 * n + i, f"Menu\nown {n} {i}\n" + ("twice" if i < 2 else f"tail {i}"), f"h{n}") for n in range(1, 6) for i in range(n)]
    got = sorted(tuple(r) for r in linededup.dedup_lines(docs_of(rows)).select("doc_id", "text", "n_dropped").collect())
    assert got == plain(rows, 0.05, 2)
    by = {r[0]: r[1] for r in got}
    assert by[10] == "Menu\nown 1 0\ntwice" and by[20] == "own 2 0" and by[54] == "own 5 4\ntail 4"
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    assert sorted(con.execute(linededup.dedup_sql()).fetchall()) == got
