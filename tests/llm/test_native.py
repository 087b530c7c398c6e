"""Operators that SQL can express, on a fixture with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import duckdb
import pandas as pd
import pytest

from folioscope.llm import jaccard_join, license_scan, mixing, url_filter

LONG = "word " * 30_000 + "Released under the MIT License."
ROWS = [
    (1, "Licensed under CC BY-NC 4.0.", "a", "en"), (1, "Licensed under CC BY-NC 4.0.", "a", "en"), (None, "MIT license mit LICENSE", None, None), (2, None, "b", "en"), (3, "", None, "de"),
    (4, LONG, "a", "en"), (5, "This work is licensed under the GNU General Public License, version 3.", "é", "fr"), (6, "MİT license K apache-license version\n2", "Z", "en"), (7, "plain words only here", "b", None),
]
COLUMNS = ["doc_id", "text", "source", "lang"]


def oracle(sql, name, rows, columns):
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=columns).astype({columns[0]: "Int64"}))
    con.execute(f"create table {name} as select * from given")
    got = con.execute(sql)
    return sorted([c[0] for c in got.description]), [dict(zip([c[0] for c in got.description], r, strict=True)) for r in got.fetchall()]


def same(frame, sql, name, rows, columns):
    names, want = oracle(sql, name, rows, columns)
    show = lambda r: str([round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names])
    assert sorted(frame.columns) == names
    assert sorted(show(r.asDict()) for r in frame.collect()) == sorted(map(show, want))


@pytest.mark.parametrize("rows", [ROWS, []])
def test_licenses_mix_and_components(spark, docs, rows):
    frame = docs(rows)
    same(license_scan.scan(frame)[0], license_scan.ORACLE_SQL, "documents", rows, COLUMNS)
    same(mixing.mix(frame), mixing.ORACLE_SQL, "documents", rows, COLUMNS)
    if not rows:
        assert jaccard_join.link(frame)[0].count() == 0
        return
    found = {(r.doc_id, r.labels) for r in license_scan.scan(frame)[0].collect()}
    assert {(1, "cc-by-nc"), (4, "mit"), (5, "gpl-3"), (None, "mit"), (7, "")} <= found
    taken = mixing.mix(frame).collect()
    assert all(0 <= r.taken <= 3 * r.size for r in taken)
    mixed = mixing.materialised(frame)
    assert mixed.columns == frame.columns
    assert mixed.selectExpr("sum(coalesce(regexp_count(text, '[^ ]+'), 0))").first()[0] >= sum(r.taken for r in taken) * 0.9


def test_templates_of_any_length(docs):
    name = " ".join(f"term{i}" for i in range(50))
    text = lambda before: "filler " * before + name + " filler" * 90
    rows = [(i, text(i)) for i in range(0, 120, 7)]
    found = license_scan.scan(docs(rows), templates=[("long", name), ("short", "one two")])[0].collect()
    assert len(found) == len(rows) and {(r.labels, r.score) for r in found} == {("long", 1.0)}
    with pytest.raises(ValueError):
        license_scan.scan(docs(rows), templates=[("long", name)], block_words=98)


def seats(values, n):
    """One seat after another to the highest quotient, the first of equals."""
    won = [0] * len(values)
    for _ in range(n if sum(values) else 0):
        best = max(range(len(values)), key=lambda i: (values[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("sizes", [{"a": [4000] * 20, "b": [9], "c": [9]}, {"a": [50, 60, 70], "b": [400] * 5, None: [3, 1]}, {"a": [700] * 9, "b": [700] * 9, "c": [700] * 9, "d": [5]}])
def test_seats_one_by_one_and_small_sources(docs, sizes):
    rows = [(i, " ".join(["w"] * n), source) for i, (source, n) in enumerate((k, n) for k, v in sizes.items() for n in v)]
    got = mixing.mix(docs(rows)).collect()
    names = sorted((k for k in sizes), key=lambda k: (k is None, k or ""))
    total, caps, weight = sum(map(sum, sizes.values())), {k: 3 * sum(sizes[k]) for k in names}, {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:  # share, cap what is above, share the rest again
        level = (total - sum(target.values())) / sum(weight[k] for k in open_)
        above = {k for k in open_ if level * weight[k] > caps[k]}
        target |= {k: caps[k] for k in above} if above else {k: level * weight[k] for k in open_}
        open_ = open_ - above if above else set()
    block = max(1, min(mixing.BLOCK_WORDS, int(min(target.values()) / 8)))
    won = dict(zip(names, seats([target[k] for k in names], -(-total // block)), strict=True))
    by_id = {i: source for i, _, source in rows}
    for k in names:
        own = [r for r in got if by_id[r.doc_id] == k]
        assert all(abs(r.target - target[k]) < 1e-6 and r.taken <= 3 * r.size for r in own)
        taken = sum(r.taken for r in own)
        assert taken == min(won[k] * block, caps[k]) and abs(taken - target[k]) <= block
    mixed = mixing.materialised(docs(rows)).selectExpr("doc_id", "regexp_count(text, '[^ ]+') as n").groupBy("doc_id").sum("n").collect()
    assert {r[0]: r[1] for r in mixed} == {r.doc_id: r.taken for r in got if r.taken}


def test_urls(spark):
    rows = [(i, f"https://{h}.example.{t}/{p}/{i}") for i, (h, t, p) in enumerate((h, t, p) for h in ("a", "WWW.b", "pills") for t in ("com", "net", "org") for p in ("en", "de", "fr"))]
    rows += [(90, None), (91, ""), (92, "no scheme"), (93, "http://net"), (94, "http://net/"), (95, "ftp://X.NET?q#f"), (None, "http://example.net/en/x"), (96, "é://ü.org/fr/" + "x" * 50_000), (96, "http://u.org")]
    for given in (rows, rows[-9:-6], []):
        frame = spark.createDataFrame(given, "page_id long, url string").selectExpr("*", "'x' as host", "1 as score")
        same(url_filter.judge(frame), url_filter.ORACLE_SQL, "pages", given, ["page_id", "url"])


def test_threshold_is_set_on_urls_that_trained_no_model(spark):
    words = ["news", "sport", "kultur", "wetter", "a", "archives", "x9", "2024"]
    tail = lambda i: "/".join(words[i * k % 8] for k in range(1, 2 + i % 4))
    rows = [(i, f"https://good{i % 7}.example.org/fr/{tail(i)}" if i % 2 else f"https://casino{i % 5}.example.net/pills/{i}") for i in range(400)]
    rows += [(1000 + i, f"https://good{i % 7}.example.org/fr?{tail(i)}" if i % 2 else f"https://casino{i % 5}.example.nets/pills/{i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    same(url_filter.judge(frame), url_filter.ORACLE_SQL, "pages", rows, ["page_id", "url"])
    got = [(r.page_id % 2 == 1, r.verdict == "allow") for r in url_filter.judge(frame).filter("rule is null").collect()]
    assert len(got) == 40 and sum(a == b for a, b in got) >= 36
