"""Queries and their SQL on books of more pages than the small tables have."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def both(spark, folder, name):
    """Rows of a query and of its SQL."""
    got = entry.queries()[name](spark, str(folder))
    with duckdb.connect() as db:
        for path in folder.glob("*.parquet"):
            db.execute(f"create view {path.stem} as select * from '{path}'")
        want = db.sql(entry.oracle_sql()[name]).select(*[f'"{c}"' for c in got.columns]).fetchall()
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, want))


def test_references_of_five_digits_are_no_pages_in_query_and_sql(spark, tmp_path):
    line = "alpha beta river mountain winds"
    books = {"a": 10_030, "b": 10_030, "c": 20}
    pages = [(s, "\n".join([line] * (60 if s == "a" and i in (9950, 10_000) else 9 if s == "b" and i == 10_000 else 3)) if i % 25 == 0 else "x") for s, n in books.items() for i in range(n)]
    table = {"doc_id": range(len(pages)), "text": [t for _, t in pages], "lang": ["en"] * len(pages), "source": [s for s, _ in pages], "n_chars": [len(t) for _, t in pages]}
    pq.write_table(pa.table({k: list(v) for k, v in table.items()}), tmp_path / "documents.parquet")
    got, want = both(spark, tmp_path, "printed_contents")
    assert got == want and len(got) > 10
    assert any(".... 100" in r and "None" in r for r in got)


def test_all_headings_of_a_book_count(spark, tmp_path):
    letters = "bcdfghjklm"
    word = lambda n: "".join(letters[int(d)] + "a" for d in str(n))  # noqa: E731  digits would not tell lines apart
    texts = ["\n".join(f"{word(9 * i + k)} river {word(7 * i + k)} mountain" for k in range(8)) for i in range(700)]
    table = {"doc_id": range(700), "text": texts, "lang": ["en"] * 700, "source": ["a"] * 690 + ["b"] * 10, "n_chars": [len(t) for t in texts]}
    pq.write_table(pa.table({k: list(v) for k, v in table.items()}), tmp_path / "documents.parquet")
    got, want = both(spark, tmp_path, "typographic_headings")
    assert got == want and len(got) > 510
    got, want = both(spark, tmp_path, "detect_statistics")
    assert got == want and len(got) == 2
