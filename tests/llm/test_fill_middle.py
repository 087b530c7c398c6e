import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import fill_middle as fim

TEXT = st.text(st.sampled_from(list("ab <PSM>\n\t \x0b\x0c\r\x85é한😀")), max_size=40)


def by_hand(text, doc_id):
    """The contract, written down once more with slices of lists."""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    parts = ["".join(x) for x in (units[:a], units[a:b], units[b:])]
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}" if form == "psm" else f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return len(units), form, len(parts[0]), len(parts[1]), out


@settings(max_examples=500, deadline=None)
@given(TEXT, st.integers(-5, 10**12))
def test_cuts_and_restores(text, doc_id):
    parts = fim.cut(text, doc_id)
    n, form, prefix, middle, out = by_hand(text, doc_id)
    assert (parts.n, parts.form, fim.assembled(parts)) == (n, form, out)
    assert form == "plain" or (len(parts.prefix), len(parts.middle)) == (prefix, middle)
    assert fim.restored(out, form) == text


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, TEXT)
def test_restores_any_parts_without_marks(prefix, middle, suffix):
    if not any(m in prefix + "|" + middle + "|" + suffix for m in ("<P>", "<S>", "<M>")):
        for form in ("spm", "psm"):
            assert fim.restored(fim.assembled(fim.Cut(0, form, prefix, middle, suffix)), form) == prefix + middle + suffix


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rows_equal_sql_and_hand(spark, docs, tmp_path):
    rows = [(i, f"word{i} and\n\n more  of it " * (i % 7)) for i in range(300)]
    rows += [(7, None), (8, ""), (None, "no id at all"), (8, "one <P> two"), (9, "word9 and\n\n more  of it " * 2), (10**15, "x " * 200_000), (11, " \n "), (12, "한 😀 é " * 50)]
    got = fim.transform(docs(rows)).collect()
    want = []
    for doc_id, text in rows:
        text = text or ""
        n, form, prefix, middle, out = by_hand(text, "" if doc_id is None else doc_id)
        want.append((doc_id, n, form, prefix, middle, out, sha(out), sha(text)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    docs(rows).select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    found = con.execute("select doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 from (" + fim.ORACLE_SQL + ")").fetchall()
    assert sorted(found, key=str) == sorted(((*w[:5], *w[6:]) for w in want), key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_shares_and_seeds(docs):
    rows = [(i, "some words to cut") for i in range(2000)]
    forms = [r.form for r in fim.transform(docs(rows), transformed=100, suffix_first=0).collect()]
    assert set(forms) == {"psm"}
    other = fim.transform(docs(rows), seed=43).select("output").collect()
    assert [r.output for r in other] != [r.output for r in fim.transform(docs(rows)).select("output").collect()]


def test_empty_table(docs):
    assert fim.transform(docs([])).count() == 0
