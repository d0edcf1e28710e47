import hashlib

from barquet.llm import lines


def plain(rows):
    """Names in order, first occurrence of each three-line window, covered lines removed."""
    import zlib
    name = lambda r: ((1 << 63) - 1 if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()))
    first = {}
    for r in sorted(rows, key=name):
        ls = (r[1] or "").split("\n") if r[1] is not None else []
        for p in range(len(ls) - 2):
            first.setdefault(tuple(ls[p:p + 3]), (name(r), p))
    out = []
    for r in rows:
        ls = r[1].split("\n") if r[1] is not None else []
        gone = {p + j for p in range(len(ls) - 2) for j in range(3) if first[tuple(ls[p:p + 3])] != (name(r), p)}
        kept = None if r[1] is None else "\n".join(x for i, x in enumerate(ls) if i not in gone)
        out.append((r[0], len(ls), len(gone), kept))
    return out


ROWS = [(1, "a\nb\nc\nd", "en", "s"), (2, "x\na\nb\nc\ny", "en", "s"), (3, "a\nb", "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"),
        (6, "q\nq\nq\nq\nq", "en", "s"), (7, "a\nb\nc\nd", "en", "s"), (7, "a\nb\nc\nd", "en", "s"), (None, "b\nc\nd\n", None, None), (7, "n\na\nb\nc", "en", "s"),
        (8, "\n\n\n\n", "en", "s"), (9, "\n\n\nend", "en", "s")]


def test_counts_against_plain_version(make_docs, odd_rows):
    rows = ROWS + [(100 + (r[0] or 0), *r[1:]) for r in odd_rows]
    got = sorted(map(tuple, lines.dedup_counts(make_docs(rows)).collect()), key=str)
    sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(i, n, g, sha(t)) for i, n, g, t in plain(rows)], key=str)
    assert any(r[2] for r in got)


def test_rows_keep_columns_and_lose_emptied_documents(make_docs):
    docs = make_docs(ROWS)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert got[2, "x\ny"]["n_chars"] == 3 and got[1, "a\nb\nc\nd"]["n_chars"] == 7
    assert got[6, "q"]["n_chars"] == 1
    assert (4, None) in got and (5, "") in got
    assert not any(i == 7 and t == "" for i, t in got)


def test_equal_rows_do_not_remove_each_other(make_docs):
    one, two, partly = "u1\nu2\nu3\nu4", "v1\nv2\nv3", "u1\nu2\nu3\nw"
    rows = [(1, one, "en", "s")] * 2 + [(None, two, None, None)] * 2 + [(5, partly, "en", "s")] * 2 + [(6, "k\nk\nk\nk", "en", "s")] * 3 + [(9, None, "en", "s")] * 2
    want = sorted([(1, one)] * 2 + [(None, two)] * 2 + [(5, "w")] * 2 + [(6, "k")] * 3 + [(9, None)] * 2, key=str)
    for parts in (1, 7):  # repeats within a batch, and in several tasks
        docs = make_docs(rows, parts)
        assert sorted(((r["doc_id"], r["text"]) for r in lines.dedup_lines(docs).collect()), key=str) == want
        sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
        counts = sorted(map(tuple, lines.dedup_counts(docs).collect()), key=str)
        assert counts == sorted([(i, n, g, sha(t)) for i, n, g, t in plain(rows)], key=str)


def test_empty_table(make_docs):
    assert lines.dedup_counts(make_docs([])).collect() == []
    assert lines.dedup_lines(make_docs([])).collect() == []
