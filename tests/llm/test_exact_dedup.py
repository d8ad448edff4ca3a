import hashlib
import re

from tidemark.llm import exact_dedup as ed


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        kept_one = False
        for i in ids:
            kept = i == keep and not kept_one
            kept_one |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in df.collect()), key=str)


ROWS = (
    [(i, "hot  copy\n" if i % 2 else "hot copy\x0b") for i in range(40, 0, -1)]
    + [(100 + i, f"text {i // 2}") for i in range(60)]
    + [(None, "text 3"), (None, "alone"), (None, "alone"), (7, "seven"), (7, "seven"), (7, "other"), (300, None), (301, ""), (302, " "), (303, "\t\n")]
    + [(304, "long " * 60_000), (305, "long\t" * 60_000)]
)


def test_matches_brute_force_at_any_support(make_docs):
    for support in (0.001, 0.02, 0.2):
        assert rows_of(ed.exact_duplicates(make_docs(ROWS), support)) == brute(ROWS)


def test_heavy_hitters_are_verified(make_docs):
    from tidemark.llm.common import staged

    digested = staged(ed.digests(make_docs(ROWS)), "d")
    found = ed.heavy_hitters(digested, 0.2).collect()
    assert [(r["first"]["doc_id"], r["group_size"]) for r in found] == [(1, 40)]


def test_drop(make_docs):
    docs = make_docs(ROWS)
    kept = ed.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted((i for i, _, _, k, _ in brute(ROWS) if k), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want
    assert ed.drop_exact_duplicates(make_docs([])).count() == 0 and ed.exact_duplicates(make_docs([])).count() == 0


def test_large_groups_join_map_side(make_docs, monkeypatch):
    """Half of the rows are copies without an id, and no table of groups is small enough to be broadcast whole."""
    from tidemark.llm import common

    rows = [(None, "hot row")] * 400 + ROWS
    monkeypatch.setattr(common, "LARGE_GROUP", 2)
    monkeypatch.setattr(common, "small_enough", lambda df, row_bytes, limit=0: "group_size" in df.columns and df.count() < 20)
    assert rows_of(ed.exact_duplicates(make_docs(rows), 0.9)) == brute(rows)
    kept = ed.drop_exact_duplicates(make_docs(rows), 0.9).collect()
    assert sorted(((r["doc_id"] for r in kept)), key=str) == sorted((i for i, _, _, k, _ in brute(rows) if k), key=str)
    assert sum(r["text"] == "hot row" for r in kept) == 1
